"""Many path patterns at once: patterns are rows, a tree of their segments is walked segment by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import FRONTIER_ROWS, cut
from .search import prefixes

GLOBSTAR = "**"
#: A piece of a segment: an escaped character, a class, stars, a question mark, or text.
_PIECE = r"(\\.|\[[!^]?\]?[^\]]*\]|\*+|\?|[^*?\[\\]+|\[|\\)"
#: Steps after which the states are written, so that plans of deep paths stay small.
CUT_EVERY = 4


def segment_regex(segment: Column) -> Column:
    """Anchored regular expression of one pattern segment. * and ? stay within it, [..] is a class ([!..] and [^..] its complement), a backslash takes the next character as it is.

    A segment that begins with one of these takes no name that begins with a dot.
    """
    pieces = F.regexp_extract_all(segment, F.lit(_PIECE), 1)
    quoted = lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))  # noqa: E731  no piece of text has a backslash
    inner = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\[[!^]", "[^"), r"(?<!^)(?<!^\[\^)\[|\\(?!.)", r"\\["), "&", r"\\&")
    one = lambda t: (
        F.when(t.rlike(r"^\\."), quoted(F.substring(t, 2, 9)))
        .when(t.rlike(r"^\[.+\]$"), inner(t)).when(t.startswith("*"), "[^/]*").when(t == "?", "[^/]").when(t == "\\", r"\\\\").otherwise(quoted(t))
    )
    nodot = F.when(segment.rlike(r"^(?:[*?]|\[.+\])"), "(?!\\.)").otherwise("")
    return F.concat(F.lit("^(?s:"), nodot, F.array_join(F.transform(pieces, one), ""), F.lit(")$"))


def tree(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, seg, kind, regex, child): the edges of the tree of all patterns' segments, and (node, pattern): where each pattern ends. Segments shared by patterns are one edge."""
    segs = F.split(F.regexp_replace("pattern", r"(?:\*\*/)+(?=\*\*(?:/|$))", ""), "/")
    rows = patterns.select("pattern").distinct().withColumn("segs", segs)
    steps = rows.select("segs", F.posexplode("segs").alias("n", "seg"))
    upto = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("segs", F.lit(1), n), "/"))
    kind = F.when(F.col("seg") == GLOBSTAR, GLOBSTAR).when(F.col("seg").rlike(r"[*?\\]|\[.*\]"), "magic").otherwise("plain")
    edges = steps.select(upto(F.col("n")).alias("node"), "seg", kind.alias("kind"), F.when(kind == "magic", segment_regex(F.col("seg"))).alias("regex"), upto(F.col("n") + 1).alias("child"))
    return edges.distinct(), rows.select(upto(F.size("segs")).alias("node"), "pattern")


def matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, pattern): which paths (path) each pattern (pattern) matches, whatever the number of either.

    ** as a whole segment stands for any number of folders whose names begin with no dot; at the end it takes one name at least, but x/** also holds the path x as it is
    written. A state is a path and a node of the patterns' tree; a step joins the states with the plain edges by node and name, with the others by node, so a path meets the
    patterns that agree with it so far, not all. There are as many steps as the deepest path has names.
    """
    edges, ends = tree(patterns)
    edges = cut(edges)
    small = edges.count() <= FRONTIER_ROWS
    hint = F.broadcast if small else lambda df: df
    plain = hint(edges.where("kind = 'plain'").select("node", "seg", "child"))
    magic = hint(edges.where("kind = 'magic'").select("node", "regex", "child"))
    stars = hint(edges.where(F.col("kind") == GLOBSTAR).select("node", "child"))
    ends = cut(ends)
    every = cut(paths.where("path is not null").select("path").distinct().withColumn("names", F.split("path", "/")))
    deepest = every.agg(F.max(F.size("names"))).first()[0] or 0

    def opened(states: DataFrame) -> DataFrame:
        """States and the ** below them, which stand for no folder at all so far."""
        below = states.join(stars, "node").select("path", "names", F.col("child").alias("node"), F.lit(False).alias("taken"))
        return states.unionByName(below)

    states = opened(every.select("path", "names", F.lit("/").alias("node"), F.lit(True).alias("taken")))
    found = None
    for step in range(1, deepest + 1):
        now = states.where(F.size("names") >= step).withColumn("seg", F.get("names", F.lit(step - 1)))
        there = F.lit(True).alias("taken")
        a = now.join(plain, ["node", "seg"]).select("path", "names", F.col("child").alias("node"), there)
        b = now.join(magic, "node").where(F.expr("seg rlike regex")).select("path", "names", F.col("child").alias("node"), there)
        c = now.where((F.col("node").endswith("/" + GLOBSTAR)) & ~F.col("seg").startswith(".")).select("path", "names", "node", there)
        reached = a.unionByName(b).unionByName(c).distinct()
        if step % CUT_EVERY == 0:
            reached = cut(reached)
        over = reached.where(F.size("names") == step).select("path", "node")
        found = over if found is None else found.unionByName(over)
        states = opened(reached)
    if found is None:
        return every.select("path", F.lit("").alias("pattern")).where(F.lit(False))
    hits = found.join(ends, "node").select("path", "pattern")
    itself = patterns.where(F.col("pattern").endswith("/" + GLOBSTAR)).select("pattern", F.expr("left(pattern, length(pattern) - 3)").alias("path"))
    return hits.unionByName(every.join(itself, "path").select("path", "pattern")).distinct()


def scopes(paths: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(workspace, path): paths in the scope of each workspace (id, folder, include, exclude: arrays of patterns). An exclude wins; without an include the folder decides."""
    sides = workspaces.select("id", F.explode(F.coalesce("include", F.array())).alias("pattern"), F.lit(True).alias("in")).unionByName(
        workspaces.select("id", F.explode(F.coalesce("exclude", F.array())).alias("pattern"), F.lit(False).alias("in"))
    )
    hits = cut(matches(paths, sides).join(sides, "pattern").select("id", "path", "in").distinct())
    bare = workspaces.where(F.size(F.coalesce("include", F.array())) == 0)
    steps = paths.select("path", F.explode(F.concat(F.array(F.lit(".")), prefixes(F.col("path")))).alias("folder"))
    inside = bare.select("id", F.when(F.col("folder") == "", ".").otherwise(F.col("folder")).alias("folder")).join(steps, "folder").select("id", "path")
    wanted = hits.where(F.col("in")).select("id", "path").unionByName(inside).distinct()
    return wanted.join(hits.where(~F.col("in")).select("id", "path"), ["id", "path"], "left_anti").select(F.col("id").alias("workspace"), "path")
