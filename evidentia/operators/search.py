"""Search, lookup and path-scope operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiered(nodes: DataFrame, text: str, limit: int = 12) -> DataFrame:
    """Labels equal to, beginning with or containing the text, in lower case; better tiers first, then by id."""
    low, q = F.lower("label"), text.lower()
    tier = F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2)
    return nodes.withColumn("tier", tier).where("tier is not null").orderBy("tier", "id").limit(limit).select("id", "label", "tier")


def multi_field(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The first nodes by id with the text in label, kind, feature or file."""
    hit = F.lit(False)
    for c in ("label", "kind", "feature", "file"):
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return nodes.where(hit).orderBy("id").limit(limit).select("id", "label", "kind", "file")


def located(nodes: DataFrame, label: str, cap: int = 64) -> DataFrame:
    """Nodes of exactly that label, up to the cap."""
    return nodes.where(F.col("label") == label).orderBy("id").limit(cap).select("id", "label", "file")


def lookup(rows: DataFrame, key: str) -> DataFrame:
    """(key, verdict): found where a key has one row, ambiguous where it has more. Keys without rows are not_found to whoever joins."""
    return rows.groupBy(key).agg(F.when(F.count("*") == 1, "found").otherwise("ambiguous").alias("verdict"))


def within(path: Column, folder: Column) -> Column:
    """Whether a path is the folder or below it; '.' holds everything."""
    return (folder == ".") | (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def prefixes(path: Column) -> Column:
    """All folders of a path, itself included: 'a', 'a/b', 'a/b/c'."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, project): the deepest folder (columns folder, project) that holds each path.

    An equi-join on the path's own folders in place of a comparison of all pairs.
    """
    steps = files.select("path", F.explode(prefixes(F.col("path"))).alias("folder"))
    return steps.join(folders, "folder").groupBy("path").agg(F.max_by("project", F.struct(F.length("folder"), F.col("folder"))).alias("project"))


def nested(folders: DataFrame) -> DataFrame:
    """(outer, inner, relative): folders that lie below others, by an equi-join on their parents."""
    steps = folders.select(F.col("folder").alias("inner"), F.explode(prefixes(F.col("folder"))).alias("outer")).where("outer <> inner")
    known = folders.select(F.col("folder").alias("outer")).distinct()
    return steps.join(known, "outer").select("outer", "inner", F.expr("substring(inner, length(outer) + 2)").alias("relative"))


def _segment(segment: str) -> str:
    """Regular expression of one segment of a glob; a wildcard or class at its head takes no dot."""
    out, k, pieces = "", 0, re.findall(r"\\.|\[[!^]?\]?[^\]]*\]|\*+|\?|[^*?\[\\]+|\[|\\", segment)
    for piece in pieces:
        if piece[0] == "*":
            out += "[^/]*"
        elif piece == "?":
            out += "[^/]"
        elif piece[0] == "[" and len(piece) > 2:
            body = piece[2:-1] if piece[1] in "!^" else piece[1:-1]
            out += ("[^" if piece[1] in "!^" else "[") + re.sub(r"[\[&~\\]", lambda m: "\\" + m[0], body) + "]"
        else:
            out += re.escape(piece[1] if piece[0] == "\\" and len(piece) == 2 else piece)
        k += 1
    magic = pieces and (pieces[0][0] in "*?" or (pieces[0][0] == "[" and len(pieces[0]) > 2))
    return ("(?!\\.)" if magic else "") + out


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob. ** as a segment stands for folders without a leading dot; *, ? and [..] stay within a segment, and take no leading dot; 'x/**' holds the path x as it is written."""
    if glob.endswith("/**"):
        return f"^(?:{re.escape(glob[:-3])}|{glob_regex(glob[:-3] + '/**/*')[1:-1]})$"
    parts, out = glob.split("/"), ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += r"(?!\.)[^/]+(?:/(?!\.)[^/]+)*" if last else r"(?:(?!\.)[^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    return f"^{out}$"


def scope_matches(files: DataFrame, workspaces: list[dict]) -> DataFrame:
    """(workspace, path): paths in a workspace's scope. An exclude wins; without an include the workspace's folder decides.

    Workspaces are a request's bounded list; each is one predicate of a single scan of the files.
    """
    hits = []
    for w in workspaces:
        path = F.col("path")
        inside = F.lit(False)
        for g in w.get("include") or []:
            inside = inside | path.rlike(glob_regex(g))
        if not w.get("include"):
            inside = within(path, F.lit(w["folder"]))
        for g in w.get("exclude") or []:
            inside = inside & ~path.rlike(glob_regex(g))
        hits.append(F.when(inside, F.lit(w["id"])))
    return files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("workspace"))
