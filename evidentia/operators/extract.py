"""Operators that make symbol, dependency and document rows from source files (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from .durable import counted, cut
from .ordered import placed

_TS = r"(?m)^[ \t]*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|type|enum|function|const|let|var)\s*\*?\s+([A-Za-z_$][A-Za-z0-9_$]*)"
_IMPORT = r"(?:^|\n)[ \t]*(?:import|export)\s[^;'\"]*?from\s*['\"]([^'\"]+)['\"]|(?:^|\n)[ \t]*import\s*['\"]([^'\"]+)['\"]"
# Fixed values of the resolution: what may follow a specifier, in order.
TAILS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def declarations(files: DataFrame, pattern: str) -> DataFrame:
    """(path, name, kind, namespace, ord): type declarations in order."""
    kinds, names = (F.regexp_extract_all("text", F.lit(pattern), k) for k in (1, 2))
    space = F.regexp_extract("text", r"(?m)^\s*namespace\s+([A-Za-z0-9_.]+)", 1)
    rows = files.select("path", space.alias("namespace"), F.posexplode(F.arrays_zip(kinds.alias("kind"), names.alias("name"))).alias("ord", "d"))
    return rows.select("path", F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), "namespace", "ord")


def exports(files: DataFrame) -> DataFrame:
    """Exported names of TypeScript and JavaScript files, one row for each file and name. A lexer's view, so partial by nature."""
    code = files.where(F.col("path").rlike(r"(?i)\.(?:tsx?|jsx?)$"))
    return declarations(code, _TS).drop("namespace").dropDuplicates(["path", "name"])


def imports(files: DataFrame) -> DataFrame:
    """(path, specifier): module specifiers that a file imports or re-exports."""
    code = files.where(F.col("path").rlike(r"(?i)\.(?:tsx?|jsx?)$"))
    both = F.concat(F.regexp_extract_all("text", F.lit(_IMPORT), 1), F.regexp_extract_all("text", F.lit(_IMPORT), 2))
    return code.select("path", F.explode(F.array_distinct(F.filter(both, lambda x: x != ""))).alias("specifier"))


def resolved(imported: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, target): relative specifiers, and those that begin with a slash, taken from the importing file's folder and resolved to the first candidate that is a file; null where none is."""
    folder = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    parts = F.filter(F.concat(folder, F.split("specifier", "/")), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    base = F.aggregate(
        parts, none,
        lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a),
        lambda a: F.array_join(a, "/")
    )
    tails = F.array(*map(F.lit, TAILS))
    rows = imported.where(F.col("specifier").startswith(".") | F.col("specifier").startswith("/")).withColumn("base", base)
    rows = rows.select("path", "specifier", "base", F.posexplode(tails).alias("n", "tail"))
    # as many rows as there are files: never broadcast, whatever their compressed size makes Spark expect
    hits = rows.select("path", "specifier", "n", F.concat("base", "tail").alias("target")).join(files.select(F.col("path").alias("target")).distinct().hint("merge"), "target")
    best = hits.groupBy("path", "specifier").agg(F.min_by("target", "n").alias("target"))
    return imported.join(best.hint("merge"), ["path", "specifier"], "left")


def identifier_index(files: DataFrame) -> DataFrame:
    """(identifier, files): how many files have each identifier."""
    return files.select(F.explode(texts.identifiers(F.col("text"))).alias("identifier")).groupBy("identifier").agg(F.count("*").alias("files"))


def dependency_edges(deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, relation): dependencies (id, dep_name, relation) on symbols of that name, without self-edges, once each.

    An edge to a symbol of one name comes of one row of each side once both are made different, so these edges are not compared with each other; only symbols that bear several names need that.
    """
    named = cut(symbols.select(F.col("id").alias("dst"), F.col("name").alias("dep_name")).where("dep_name is not null").distinct())
    least = named.groupBy("dst").agg(F.count("*").alias("n"), F.min("dep_name").alias("dep_name"))
    several, n = counted(named.join(least.where("n > 1").select("dst").hint("merge"), "dst", "left_semi"))
    wanted = deps.select("id", "dep_name", "relation").distinct()
    edges = lambda names: wanted.join(names, "dep_name").where("id <> dst").select(F.col("id").alias("src"), "dst", "relation")
    single = edges(least.where("n = 1").drop("n").hint("merge"))
    return single.unionByName(edges(several).distinct()) if n else single


def unrepresented(imported: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports without an edge (path, specifier): each makes the result partial."""
    return imported.join(edges.select("path", "specifier").distinct(), ["path", "specifier"], "left_anti")


def native_evidence(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose id is unique, and edges once each with both ends among them."""
    sound = nodes.groupBy("id").agg(F.count("*").alias("n"), F.min("label").alias("label")).where("n = 1").select("id", "label")
    ids = sound.select("id")
    kept = edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return sound, kept.select("src", "dst", "relation").distinct()


def census(declared: DataFrame, name: str, ceiling: int = 256) -> DataFrame:
    """One row: matches of a name and the verdict unique, ambiguous, not_found, or partial beyond the ceiling."""
    n = declared.where(F.col("name") == name).agg(F.count("*").alias("matches"))
    return n.withColumn(
        "verdict",
        F.when(F.col("matches") > ceiling, "partial").when(F.col("matches") == 0, "not_found").when(F.col("matches") == 1, "unique").otherwise("ambiguous")
    )


def snapshot_token(files: DataFrame, key: str) -> DataFrame:
    """(key, files, bytes, token): a content address of all files of a key: path, sha256, byte_size.

    A tree of digests: a file falls into one of 4096 leaves by the hash of its path, a leaf digests its sorted files, the root its sorted leaves. So a key
    with very many files is digested by many tasks.
    """
    leaf = F.substring(F.sha2("path", 256), 1, 3)
    line = F.concat_ws(":", "path", "sha256")
    leaves = files.groupBy(key, leaf.alias("leaf")).agg(
        F.count("*").alias("n"), F.sum("byte_size").alias("b"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d")
    )
    root = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "leaf", "d"))), "\n"), 256)
    return leaves.groupBy(key).agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), root.alias("token"))


#: Files that one snapshot may have, as analyzers accept them.
SNAPSHOT_FILES = 500
_REVISION = ("status", "commitSha", "branch", "repositoryId", "worktreeId", "dirty", "isGit", "isLinkedWorktree")


def provider_tokens(files: DataFrame, projects: DataFrame, most: int = SNAPSHOT_FILES) -> DataFrame:
    """(project, files, token) of projects (project and columns of their revision, null or absent where unknown) with their files (project, path, sha256).

    The token is the sha256 of the canonical JSON of project, revision and files by path, in UTF-16 order. A project with more files than `most`, or with a path twice, is refused: its
    token is null. Files are counted first and only those of accepted projects meet in a row, so a row holds `most` pairs and a hot project costs one row for each task.
    """
    counts = files.groupBy("project").agg(F.count("*").alias("files"), F.count_distinct("path").alias("paths"))
    sized = projects.join(counts, "project", "left").withColumns({"files": F.coalesce("files", F.lit(0)), "paths": F.coalesce("paths", F.lit(0))})
    sound = F.col("files").between(0, most) & (F.col("files") == F.col("paths"))
    kept = files.join(sized.where(sound).select("project"), "project", "left_semi")
    pair = F.struct(texts.code_units(F.col("path")).alias("at"), F.array("path", "sha256").alias("pair"))
    lists = kept.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["pair"]).alias("pairs"))
    there = set(projects.columns)
    revision = F.struct(*[(F.col(c) if c in there else F.lit(None).cast("boolean" if c in _REVISION[5:] else "string")).alias(c) for c in _REVISION])
    quoted = F.coalesce(F.regexp_extract(F.to_json(F.array("project")), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    pairs = F.coalesce(F.to_json("pairs"), F.lit("[]"))
    text = F.concat(F.lit("["), quoted, F.lit(","), F.to_json(revision, {"ignoreNullFields": "false"}), F.lit(","), pairs, F.lit("]"))
    return sized.join(lists, "project", "left").select("project", "files", F.when(sound, F.sha2(text, 256)).alias("token"))


def rollup(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): counts over all keys and over each alone, in one aggregation with grouping sets; null stands for all."""
    sets = [[F.col(k) for k in keys], *[[F.col(k)] for k in keys]]
    return files.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.count("*").alias("n"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(verdict, keys): how many keys have one row and how many more."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("verdict")).agg(F.count("*").alias("keys"))


def unique_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key no other row has; keys are counted first, so a hot key costs one row for each task."""
    once = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n = 1").select(*key)
    return rows.join(once, key, "left_semi")


def inspected_census(entries: DataFrame, order: list[str], matches: int = 256, inspected: int = 20_000) -> DataFrame:
    """(name, matches, retained, verdict) of every name at once, as a census for each would see it. entries: name, cost (how many entries one takes: a statement and its declarations), order.

    Entries are inspected in order until `inspected` are spent over all of them; up to `matches` of a name are kept. A name with more, or one whose entries were not all inspected, is
    partial; else unique, ambiguous or not_found. The sum runs over sorted runs, not through one task.
    """
    rows = placed(entries, order, amount=F.col("cost")).withColumn("seen", F.col("running") - F.col("cost") < inspected)
    short = rows.agg(F.coalesce(F.max((~F.col("seen")).cast("int")), F.lit(0))).first()[0] == 1
    per = rows.groupBy("name").agg(F.sum(F.col("seen").cast("long")).alias("matches"))
    verdict = F.when(F.col("matches") > matches, "partial").when(F.lit(short), "partial").when(F.col("matches") == 1, "unique").when(F.col("matches") == 0, "not_found").otherwise("ambiguous")
    return per.select("name", "matches", F.least("matches", F.lit(matches)).alias("retained"), verdict.alias("verdict"))
