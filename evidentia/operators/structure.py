"""Project structure: declarations of .NET files, likely dependencies, roll-ups by project, layer and feature, and indexes of manifests and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import codes, texts
from . import search

#: A type declaration anywhere in a text, with at most one access word and one other modifier before it.
_TYPE = r"\b(?:public|internal|private|protected)?\s*(?:sealed|abstract|partial|static)?\s*(class|interface|record|struct|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"
_FIELD = r"\b(?:private|protected|internal|public)\s+readonly\s+([A-Za-z_][A-Za-z0-9_<>,.?]*)\s+[A-Za-z_][A-Za-z0-9_]*"
_NEW = r"\bnew\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("


def namespace(text: Column) -> Column:
    """The file's namespace, of the form that ends with a semicolon before the one with braces; empty without any."""
    form = r"\bnamespace\s+([A-Za-z_][A-Za-z0-9_.]*)\s*"
    scoped = F.regexp_extract(text, form + ";", 1)
    return F.when(scoped != "", scoped).otherwise(F.regexp_extract(text, form + r"\{", 1))


def symbols(files: DataFrame) -> DataFrame:
    """(id, path, name, kind, namespace, ord): types that .NET files (path, text) declare, in order; id is path#name."""
    found = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(_TYPE), k).alias(n) for k, n in ((1, "kind"), (2, "name"))])
    rows = files.select("path", namespace(F.col("text")).alias("namespace"), F.posexplode(found).alias("ord", "d"))
    return rows.select(F.concat_ws("#", "path", "d.name").alias("id"), "path", F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), "namespace", "ord")


def likely_dependencies(files: DataFrame) -> DataFrame:
    """(id, dep_name): types in the parameters of a symbol's constructors, in read-only fields and after `new` in its file, but ignored ones; once each.

    A constructor is the symbol's name with a parameter list, so its pattern differs by symbol. All symbols of a file are worked on in the file's own row: fields and creations are sought
    once for each file, no text is repeated or shuffled.
    """
    first = lambda p: F.get(F.split(F.trim(p), r"\s+"), F.lit(0))
    lists = lambda name: F.regexp_extract_all("text", F.concat(name, F.lit(r"\s*\(([^)]*)\)")), 1)
    parameters = lambda name: F.transform(F.flatten(F.transform(lists(name), lambda x: F.split(x, ","))), first)
    useful = lambda types: F.array_distinct(F.filter(F.transform(types, codes.clean_type), codes.useful_type))
    shared = F.concat(F.regexp_extract_all("text", F.lit(_FIELD), 1), F.regexp_extract_all("text", F.lit(_NEW), 1))
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(_TYPE), 2))
    rows = files.select("path", F.transform(named, lambda n: F.struct(n.alias("name"), useful(parameters(n)).alias("own"))).alias("symbols"), useful(shared).alias("shared"))
    rows = rows.select("path", "shared", F.explode("symbols").alias("s"))
    return rows.select(F.concat_ws("#", "path", "s.name").alias("id"), F.explode(F.array_union("s.own", "shared")).alias("dep_name"))


def with_features(files: DataFrame) -> DataFrame:
    """Files (path, text, project) with layer and feature; a file is named after its base name."""
    layer = texts.layer(F.col("project"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.cs$", "")
    return files.select("path", "project", layer.alias("layer"), codes.feature(F.col("project"), layer, F.col("path"), namespace(F.col("text")), name).alias("feature"))


def feature_rollup(files: DataFrame) -> DataFrame:
    """(feature, files, projects, layers): files (project, layer, feature) of each feature, the different projects by name and layers in their order."""
    once = files.where("feature is not null").groupBy("feature", "project", "layer").agg(F.count("*").alias("n"))
    agg = once.groupBy("feature").agg(F.sum("n").alias("files"), F.array_sort(F.collect_set("project")).alias("p"), F.collect_set("layer").alias("l"))
    return agg.select("feature", "files", F.array_join("p", ";").alias("projects"), F.array_join(codes.by_layer(F.col("l")), ";").alias("layers"))


def project_rollup(files: DataFrame) -> DataFrame:
    """(project, layer, files, features): files and different features of each project."""
    once = files.groupBy("project", "layer", "feature").agg(F.count("*").alias("n"))
    return once.groupBy("project", "layer").agg(F.sum("n").alias("files"), F.count("feature").alias("features"))


def overview(files: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: counts of files, projects, layers, features, dependencies and documents, and the ways in which the project can be divided."""
    a = files.agg(
        F.count("*").alias("files"), F.countDistinct("project").alias("projects"), F.countDistinct("layer").alias("layers"),
        F.countDistinct("feature").alias("features")
    )
    row = a.crossJoin(edges.agg(F.count("*").alias("dependencies"))).crossJoin(documents.agg(F.count("*").alias("documents")))  # one row each
    modes = F.concat(
        F.array(F.lit("all")), F.when(F.col("projects") > 1, F.array(F.lit("project"), F.lit("layer"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("features") > 1, F.array(F.lit("feature"))).otherwise(F.array().cast("array<string>"))
    )
    return row.withColumn("modes", F.array_join(modes, ";"))


def modules(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """(module, marker): folders with a module's marker file (*.csproj anywhere; package.json in a folder that a workspace pattern names, `!` excludes), without the root."""
    path = F.col("path")
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    wanted, barred = F.lit(False), F.lit(False)
    for p in patterns:
        hit = folder.rlike(search.glob_regex(p.removeprefix("!").removeprefix("./").rstrip("/")))
        wanted, barred = (wanted, barred | hit) if p.startswith("!") else (wanted | hit, barred)
    node = path.endswith("/package.json") & wanted & ~barred
    marker = F.when(path.endswith(".csproj"), "csproj").when(node, "workspace")
    return paths.select(folder.alias("module"), marker.alias("marker")).where("marker is not null and module <> ''").distinct()


def _depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def document_index(files: DataFrame, depth: int = 8, most: int = 200, largest: int = 128 << 10) -> tuple[DataFrame, DataFrame]:
    """Contextual documents (kind, path, title, lines, byte_size), the first `most` by path, and errors (code, path); files: path, text, byte_size."""
    found = files.withColumn("kind", codes.document_kind(F.col("path"))).where(F.col("kind").isNotNull() & (_depth(F.col("path")) <= depth))
    kept = found.where(F.col("byte_size") <= largest).orderBy("path").limit(most)
    shown = kept.select("kind", "path", texts.title(F.col("text"), F.col("path")).alias("title"), texts.line_count(F.col("text")).alias("lines"), "byte_size")
    return shown, found.where(F.col("byte_size") > largest).select(F.lit("document_too_large").alias("code"), "path")


def workspace_index(manifests: DataFrame, project: str, depth: int = 8, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Workspaces (id, path), the first `most` by path, and errors (code, path); manifests: path, id, project, as parsed from AGENT.md files, id null where that failed.

    A manifest of another project is an error; of manifests that share an id none counts.
    """
    near = manifests.where(_depth(F.col("path")) <= depth)
    same = F.count("*").over(W.partitionBy("id"))
    code = F.when(F.col("id").isNull(), "invalid_manifest").when(F.col("project").isNotNull() & (F.col("project") != project), "workspace_project_mismatch")
    judged = near.withColumn("code", code)
    good = judged.where("code is null").withColumn("n", same)
    errors = judged.where("code is not null").select("code", "path").unionByName(good.where("n > 1").select(F.lit("duplicate_workspace_id").alias("code"), "path"))
    return good.where("n = 1").orderBy("path").limit(most).select("id", "path"), errors


def issues(sources: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """(source, code, path): the first `most` issues, source by source in the order given and by path."""
    rows = None
    for rank, (name, df) in enumerate(sources.items()):
        one = df.select(F.lit(rank).alias("rank"), F.lit(name).alias("source"), "code", "path")
        rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy("rank", "path", "code").limit(most).select("source", "code", "path")
