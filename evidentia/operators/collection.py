"""Source collection over tables of files: project boundaries, bounded context sources, languages, scope reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import texts
from . import search

# Fixed values of discovery: files that mark a project's folder, and the type that each speaks for, the strongest first.
MARKERS = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "requirements.txt", "setup.py", "tsconfig.json")
TYPES = (
    ("dotnet", r"\.(?:sln|slnx|csproj)$"), ("typescript", r"^tsconfig\.json$"), ("nodejs", r"^package\.json$"),
    ("python", r"^(?:pyproject\.toml|requirements\.txt|setup\.py)$"), ("go", r"^go\.mod$"), ("rust", r"^Cargo\.toml$")
)
#: Limits of a collection: files, bytes of a file, of all, and folders deep. Fixed values.
FILES, FILE_BYTES, ALL_BYTES, DEPTH = 2000, 131_072, 4 << 20, 12


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def project_type(names: Column) -> Column:
    """Type of a folder by the names of its files: the first rule that fits; unknown without one."""
    def one(pattern: str) -> Column:
        return F.exists(names, lambda n: n.rlike(pattern))

    out = F.lit("unknown")
    for kind, pattern in reversed(TYPES):
        out = F.when(one(pattern), kind).otherwise(out)
    return out


def boundaries(paths: DataFrame, depth: int = 6, limit: int = 1000, registered: DataFrame | None = None) -> DataFrame:
    """(folder, type, signals): folders below the root that hold a project's markers and lie in no other such folder; ignored folders and registered ones (folder) don't count.

    The outermost folder wins by an anti join on the folders above each, so no tree is walked.
    """
    name = F.element_at(F.split("path", "/"), -1)
    marked = paths.where(texts.path_allowed(F.col("path")) & (name.isin(*MARKERS) | name.rlike(r"\.(?:sln|slnx|csproj)$")))
    found = marked.groupBy(_folder(F.col("path")).alias("folder")).agg(F.array_sort(F.collect_set(name)).alias("signals"))  # a folder's markers
    found = found.where((F.col("folder") != "") & (F.size(F.split("folder", "/")) <= depth))
    above = found.select(F.col("folder").alias("inner"), F.explode(search.prefixes(F.col("folder"))).alias("folder")).where("inner <> folder")
    nested = above.join(found.select("folder"), "folder", "left_semi").select(F.col("inner").alias("folder")).distinct()
    rows = found.join(nested, "folder", "left_anti")
    if registered is not None:
        rows = rows.join(registered.select("folder"), "folder", "left_anti")
    return rows.orderBy("folder").limit(limit).select("folder", project_type(F.col("signals")).alias("type"), F.array_join("signals", ";").alias("signals"))


def normalized(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose path is allowed, occurs once and whose size is that of its text; and issues (code, path) of the others."""
    n = F.count("*").over(W.partitionBy("path"))
    code = F.when(~texts.path_allowed(F.col("path")), "invalid_path").when(n > 1, "duplicate_path").when(F.col("byte_size") != F.octet_length("text"), "size_mismatch")
    rows = files.withColumn("code", code)
    return rows.where("code is null").drop("code"), rows.where("code is not null").select("code", "path").distinct()


def collected(files: DataFrame, most_files: int = FILES, most_bytes: int = FILE_BYTES, all_bytes: int = ALL_BYTES, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """The context sources among files (path, text, byte_size), and diagnostics (code, files).

    Paths that aren't allowed and texts with NUL are passed over. Files that are too deep or too large are counted; of the rest the first `most_files` by path are taken while their
    running size stays within `all_bytes`; what comes after is counted as limited. Only that many files meet in one task.
    """
    deep, large = F.size(F.split("path", "/")) - 1 > depth, F.col("byte_size") > most_bytes
    fit = files.where(texts.path_allowed(F.col("path")) & ~F.coalesce(F.col("text").contains("\0"), F.lit(False)))
    judged = fit.withColumn("code", F.when(deep, "depth_limit").when(large, "file_too_large"))
    sound = judged.where("code is null").drop("code")
    head = sound.orderBy("path").limit(most_files)
    kept = head.withColumn(
        "running", F.sum("byte_size").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, 0))
    ).where(F.col("running") <= all_bytes).drop("running")
    left = sound.select("path").join(kept.select("path"), "path", "left_anti").agg(F.count("*").alias("files")).select(F.lit("source_limit").alias("code"), "files")
    counts = judged.where("code is not null").groupBy("code").agg(F.count("*").alias("files"))
    return kept, counts.unionByName(left.where("files > 0"))


def languages(files: DataFrame) -> DataFrame:
    """(language, files): languages of the files' extensions."""
    return files.select(texts.language(F.col("path")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


def by_extension(files: DataFrame) -> DataFrame:
    """(project, extension, files, bytes) of files (project, path, byte_size); no extension is ''."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy("project", extension.alias("extension")).agg(F.count("*").alias("files"), F.sum("byte_size").alias("bytes"))


def scope_report(matches: DataFrame, wanted: DataFrame, most: int = 500, reasons: int = 8) -> tuple[DataFrame, DataFrame]:
    """(workspace, paths, shown, truncated) of the first `most` workspaces that match wanted paths, each with its first paths; and the wanted paths that none matches (path)."""
    hits = matches.join(wanted.select("path").distinct(), "path", "left_semi").distinct()
    ranked = hits.withColumn("nth", F.row_number().over(W.partitionBy("workspace").orderBy("path")))
    rows = ranked.groupBy("workspace").agg(
        F.count("*").alias("paths"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= reasons, F.col("path")))), ";").alias("shown")
    )
    return rows.orderBy("workspace").limit(most).withColumn("truncated", F.col("paths") > reasons), wanted.select("path").distinct().join(
        hits.select("path"), "path", "left_anti"
    )
