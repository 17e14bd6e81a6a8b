"""Imports, re-exports and barrels of TypeScript and JavaScript files, from a lexer's view of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from . import extract, scoped
from .durable import FRONTIER_ROWS, counted, cut

_IMPORT = r"(?:^|[\n;]|\*/)[ \t]*import\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:(\{[^}]*\})|\*\s*as\s+[\w$]+)?\s*from\s*['\"]([^'\"]+)['\"]"
_EXPORT = r"(?:^|[\n;]|\*/)[ \t]*export\s+(?:type\s+)?(?:(\{[^}]*\})|(\*)(?:\s*as\s+([\w$]+))?)\s*from\s*['\"]([^'\"]+)['\"]"
_CODE = r"(?i)\.(?:tsx?|jsx?)$"
STAR = "*"


def _code(files: DataFrame) -> DataFrame:
    """(path, text) of TypeScript and JavaScript files without what comments, templates and strings hold, but for the names of modules."""
    return files.where(F.col("path").rlike(_CODE)).select("path", scoped.masked(F.col("text")).alias("text"))


def _all(pattern: str, groups: dict[str, int]) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), k).alias(n) for n, k in groups.items()])


def _named(braces: Column) -> Column:
    """Structs (name, alias) of `{ a, b as c, type d }`."""
    items = F.filter(
        F.transform(F.split(F.regexp_replace(braces, r"[{}]", ""), ","), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "^type ", "")),
        lambda x: x != ""
    )
    part = lambda x, k: F.try_element_at(F.split(x, " as "), F.lit(k))
    return F.transform(items, lambda x: F.struct(part(x, 1).alias("name"), F.coalesce(part(x, 2), part(x, 1)).alias("alias")))


_HOOK = "^use[A-Z0-9_]"


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, category, layer, feature, exported, is_default): top-level declarations of TypeScript and JavaScript files (path, text), one row for each file and name.

    Variables count only if their name is that of a component, hook or provider. Hooks and components are kinds of their own. What stands in brackets, comments, strings or
    templates is no top-level declaration.
    """
    rows = scoped.declarations(files.where(F.col("path").rlike(_CODE))).withColumnRenamed("at", "ord")
    name, variable = F.col("name"), F.col("word").isin("const", "let", "var")
    rows = rows.where(~variable | name.rlike("^[A-Z][A-Za-z0-9_]*$") | name.rlike(_HOOK) | name.endswith("Provider"))
    first = rows.groupBy("path", "name").agg(F.min(F.struct("ord", "word", "exported", "is_default")).alias("f"))
    rows = first.select("path", "name", "f.word", "f.exported", "f.is_default")
    callable_ = F.col("word").isin("function", "const", "let", "var")
    kind = F.when(callable_ & name.rlike(_HOOK), "hook").when(callable_ & name.rlike("^[A-Z]"), "component").when(callable_, "function").otherwise(F.col("word"))
    category = F.when(name.rlike(_HOOK), "hook")
    for ending in ("Provider", "Context", "Service"):
        category = category.when(name.endswith(ending), ending.lower())
    category = category.when(name.rlike("^[A-Z]") | name.endswith("Component"), "component").otherwise("symbol")
    return rows.select(
        "path", "name", kind.alias("kind"), category.alias("category"), codes.folder_layer(F.col("path")).alias("layer"),
        codes.folder_feature(F.col("path")).alias("feature"), "exported", "is_default"
    )


def import_bindings(files: DataFrame) -> DataFrame:
    """(path, specifier, name, alias): names that a file (path, text) imports; a default import has the name default."""
    rows = _code(files).select("path", F.explode(_all(_IMPORT, {"d": 1, "b": 2, "specifier": 3})).alias("m"))
    default = F.when(
        F.col("m.d") != "", F.array(F.struct(F.lit("default").alias("name"), F.col("m.d").alias("alias")))
    ).otherwise(F.array().cast("array<struct<name:string,alias:string>>"))
    return rows.select(
        "path", F.col("m.specifier").alias("specifier"), F.explode(F.concat(_named(F.col("m.b")), default)).alias("x")
    ).select("path", "specifier", "x.name", "x.alias")


def re_exports(files: DataFrame) -> DataFrame:
    """(path, specifier, name, alias): names that a file exports from another; `export *` has the name and alias *, `export * as x` the alias x."""
    rows = _code(files).select("path", F.explode(_all(_EXPORT, {"b": 1, "star": 2, "ns": 3, "specifier": 4})).alias("m"))
    star = F.array(F.struct(F.lit(STAR).alias("name"), F.when(F.col("m.ns") != "", F.col("m.ns")).otherwise(STAR).alias("alias")))
    return rows.select(
        "path", F.col("m.specifier").alias("specifier"), F.explode(F.when(F.col("m.star") != "", star).otherwise(_named(F.col("m.b")))).alias("x")
    ).select("path", "specifier", "x.name", "x.alias")


def import_sites(files: DataFrame) -> DataFrame:
    """(path, specifier, at): each specifier that a file (path, text) imports or re-exports from, with the offset of its first character."""
    code = _code(files)
    rows = [scoped.found(code, pattern, {"specifier": group}) for pattern, group in ((_IMPORT, 3), (_EXPORT, 4))]
    return rows[0].unionByName(rows[1]).select("path", "specifier", (F.col("stop") - 1 - F.length("specifier")).alias("at"))


def located_edges(files: DataFrame) -> DataFrame:
    """(src, dst, relation, location): files that import or re-export from another file, once for each place where they do."""
    sites = cut(_resolved(cut(import_sites(files)), files))
    placed = scoped.located(sites, files)
    location = F.struct("path", "line", "column").alias("location")
    return cut(placed.select(F.col("path").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("relation"), location))


def pure_barrels(files: DataFrame) -> DataFrame:
    """(path): files of which nothing is left but blanks and comments once their re-exports are taken out, and that have one."""
    bare = F.concat(F.lit("\n"), F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", ""))
    rest = F.regexp_replace(F.regexp_replace(bare, _EXPORT + ";?", ""), r"[\s;]+", " ")
    return files.where(F.col("path").rlike(_CODE) & bare.rlike(_EXPORT) & (F.trim(rest) == "")).select("path")


def _resolved(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with the file that their specifier names (target), without those that name none."""
    known = extract.resolved(rows.select("path", "specifier").distinct(), files).where("target is not null and target <> path")
    return rows.join(known.hint("merge"), ["path", "specifier"])


def export_table(files: DataFrame, declared: DataFrame, rounds: int = 64) -> DataFrame:
    """(path, name, origin, label): what each file exports and where that is declared, over re-exports, aliases and `export *` chains and cycles.

    declared: (path, name) of the exports that files declare themselves. A fixpoint: each round passes the names found in the last one to the files that re-export
    them; names only ever grow, so it ends. `export *` passes no default.
    """
    table = cut(declared.select("path", "name", F.col("path").alias("origin"), F.col("name").alias("label")).distinct())
    steps = cut(_resolved(re_exports(files), files).where("not (name = '*' and alias <> '*')").select(
        "path", "target", F.col("name").alias("wanted"), "alias"
    ).distinct())
    fresh, n = table, FRONTIER_ROWS + 1
    for _ in range(rounds):
        passed = (steps if n <= FRONTIER_ROWS else steps.hint("merge")).join(
            fresh.select(F.col("path").alias("target"), "name", "origin", "label"), "target"
        ).where("wanted = name or (wanted = '*' and name <> 'default')")
        passed = passed.select("path", F.when(F.col("wanted") == STAR, F.col("name")).otherwise(F.col("alias")).alias("name"), "origin", "label").distinct()
        fresh, n = counted(passed.join(table.hint("merge"), ["path", "name", "origin", "label"], "left_anti"))
        if not n:
            break
        table = cut(table.unionByName(fresh))
    return table


def import_edges(files: DataFrame, declared: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(src_file, dst_file, label, verdict): imported names and where they are declared: resolved, or ambiguous if several files declare the name.

    Names of a specifier that no file answers to are looked up among all declarations of that name (by_name), as nothing better is known. Names found nowhere are left out.
    """
    table = export_table(files, declared) if table is None else table
    wanted = cut(import_bindings(files))
    there = cut(_resolved(wanted, files))
    found = there.select("path", "target", "name").distinct().join(table.select(F.col("path").alias("target"), "name", "origin", "label").hint("merge"), ["target", "name"])
    origins = found.groupBy("path", "target", "name").agg(F.count("*").alias("n"))
    rows = found.join(origins.hint("merge"), ["path", "target", "name"]).select(
        F.col("path").alias("src_file"), F.col("origin").alias("dst_file"), "label",
        F.when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("verdict")
    )
    loose = wanted.join(
        there.select("path", "specifier").distinct().hint("merge"), ["path", "specifier"], "left_anti"
    ).where("name <> 'default'").select("path", F.col("name").alias("label")).distinct()
    named = loose.join(
        declared.select(F.col("path").alias("dst_file"), F.col("name").alias("label")).hint("merge"), "label"
    ).select(F.col("path").alias("src_file"), "dst_file", "label", F.lit("by_name").alias("verdict"))
    return rows.unionByName(named).where("src_file <> dst_file").distinct()


def barrel_edges(files: DataFrame) -> DataFrame:
    """(src_file, dst_file): files that import or re-export from a pure barrel, which stands for itself in the graph."""
    both = import_bindings(files).select("path", "specifier").unionByName(re_exports(files).select("path", "specifier")).distinct()
    return _resolved(cut(both), files).join(pure_barrels(files).withColumnRenamed("path", "target").hint("merge"), "target").select(
        F.col("path").alias("src_file"), F.col("target").alias("dst_file")
    ).distinct()
