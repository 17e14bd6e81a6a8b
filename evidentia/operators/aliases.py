"""Path aliases of TypeScript configurations: patterns with one wildcard as rows, joined by their literal beginnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract
from .durable import counted, cut

_COMMENT = r"(\"(?:\\.|[^\"\\])*+\")|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/"
_TRAILING = r"(\"(?:\\.|[^\"\\])*+\")|,(?=\s*[}\]])"
_CONFIG = "struct<extends:string,compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>"


def plain_json(text: Column) -> Column:
    """JSON without the comments and last commas that configurations may have; strings stay as they are."""
    return F.regexp_replace(F.regexp_replace(text, _COMMENT, "$1"), _TRAILING, "$1")


def normal(path: Column) -> Column:
    """A path without '.', empty and '..' parts; '..' at the top goes nowhere."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    return F.aggregate(parts, none, step, lambda a: F.array_join(a, "/"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def configurations(configs: DataFrame, rounds: int = 64) -> DataFrame:
    """(path, base, paths, paths_base, issue): what each configuration (path, text) says about names, with what it extends.

    `paths` and `baseUrl` come from the nearest configuration of the chain that has them, each relative to the one that declares it. All chains go up one step a round, together; a chain that
    names a missing file, is not JSON or comes back to itself is an issue, and keeps what could be read.
    """
    read = configs.select("path", F.from_json(plain_json(F.col("text")), _CONFIG, {"mode": "PERMISSIVE"}).alias("c"), plain_json(F.col("text")).rlike(r"^\s*\{").alias("sound"))
    up = F.col("c.extends")
    target = normal(F.concat(_folder(F.col("path")), F.lit("/"), F.when(up.endswith(".json"), up).otherwise(F.concat(up, F.lit(".json")))))
    base = normal(F.concat(_folder(F.col("path")), F.lit("/"), F.regexp_replace("c.compilerOptions.baseUrl", r"\\", "/")))
    own = cut(read.select("path", F.when(up.isNotNull(), target).alias("up"), base.alias("base"), F.col("c.compilerOptions.paths").alias("paths"), F.coalesce("base", _folder(F.col("path"))).alias("paths_base"), (F.col("c").isNull() | ~F.col("sound")).alias("issue")))
    now = own.withColumn("seen", F.array("path"))
    for _ in range(rounds):
        todo, n = counted(now.where("up is not null"))
        if not n:
            break
        above = own.select(F.col("path").alias("up"), F.col("up").alias("up2"), F.col("base").alias("base2"), F.col("paths").alias("p2"), F.col("paths_base").alias("pb2"), F.col("issue").alias("i2"), F.lit(True).alias("there"))
        loop = F.array_contains("seen", F.col("up"))
        went = todo.join(above, "up", "left").select(
            "path", F.when(~loop & F.col("there"), F.col("up2")).alias("up"), F.coalesce("base", F.when(~loop, F.col("base2"))).alias("base"),
            F.coalesce("paths", F.when(~loop, F.col("p2"))).alias("paths"), F.when(F.col("paths").isNotNull(), F.col("paths_base")).when(~loop, F.col("pb2")).otherwise(F.col("paths_base")).alias("paths_base"),
            (F.col("issue") | loop | F.col("there").isNull() | F.coalesce("i2", F.lit(False))).alias("issue"), F.array_append("seen", F.col("up")).alias("seen")
        )
        now = cut(now.where("up is null").unionByName(went))
    return now.select("path", "base", "paths", "paths_base", "issue")


def alias_rows(configured: DataFrame) -> DataFrame:
    """(config, pattern, head, tail, star, n, target): a row for each pattern and target. head and tail are what stands before and after the wildcard."""
    rows = configured.select(F.col("path").alias("config"), "paths_base", F.explode("paths").alias("pattern", "targets"))
    rows = rows.select("config", "paths_base", "pattern", F.posexplode("targets").alias("n", "target"))
    star = F.col("pattern").contains("*")
    return rows.where("length(regexp_replace(pattern, '[^*]', '')) <= 1").select(
        "config", "pattern", F.substring_index("pattern", "*", 1).alias("head"), F.when(star, F.substring_index("pattern", "*", -1)).otherwise("").alias("tail"), star.alias("star"), "n",
        F.concat("paths_base", F.lit("/"), "target").alias("target")
    )


def resolved(imported: DataFrame, files: DataFrame, configured: DataFrame) -> DataFrame:
    """(config, path, specifier, pattern, target): imports (config, path, specifier) by name, resolved by the patterns of their configuration; target null where no file answers.

    The exact pattern wins, then the one with the longest beginning; only its targets are tried, in order. A specifier that no pattern takes is tried below the base. Relative ones are left to
    extract.resolved. Patterns meet specifiers by (configuration, beginning), for the lengths that beginnings have: no specifier meets all patterns.
    """
    aliases = cut(alias_rows(configured))
    lengths = sorted(r[0] for r in aliases.select(F.length("head")).distinct().collect())  # lengths of names: few
    named = imported.where(~F.col("specifier").startswith(".") & ~F.col("specifier").startswith("/")).select("config", "path", "specifier").distinct()
    once = named.select("config", "specifier").distinct()
    heads = once.select("config", "specifier", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")).alias("k"))
    heads = heads.where(F.length("specifier") >= F.col("k")).withColumn("head", F.expr("left(specifier, k)"))
    hit = heads.join(aliases.select("config", "pattern", "head", "tail", "star").distinct(), ["config", "head"])
    fits = F.when(F.col("star"), F.col("specifier").endswith(F.col("tail")) & (F.length("specifier") >= F.length("head") + F.length("tail"))).otherwise(F.col("specifier") == F.col("head"))
    best = hit.where(fits).groupBy("config", "specifier").agg(F.max_by(F.struct("pattern", "head", "tail"), F.struct(~F.col("star"), F.length("head"), F.col("pattern"))).alias("b"))
    middle = F.expr("substring(specifier, length(b.head) + 1, length(specifier) - length(b.head) - length(b.tail))")
    tried = best.join(aliases.select("config", F.col("pattern").alias("p"), "n", "target"), ["config"]).where("b.pattern = p")
    tried = tried.select("config", "specifier", F.col("p").alias("pattern"), "n", F.replace("target", F.lit("*"), middle).alias("target"))
    based = once.join(best.select("config", "specifier"), ["config", "specifier"], "left_anti").join(configured.where("base is not null").select(F.col("path").alias("config"), "base"), "config")
    tried = tried.unionByName(based.select("config", "specifier", F.lit(None).cast("string").alias("pattern"), F.lit(0).alias("n"), F.concat("base", F.lit("/"), "specifier").alias("target")))
    tails = F.array(*map(F.lit, extract.TAILS))
    candidates = tried.withColumn("target", normal(F.col("target"))).select("config", "specifier", "pattern", "n", F.posexplode(tails).alias("m", "tail"), "target")
    candidates = candidates.withColumn("target", F.concat("target", "tail"))
    there = candidates.join(files.select(F.col("path").alias("target")).distinct(), "target").groupBy("config", "specifier").agg(F.min_by("target", F.struct("n", "m")).alias("target"))
    taken = tried.groupBy("config", "specifier").agg(F.max("pattern").alias("pattern"))
    return named.join(taken, ["config", "specifier"], "left").join(there, ["config", "specifier"], "left").select("config", "path", "specifier", "pattern", "target")
