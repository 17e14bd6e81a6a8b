"""Evidence tables derived from the star-schema tables, as DataFrames and as the SQL of the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key over all cores: a narrow table of one small file is else one task, in which all texts that are made of its rows would be worked on."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols; a file is a brand and type."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"),
        F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_brand").alias("feature"), F.col("p_type").alias("layer")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part depends on the parts of the next line of its order; the return flag gives the relation. An order has a few lines, so its pairs are made within one row."""
    relation = F.when(F.col("l_returnflag") == "R", "imports").when(F.col("l_returnflag") == "A", "references").otherwise("uses")
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), relation.alias("relation"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("x"))
    after = lambda a: F.transform(
        F.filter("x", lambda b: b["n"] == a["n"] + 1),
        lambda b: F.struct(a["part"].alias("src"), b["part"].alias("dst"), a["relation"].alias("relation"))
    )
    return orders.select(F.inline(F.flatten(F.transform("x", after)))).distinct()


NODES = "nodes as (select p_partkey as id, p_name as label, p_type as kind, p_brand || '/' || p_type as file, p_brand as feature, p_type as layer from part)"
EDGES = """edges as (select distinct a.l_partkey as src, b.l_partkey as dst,
  case a.l_returnflag when 'R' then 'imports' when 'A' then 'references' else 'uses' end as relation
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"""
GRAPH = f"with recursive {NODES}, {EDGES}"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: path, text, byte_size, sha256."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"),
        F.octet_length(text).cast("long").alias("byte_size"), F.sha2(text, 256).alias("sha256")
    )


FILES = "files as (select source || '/' || doc_id || '.md' as path, coalesce(text, '') as text, strlen(coalesce(text, ''))::bigint as byte_size, sha256(coalesce(text, '')) as sha256 from documents)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as capture records: profile = type, sha = user, run = day, flag = value over 100; path entries from the id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("runId"), F.col("event_type").alias("profile"), F.concat(F.lit("u"), F.col("user_id")).alias("sha"),
        (F.col("value") > 100).alias("nexusTools"), F.array(F.concat(F.lit("w/"), F.col("user_id"))).alias("writePaths"),
        F.when(F.col("value") > 50, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("watchPaths"), "event_id"
    )


LOG = """log as (select strftime(ts, '%Y-%m-%d') as runId, event_type as profile, 'u' || user_id as sha, value > 100 as flag,
  ['w/' || user_id] as writePaths, case when value > 50 then ['a', 'b'] else ['a'] end as watchPaths, event_id from events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as task attempts: task, run, receipt, completion, claim, created, done."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task"), F.col("l_linenumber").cast("long").alias("run"), F.unix_timestamp("l_shipdate").alias("at"),
        "l_returnflag", "l_linestatus", "l_quantity"
    )


def dotnet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as .NET files: path, text, project. A third lie in a folder of architecture only, half of those in a namespace of their own."""
    k = F.col("p_partkey")
    at = lambda n, m: (k * n + m) % 200  # noqa: E731  a part that every table has
    kind = lambda x: F.element_at(F.array(*map(F.lit, ("Service", "Controller", "Repository", "Dto", "Handler"))), (x % 5 + 1).cast("int"))
    named = lambda x: F.concat(F.lit("Part"), x.cast("string"), kind(x))
    project = F.concat(F.lit("Shop."), F.element_at(F.array(*map(F.lit, ("Api", "Application", "Domain", "Infrastructure"))), (k % 4 + 1).cast("int")))
    folder = F.when(k % 3 == 0, "Services").otherwise(F.regexp_replace("p_brand", "#", ""))
    space = F.concat(project, F.when(k % 6 == 0, ".Core").when(k % 3 == 0, ".Billing").otherwise(".Models"))
    text = F.concat(
        F.lit("namespace "), space, F.when(k % 2 == 0, F.lit(";\n")).otherwise(F.lit("\n{\n")), F.lit("[Serializable] public sealed class "), named(k),
        F.lit(" {\n  private readonly List<"), named(at(7, 3)), F.lit("> items;\n  public "), named(k), F.lit("("), named(at(11, 5)), F.lit(" a, string b, Guid? c) { var x = new "),
        named(at(13, 1)), F.lit("(a); }\n}\nenum Kind"), k.cast("string"), F.lit(" { A }\n"),
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select(
        F.concat_ws("/", F.lit("src"), project, folder, F.concat(named(k), F.lit(".cs"))).alias("path"), text.alias("text"), project.alias("project")
    )


DOTNET = """dn as (select p_partkey as k, 'Part' || p_partkey || ['Service', 'Controller', 'Repository', 'Dto', 'Handler'][(p_partkey % 5 + 1)::int] as name,
  'Shop.' || ['Api', 'Application', 'Domain', 'Infrastructure'][(p_partkey % 4 + 1)::int] as project, replace(p_brand, '#', '') as brand from part),
dnf as (select *, 'src/' || project || '/' || case when k % 3 = 0 then 'Services' else brand end || '/' || name || '.cs' as path,
  case when project = 'Shop.Api' then 'API' else split_part(project, '.', 2) end as layer,
  case when k % 3 <> 0 then brand when k % 6 = 0 then regexp_replace(name, '(Service|Controller|Repository|Dto|Handler)$', '') else 'Billing' end as feature from dn)"""


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as TypeScript files: path, text. Every tenth is a pure barrel that re-exports its neighbour and the next barrel of its fifty."""
    k = F.col("p_partkey")
    at = lambda x: x.cast("string")
    barrel = F.concat(F.lit("// all\nexport { Sym"), at(k + 1), F.lit(" as Sym"), at(k + 1), F.lit(" , Sym"), at(k + 2), F.lit(" as Two"), at(k + 2), F.lit(" } from './m"), at(k + 1), F.lit("';\nexport { Sym"), at(k + 2), F.lit(" as Two"), at(k + 2), F.lit(" } from \"./m"), at(k + 2), F.lit("\";\n"),
                      F.when(k % 50 != 40, F.concat(F.lit("export * from './m"), at(k + 10), F.lit("';\n"))).otherwise(F.lit("")))
    group = k - k % 10
    plain = F.concat(
        F.lit("import type { Sym"), at(group + 1), F.lit(" as First, Sym"), at(group + 11), F.lit(", Two"), at(group + 2), F.lit(" } from './m"),
        at(group), F.lit("';\nimport Main, { Sym"), at(group + k % 9 + 1), F.lit(" } from './m"), at(group + k % 9 + 1),
        F.lit(".ts';\nimport { Sym7 } from '@lost/pkg';\nexport default class Sym"), at(k), F.lit(" {}\n")
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        F.concat(F.lit("src/m"), at(k), F.lit(".ts")).alias("path"), F.when(k % 10 == 0, barrel).otherwise(plain).alias("text"), k.alias("k")
    )
