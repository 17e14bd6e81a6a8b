"""Search, lookup and path-scope queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from . import lens
from .lens import FILES, NODES
from .registered import query


@query(f"with {NODES} select id, label, case when lower(label) = 'red' then 0 when lower(label) like 'red%' then 1 else 2 end as tier from nodes where lower(label) like '%red%' order by tier, id limit 12")
def search_tiered(spark, d):
    return search.tiered(lens.nodes(spark, d), "Red")


@query(f"with {NODES} select id, label, kind, file from nodes where lower(label) like '%promo%' or lower(kind) like '%promo%' or lower(feature) like '%promo%' or lower(file) like '%promo%' order by id limit 20")
def search_multi_field(spark, d):
    return search.multi_field(lens.nodes(spark, d), "promo")


@query(f"with {NODES} select id, label, file from nodes where label = 'red widget' order by id limit 64")
def symbol_location(spark, d):
    return search.located(lens.nodes(spark, d), "red widget")


@query(f"with {NODES} select label, case when count(*) = 1 then 'found' else 'ambiguous' end as verdict from nodes group by label")
def lookup_unique(spark, d):
    return search.lookup(lens.nodes(spark, d), "label")


def _places(spark, d):
    c = lens.table(spark, d, "customer").select(
        F.concat_ws("/", F.lit("r"), (F.col("c_nationkey") % 5).cast("string"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("path")
    )
    n = lens.table(spark, d, "nation")
    deep = n.select(
        F.concat_ws("/", F.lit("r"), (F.col("n_nationkey") % 5).cast("string"), F.col("n_nationkey").cast("string")).alias("folder"),
        F.col("n_name").alias("project")
    )
    top = lens.table(spark, d, "region").select(F.concat_ws("/", F.lit("r"), F.col("r_regionkey").cast("string")).alias("folder"), F.col("r_name").alias("project"))
    return c, deep.unionByName(top)


PLACES = "c as (select 'r/' || (c_nationkey % 5) || '/' || c_nationkey || '/' || c_custkey as path from customer), f as (select 'r/' || (n_nationkey % 5) || '/' || n_nationkey as folder, n_name as project from nation union all select 'r/' || r_regionkey, r_name from region)"


@query(f"with {PLACES} select path, max_by(project, length(folder)) as project from c join f on path = folder or starts_with(path, folder || '/') group by path")
def longest_prefix(spark, d):
    return search.longest_prefix(*_places(spark, d))


@query(f"with {PLACES} select a.folder as \"outer\", b.folder as \"inner\", b.folder[length(a.folder) + 2 :] as relative from f a join f b on starts_with(b.folder, a.folder || '/')")
def nested_paths(spark, d):
    return search.nested(_places(spark, d)[1])


SPACES = [
    {"id": "w1", "folder": "src1", "include": ["src1/**", "src2/*.md"], "exclude": ["src1/1*.md"]}, {"id": "w2", "folder": "src3"},
    {"id": "w3", "folder": ".", "include": ["**/7?.md"]}
]


@query(f"""with {FILES} select path, 'w1' as workspace from files where (path = 'src1' or path like 'src1/%' or (path like 'src2/%.md')) and not path like 'src1/1%.md'
union all select path, 'w2' from files where path like 'src3/%' union all select path, 'w3' from files where path like '%/7_.md'""")
def scope_glob(spark, d):
    return search.scope_matches(lens.files(spark, d), SPACES)
