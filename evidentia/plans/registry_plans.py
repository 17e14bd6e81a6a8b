"""Registry, audit and tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry
from . import lens
from .registered import query


def _registries(spark, d):
    s = lens.table(spark, d, "supplier").select(
        F.concat(F.lit("n"), F.col("s_suppkey")).alias("name"),
        F.concat_ws("/", F.lit("r"), "s_nationkey", F.floor("s_acctbal").cast("string")).alias("path")
    )
    c = lens.table(spark, d, "customer").select(
        F.concat(F.lit("n"), F.col("c_custkey")).alias("name"),
        F.concat_ws("/", F.lit("r"), "c_nationkey", F.floor("c_acctbal").cast("string")).alias("path"), F.col("c_custkey").alias("ord")
    )
    return s, c


REG = "m as (select 'n' || s_suppkey as name, 'r/' || s_nationkey || '/' || floor(s_acctbal)::bigint as path from supplier), k as (select 'n' || c_custkey as name, 'r/' || c_nationkey || '/' || floor(c_acctbal)::bigint as path, c_custkey as ord from customer)"


@query(f"with {REG}, f as (select *, row_number() over (partition by path order by ord) as r from k where name not in (select name from m) and path not in (select path from m)) select name, path, 'manual' as source from m union all select name, path, 'discovered' from f where r = 1")
def registry_merge(spark, d):
    return registry.merge(*_registries(spark, d))


@query(f"with {REG}, h as (select path from k where ord < 700) select path, name, case when path in (select path from m) or name in (select name from m) then 'already_registered' when path in (select path from h) then 'updated' else 'registered' end as status from k")
def registry_upsert(spark, d):
    m, k = _registries(spark, d)
    return registry.upsert(m, k.where("ord < 700"), k)


@query(f"with {REG}, a as (select name, path, null as project_id from m union all select name, path, 'p' || (ord // 2) from k) select 'name_path' as \"check\", count(*) as conflicts from (select name from a group by 1 having count(distinct path) > 1) union all select 'path_name', count(*) from (select path from a group by 1 having count(distinct name) > 1) union all select 'project_id_path', count(*) from (select project_id from a where project_id is not null group by 1 having count(distinct path) > 1)")
def registry_readiness(spark, d):
    m, k = _registries(spark, d)
    rows = m.withColumn("project_id", F.lit(None).cast("string")).unionByName(k.select(
        "name", "path", F.concat(F.lit("p"), F.floor(F.col("ord") / 2)).alias("project_id")
    ))
    return registry.readiness(rows)


@query("""select o_orderkey as task, case when o_orderstatus = 'P' then 'active_outcome_missing' when o_orderpriority = '5-LOW' then 'origin_session_not_recorded' when o_custkey in (select user_id from events) then 'observed' else 'missing_from_session_snapshot' end as status from orders""")
def session_link(spark, d):
    o = lens.table(spark, d, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("run"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("session")
    )
    return registry.session_link(rows, lens.table(spark, d, "events").select(F.col("user_id").alias("id")))


@query("select distinct l_partkey as path, case when l_partkey in (select l_partkey from lineitem where l_returnflag = 'R' and l_linestatus = 'O') then 'in_write' else 'outside_write' end as verdict from lineitem where l_quantity > 48")
def diff_audit(spark, d):
    li = lens.table(spark, d, "lineitem").withColumn("path", F.col("l_partkey"))
    return registry.diff_audit(li.where("l_quantity > 48"), li.where("l_returnflag = 'R' and l_linestatus = 'O'"))


@query("""with t as (select doc_id as path, sha256(coalesce(text, '')) as hash from documents), l as (select doc_id as path, sha256(coalesce(text, '')) as hash from documents where lang <> 'es'), s as (select doc_id as path, sha256(case when n_chars > 4000 then 'x' else coalesce(text, '') end) as hash from documents),
u as (select path, count(distinct side) as sides, min(hash) as a, max(hash) as b from (select *, 1 as side from t union all select *, 2 from l union all select *, 3 from s) group by path)
select case when sides < 3 then 'missing' when a = b then 'equal' else 'changed' end as state, count(*) as paths from u group by 1""")
def tree_match(spark, d):
    rows = lens.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"), "lang", "n_chars")
    of = lambda x, text: x.select("path", F.sha2(text, 256).alias("hash"))
    return registry.tree_match(
        of(rows, F.col("text")), of(rows.where("lang <> 'es'"), F.col("text")),
        of(rows, F.when(F.col("n_chars") > 4000, "x").otherwise(F.col("text")))
    )


@query("select p as path, 'archive/old' || p[5:] as moved from (select source || '/' || doc_id as p from documents) where p like 'src3/%'")
def prefix_rewrite(spark, d):
    rows = lens.table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return registry.move(rows, "src3", "archive/old")
