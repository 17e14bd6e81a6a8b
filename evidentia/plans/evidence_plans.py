"""Evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from . import lens
from .registered import query


@query("select case when k is null then 'missing' when k = 69 then 'equal' else 'differs' end as verdict, count(*) as n from (select (props->>'k')::bigint as k from events) group by 1")
def component_values(spark, d):
    return evidence.components(lens.table(spark, d, "events"), "props", "$.k", 69)


@query("""with r as (select distinct o_custkey as user_id, l_linenumber::bigint as run from orders join lineitem on l_orderkey = o_orderkey), e as (select user_id, (props->>'k')::bigint as run from events)
select r.user_id is not null as corroborated, count(*) as n from e left join r on e.user_id = r.user_id and e.run = r.run group by 1""")
def usage_corroboration(spark, d):
    o, li = lens.table(spark, d, "orders"), lens.table(spark, d, "lineitem")
    runs = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("user_id"), F.col("l_linenumber").cast("long").alias("run"))
    events = lens.table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("run"))
    return evidence.corroborated(events, runs, ["user_id", "run"]).groupBy("corroborated").agg(F.count("*").alias("n"))


@query("select l_partkey as path, w[1] as distance, w[2] as origin from (select l_partkey, min((l_linenumber, l_suppkey)) as w from lineitem where l_returnflag <> 'N' and l_linestatus = 'F' group by 1)")
def dependency_citation(spark, d):
    li = lens.table(spark, d, "lineitem")
    return evidence.citation(
        li.select(
            F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("distance"), F.col("l_suppkey").alias("origin"),
            (F.col("l_returnflag") != "N").alias("own"), (F.col("l_linestatus") == "F").alias("peer")
        )
    )


@query("select o_orderkey as task, coalesce(n, 0) as attempts, watermark, case when o_orderstatus = 'P' then 'quarantined' end as reason from orders left join (select l_orderkey, count(*) as n, max(l_linenumber)::bigint as watermark from lineitem group by 1) on l_orderkey = o_orderkey")
def task_inspection(spark, d):
    o = lens.table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), "o_orderstatus")
    return evidence.inspected(o, lens.runs(spark, d), o.where("o_orderstatus = 'P'").withColumn("reason", F.lit("quarantined")))


@query("""with b as (select user_id as id, count(*) as n, floor(sum(value))::bigint as total from events where event_type <> 'view' group by 1), s as (select user_id as id, count(*) as n, floor(sum(value))::bigint as total from events where event_type <> 'view' or value > 20 group by 1 having count(*) > 60)
select case when s.id is null then 'session_missing' when b.n <> s.n or b.total <> s.total then 'counter_mismatch' else 'emitted' end as reason, count(*) as n from b left join s using (id) group by 1""")
def dataset_rows(spark, d):
    e = lens.table(spark, d, "events")
    of = lambda rows: rows.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.floor(F.sum("value")).alias("total"))
    kept, reasons = evidence.dataset_rows(of(e.where("event_type <> 'view'")), of(e.where("event_type <> 'view' or value > 20")).where("n > 60"), ["n", "total"])
    return reasons.unionByName(kept.agg(F.lit("emitted").alias("reason"), F.count("*").alias("n")).where("n > 0"))
