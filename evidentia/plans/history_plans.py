"""History queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from . import lens
from .registered import query


@query("""select o_custkey, o_orderkey, o_orderstatus, change from (select *, case when before is null then 'added' when before <> o_orderstatus then 'modified' end as change
from (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders)) where change is not null""")
def file_history(spark, d):
    rows = history.changes(lens.table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus", "change")


@query("select distinct l_orderkey as task, l_linenumber::bigint as run, case when l_linenumber = max(l_linenumber) over (partition by l_orderkey) then 'active' else 'superseded' end as state from lineitem")
def latest_attempt(spark, d):
    return history.latest_attempt(lens.runs(spark, d))


def _events(spark, d):
    e = lens.runs(spark, d)
    kind = F.when(F.col("l_returnflag") == "N", "claimed").when(F.col("l_returnflag") == "A", "pr_acceptance").otherwise("completed")
    return e.select("task", (F.floor(F.col("run") / 3)).alias("run"), kind.alias("kind"), F.col("at").alias("event_id"), (F.col("l_linestatus") == "F").alias("verified"))


EVENTS = """ev as (select l_orderkey as task, (l_linenumber // 3)::bigint as run, case l_returnflag when 'N' then 'claimed' when 'A' then 'pr_acceptance' else 'completed' end as kind, epoch(l_shipdate)::bigint as event_id, l_linestatus = 'F' as verified from lineitem),
r as (select task, run, max(event_id) filter (where kind = 'claimed') as claim, max(event_id) filter (where kind = 'completed') as done, max((event_id, verified)) filter (where kind = 'pr_acceptance') as receipt from ev group by all),
v as (select *, coalesce(receipt[2] and claim < receipt[1] and receipt[1] < done, false) as valid, run = max(run) over (partition by task) as latest from r),
st as (select task, run, case when valid and latest then 'active' when valid then 'superseded' when receipt is null then 'candidate' else 'rejected' end as status from v)"""


@query(f"with {EVENTS} select * from st")
def run_status(spark, d):
    return history.run_status(_events(spark, d))


@query(f"with {EVENTS} select * from st where status = 'active' and task not in (select o_orderkey from orders where o_orderstatus = 'P')")
def active_receipts(spark, d):
    pending = lens.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("task"))
    return history.active_receipts(history.run_status(_events(spark, d)), pending)


@query("select project, max(watermark) as watermark from (select o_custkey as project, o_orderkey as watermark from orders where o_orderstatus = 'F' union all select o_custkey, o_orderkey from orders where o_orderstatus = 'P') group by 1")
def high_water(spark, d):
    o = lens.table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("watermark"), "o_orderstatus")
    return history.high_water(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"))


@query("select o_orderkey as task, last_event from orders left join (select l_orderkey, max(l_linenumber)::bigint as last_event from lineitem group by 1) on l_orderkey = o_orderkey")
def task_marks(spark, d):
    events = lens.runs(spark, d).select("task", F.col("run").alias("event_id"))
    return history.task_marks(lens.table(spark, d, "orders").select(F.col("o_orderkey").alias("task")), events)


@query("select conv_id, count(*) as steps, list_reduce(list_prepend('', list(concat_ws(chr(31), turn::varchar, role, text) order by turn, concat_ws(chr(31), turn::varchar, role, text))), lambda a, b: sha256(a || b)) as chain from conversations group by conv_id")
def hash_chain(spark, d):
    return history.hash_chain(
        lens.table(spark, d, "conversations").withColumn("turn_text", F.col("turn").cast("string")), "conv_id", "turn", ["turn_text", "role", "text"]
    )


@query("""with s as (select *, floor((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts)) / 1000000)::bigint as gap from events)
select user_id, count(*) as samples, max(gap) as longest_gap, count(*) filter (where event_type = 'signup') as restarts, max(value) as peak, round(max_by(value, ts) - min_by(value, ts), 4) as delta from s group by 1""")
def sample_gaps(spark, d):
    rows = lens.table(spark, d, "events").withColumn("restart", F.col("event_type") == "signup")
    return history.sample_report(rows, "user_id", "ts", "value", "restart")


HEADS = "{0} as (select l_orderkey as task, max(l_linenumber)::bigint as watermark, 'p' || max(l_linenumber) as prefix, sum(l_suppkey)::varchar as rows_hash from lineitem {1} group by 1)"


@query(f"""with {HEADS.format("o", "where l_linestatus = 'F'")}, {HEADS.format("n", "where l_returnflag <> 'N'")}
select task, n.watermark, case when o.watermark is null then 'imported' when n.watermark < o.watermark then 'older_snapshot' when task % 11 = 0 then 'divergent_task_history' when n.watermark > o.watermark then 'imported' when n.rows_hash = o.rows_hash then 'already_imported' else 'divergent_task_history' end as action from n left join o using (task)""")
def watermark_merge(spark, d):
    def heads(where: str):
        g = lens.table(spark, d, "lineitem").where(where).groupBy(F.col("l_orderkey").alias("task"))
        return g.agg(
            F.max("l_linenumber").cast("long").alias("watermark"), F.concat(F.lit("p"), F.max("l_linenumber")).alias("prefix"),
            F.sum("l_suppkey").cast("string").alias("rows_hash")
        )

    new = heads("l_returnflag <> 'N'")
    marks = F.sequence(F.lit(1).cast("long"), F.col("watermark"))
    new = new.withColumn(
        "prefixes",
        F.map_from_arrays(marks, F.transform(marks, lambda n: F.concat(F.when(F.col("task") % 11 == 0, "x").otherwise("p"), n.cast("string"))))
    )
    return history.merge_observations(heads("l_linestatus = 'F'"), new)
