"""Queries over tasks, answers, labels and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tasks
from . import lens
from .registered import query


def _history(spark, d):
    """Customers as tasks of their nation's project, orders as runs, lines as events."""
    c, o, li = (lens.table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    t = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("project_id"))
    r = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    e = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("task_id"), (
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")
        ).alias("id"), F.when(F.col("l_returnflag") == "R", "created").otherwise("claimed").alias("kind"), F.repeat(
            "l_returnflag", F.col("l_quantity").cast("int")
        ).alias("payload"))
    return t, r, e


_HISTORY = """t as (select c_custkey as id from customer where c_mktsegment = 'BUILDING'), r as (select o_custkey as task, o_orderkey as id from orders),
e as (select o_custkey as task, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey as id, l_returnflag, l_quantity::int as q from lineitem join orders on o_orderkey = l_orderkey),
ek as (select *, row_number() over (partition by task order by id) as nth from e where task in (select id from t))"""


@query(f"with {_HISTORY} select t.id as task, least(coalesce(a.n, 0), 11) as runs, least(coalesce(b.n, 0), 41) as events, case when a.n > 10 or b.n > 40 then 'over_limit' else 'observed' end as status from t left join (select task, count(*) as n from r group by 1) a on a.task = t.id left join (select task, count(*) as n from e group by 1) b on b.task = t.id")
def task_observation(spark, d):
    return tasks.observed(*_history(spark, d), "BUILDING", 10, 40)


@query(f"with {_HISTORY} select task as task_id, id, nth, case when l_returnflag = 'R' then repeat('R', q) end as payload from ek where nth <= 21")
def project_events(spark, d):
    return tasks.project_rows(*_history(spark, d), "BUILDING", 64, 20)[2].select("task_id", "id", "nth", "payload")


@query("""with m as (select conv_id as id, max_by(text, turn) filter (where role = 'assistant') as answer, min_by(text, turn) filter (where role = 'user') as asked from conversations group by 1),
w as (select distinct conv_id as id from conversations union select 1000000 + c_custkey from customer where c_custkey < 5)
select id, answer, case when id >= 1000000 then 'session_missing' when id % 7 = 1 then 'model_mismatch' when id % 7 = 2 then 'invalid_counters' when id % 7 = 3 or asked is null then 'prompt_mismatch' when answer is null then 'answer_missing' else 'ok' end as verdict from w left join m using (id)""")
def session_rows(spark, d):
    c = lens.table(spark, d, "conversations")
    m = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("n"), "role", F.col("text").alias("content"))
    k = F.col("id")
    ids = c.select(F.col("conv_id").alias("id")).distinct()
    sessions = ids.select("id", F.when(k % 7 == 1, "other").otherwise("model").alias("model"), F.when(k % 7 == 2, -1).otherwise(5).alias("tokens"))
    first = m.where("role = 'user'").groupBy(F.col("session").alias("id")).agg(F.min_by("content", "n").alias("content"))
    wanted = ids.join(first, "id", "left").select("id", F.lit("model").alias("model"), F.when(k % 7 == 3, F.lit("?")).otherwise(F.col("content")).alias("prompt"))
    more = lens.table(spark, d, "customer").where("c_custkey < 5").select(
        (F.col("c_custkey") + 1_000_000).alias("id"), F.lit("model").alias("model"), F.lit("?").alias("prompt")
    )
    return tasks.session_rows(sessions, m, wanted.unionByName(more), ["tokens"])


@query("""select o_orderkey, case o_custkey % 7 when 0 then 'pass' when 1 then 'pass' when 2 then 'wrong_answer' when 6 then 'wrong_answer' else 'invalid_answer' end as verdict, case when o_custkey % 7 = 5 then false else o_custkey % 7 in (0, 1, 4) end as mentioned from orders""")
def answer_verdicts(spark, d):
    m = F.col("o_custkey") % 7
    right = '{"paths": ["src/b.js", "src/a.js"]}'
    texts = [
        right, f"```json\n{right}\n```", '{"paths": ["src/a.js"]}', '{"paths": [1, 2]}', "src/a.js and src/b.js, not src/t.js or tests/a.js",
        '{"paths": [], "more": 1}', '{"paths": []}'
    ]
    answer = F.element_at(F.array(*map(F.lit, texts)), (m + 1).cast("int"))
    expected = F.array(F.lit("src/a.js"), F.lit("src/b.js"))
    o = lens.table(spark, d, "orders")
    return o.select(
        "o_orderkey", tasks.answer_verdict(answer, expected).alias("verdict"),
        tasks.mentions_expected(answer, expected, "src/", "src/t.js").alias("mentioned")
    )


@query("""with l as (select distinct l_orderkey as q, l_suppkey % 10 as s, l_partkey % 50 as p from lineitem where l_returnflag <> 'N'), i as (select distinct l_suppkey % 10 as s, l_partkey % 50 as p from lineitem where l_tax < 0.01 and l_orderkey % 3 = 0),
a as (select distinct q, s from l), k as (select q, s, p from a join i using (s)), m as (select q, count(*) as missing from (select * from k except select * from l) group by q), u as (select q, count(*) as unexpected from (select * from l except select * from k) group by q)
select q as question, coalesce(missing, 0)::bigint as missing, coalesce(unexpected, 0)::bigint as unexpected, case when missing > 0 and unexpected > 0 then 'both' when missing > 0 then 'missing' when unexpected > 0 then 'unexpected' else 'verified' end as verdict from (select distinct q from l) left join m using (q) left join u using (q)""")
def label_verification(spark, d):
    li = lens.table(spark, d, "lineitem")
    subject, path = (F.col("l_suppkey") % 10).alias("subject"), (F.col("l_partkey") % 50).alias("path")
    return tasks.verified_labels(
        li.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("question"), subject, path),
        li.where("l_tax < 0.01 and l_orderkey % 3 = 0").select(subject, path)
    )


@query("""with e as (select l_suppkey as k, l_linenumber as v, count(*) as e from lineitem where l_orderkey % 2 = 0 group by all), a as (select l_suppkey as k, l_linenumber as v, count(*) as a from lineitem where l_orderkey % 2 = 1 group by all)
select coalesce(e.k, a.k) as l_suppkey, coalesce(e.v, a.v) as l_linenumber, greatest(coalesce(e, 0) - coalesce(a, 0), 0) as missing, greatest(coalesce(a, 0) - coalesce(e, 0), 0) as unexpected from e full join a on e.k = a.k and e.v = a.v where coalesce(e, 0) <> coalesce(a, 0)""")
def multiset_difference(spark, d):
    li = lens.table(spark, d, "lineitem")
    return tasks.multiset_difference(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), "l_suppkey", "l_linenumber")


@query("select distinct a.l_suppkey as task, b.l_suppkey as peer from lineitem a join lineitem b on a.l_partkey = b.l_partkey where a.l_returnflag = 'R' and a.l_quantity > 48 and b.l_returnflag = 'N' and b.l_quantity < 3 and a.l_suppkey <> b.l_suppkey")
def peer_origins(spark, d):
    li = lens.table(spark, d, "lineitem")
    return tasks.peer_origins(
        li.where("l_returnflag = 'R' and l_quantity > 48").select(F.col("l_suppkey").alias("task"), F.col("l_partkey").alias("path")),
        li.where("l_returnflag = 'N' and l_quantity < 3").select(F.col("l_suppkey").alias("peer"), F.col("l_partkey").alias("path"))
    )


@query("""select event_id, case event_id % 5 when 0 then '' when 1 then 'extra extra_property;paths missing' when 2 then 'depth wrong_type' when 3 then 'depth missing;paths wrong_type;project wrong_type' else ' not_object' end as codes from events""")
def request_diagnostics(spark, d):
    m = F.col("event_id") % 5
    texts = [
        '{"project": "p", "paths": [], "depth": 2}', '{"project": "p", "depth": 2, "extra": {}}', '{"project": "p", "paths": ["a"], "depth": "2"}',
        '{"project": 1, "paths": "a"}', "[1]"
    ]
    rows = lens.table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, texts)), (m + 1).cast("int")).alias("body"))
    return tasks.diagnosed(rows, "body", {"project": "STRING", "paths": "ARRAY", "depth": "BIGINT"}).select("event_id", "codes")


@query("select event_id, (user_id % 5 >= user_id % 3) and ((user_id % 5 > user_id % 3) = (event_id % 2 = 0)) as sound from events")
def witness_summaries(spark, d):
    e = lens.table(spark, d, "events")
    reasons = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("origin_limit"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", tasks.witness_summary(F.col("user_id") % 5, F.col("user_id") % 3, reasons).alias("sound"))


@query("select o_orderkey, array_to_string(list_filter(['commit', 'project', 'token'], lambda n: (n = 'commit' and o_custkey % 2 = 1) or (n = 'project' and o_custkey % 3 = 0) or (n = 'token' and o_custkey % 5 < 2)), ';') as fields from orders")
def response_mismatches(spark, d):
    c = F.col("o_custkey")
    a = F.struct(F.lit("c").alias("commit"), F.lit("p").alias("project"), F.when(c % 5 != 0, F.lit("t")).alias("token"))
    b = F.struct(
        F.when(c % 2 == 1, "x").otherwise("c").alias("commit"), F.when(c % 3 == 0, F.lit(None).cast("string")).otherwise("p").alias("project"),
        F.when(c % 5 == 1, F.lit(None).cast("string")).otherwise("t").alias("token")
    )
    return lens.table(spark, d, "orders").select("o_orderkey", tasks.mismatches(a, b, ["commit", "project", "token"]).alias("fields"))
