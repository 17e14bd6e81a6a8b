"""Capture log, paired run and score card queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry
from . import lens
from .lens import LOG
from .registered import query

GROUPS = """g as (select {extra} profile, sha, count(*) as records, count(distinct runId) as distinct_runs, count(*) filter (where flag) as true_records, sum(len(writePaths))::bigint as write_entries,
sum(len(watchPaths))::bigint as watch_entries, array_to_string(list_sort(list_distinct(list(runId)))[1:5], ';') as run_ids_sample from {of} group by all)"""


@query(f"with {LOG}, {GROUPS.format(extra='', of='log')} select * from g")
def log_groups(spark, d):
    return telemetry.log_groups(lens.log(spark, d))


HALVES = f"with {LOG}, a as (select * from log where runId < '2024-01-16'), b as (select * from log where runId >= '2024-01-16'), " + GROUPS.format(extra="", of="a").replace("g as", "ga as", 1) + ", " + GROUPS.format(extra="", of="b").replace("g as", "gb as", 1)


@query(f"""{HALVES} select coalesce(ga.profile, gb.profile) as profile, coalesce(ga.sha, gb.sha) as sha, case when ga.records is null then 'candidate_only' when gb.records is null then 'baseline_only' else 'shared' end as side,
{", ".join(f"gb.{m} - ga.{m} as delta_{m}" for m in telemetry.METRICS)} from ga full join gb on ga.profile = gb.profile and ga.sha = gb.sha""")
def log_compare(spark, d):
    rows = lens.log(spark, d)
    return telemetry.log_compare(rows.where("runId < '2024-01-16'"), rows.where("runId >= '2024-01-16'"))


@query(f"with {LOG}, {GROUPS.format(extra='', of='log')} select {', '.join(f'sum({m})::bigint as {m}' for m in telemetry.METRICS)} from g")
def log_totals(spark, d):
    return telemetry.totals(telemetry.log_groups(lens.log(spark, d)))


def _lines(spark, d):
    """Capture lines made from events; types of events stand for the ways a line can be wrong."""
    e = lens.table(spark, d, "events")
    good = '{"runId":"r","profile":"p","sha":"s","nexusTools":true,"writePaths":["a"],"watchPaths":[]}'
    bad = {"view": "", "click": '{"runId":', "error": '{"runId":"r","runId":"q"}', "signup": "[1]"}
    line = F.lit(good)
    for k, v in bad.items():
        line = F.when(F.col("event_type") == k, F.lit(v)).otherwise(line)
    for low, high, v in (
        (100, 150, good.replace("true", "1")), (150, 200, good.replace('"a"', '" "')), (60, 80, good.replace('"sha"', '"other"')),
        (80, 100, '{"runId":"r"}'), (200, 9e9, good.replace('"p"', '"  "'))
    ):
        line = F.when((F.col("event_type") == "purchase") & (F.col("value") >= low) & (F.col("value") < high), F.lit(v)).otherwise(line)
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"))


@query("""select coalesce(code, 'valid') as code, count(*) as n from (select case event_type when 'view' then 'blank_line' when 'click' then 'invalid_json' when 'error' then 'duplicate_keys' when 'signup' then 'not_object'
else case when value >= 200 then 'empty_or_non_str' when value >= 150 then 'not_list_of_nonempty_str' when value >= 100 then 'not_bool' when value >= 80 then 'missing_keys' when value >= 60 then 'extra_keys' end end as code from events) group by 1""")
def strict_json(spark, d):
    return telemetry.inspect(_lines(spark, d)).groupBy(F.coalesce("code", F.lit("valid")).alias("code")).agg(F.count("*").alias("n"))


def _paired(spark, d):
    e = lens.table(spark, d, "events")
    arm = F.when(F.col("event_type") == "view", "baseline").when(F.col("event_type") == "click", "full").when(F.col("event_type") == "purchase", "compact")
    rows = e.withColumn("arm", arm).where("arm is not null").groupBy(F.dayofmonth("ts").alias("repeat"), F.col("user_id").alias("task"), "arm")
    return rows.agg(
        F.sum("value").alias("total"), F.max("value").alias("largest"), F.count("*").alias("n")
    ).withColumn("execution", F.when(F.col("largest") > 5, "completed").otherwise("failed"))


PAIRED = """p as (select day(ts)::int as repeat, user_id as task, case event_type when 'view' then 'baseline' when 'click' then 'full' else 'compact' end as arm, sum(value) as total, max(value) as largest, count(*) as n,
case when max(value) > 5 then 'completed' else 'failed' end as execution from events where event_type in ('view', 'click', 'purchase') group by all)"""


@query(f"""with {PAIRED}, q as (select a.repeat, a.task, b.total - a.total as total, b.largest - a.largest as largest from p a join p b on a.repeat = b.repeat and a.task = b.task where a.arm = 'baseline' and b.arm = 'full' and a.execution = 'completed' and b.execution = 'completed'),
t as (select 'total' as metric, round(total, 3) as delta from q union all select 'largest', round(largest, 3) from q) select metric, count(*) as n, round(min(delta), 2) as least, round(median(delta), 2) as median, round(max(delta), 2) as most from t group by 1""")
def paired_delta(spark, d):
    rows = telemetry.distribution(telemetry.paired_deltas(_paired(spark, d), "baseline", "full", ["total", "largest"]), ["metric"], "delta")
    return rows.select("metric", "n", *[F.round(c, 2).alias(c) for c in ("least", "median", "most")])


@query(f"""with {PAIRED}, k as (select repeat, task, count(distinct arm) filter (where execution = 'completed') as n from p group by all)
select repeat, case n when 3 then 'complete' when 0 then 'unavailable' else 'partial' end as status, count(*) as tasks from k group by all""")
def paired_complete(spark, d):
    return telemetry.completeness(_paired(spark, d), ["baseline", "full", "compact"])


@query(f"with {PAIRED} select arm, execution as score, count(*) as n from p group by all")
def score_counts(spark, d):
    return _paired(spark, d).groupBy("arm", F.col("execution").alias("score")).agg(F.count("*").alias("n"))


@query("""with e as (select lang, l.doc_id, count(*) as e from labels l join documents using (doc_id) where quality = 0 group by all),
o as (select lang, doc_id, count(*) as o from documents join (select distinct doc_id from labels) using (doc_id) where n_chars < 600 or contains(text, '%%%') group by all),
b as (select coalesce(e.lang, o.lang) as lang, coalesce(e, 0) as e, coalesce(o, 0) as o from e full join o on e.lang = o.lang and e.doc_id = o.doc_id)
select lang, sum(least(e, o))::bigint as hits, (sum(e) - sum(least(e, o)))::bigint as missing, (sum(o) - sum(least(e, o)))::bigint as unexpected, sum(least(e, o)) / nullif(sum(o), 0) as precision, sum(least(e, o)) / nullif(sum(e), 0) as recall from b group by lang""")
def scorecard_pr(spark, d):
    docs, labels = lens.table(spark, d, "documents"), lens.table(spark, d, "labels")
    expected = labels.where("quality = 0").join(docs, "doc_id").select("lang", "doc_id")
    observed = docs.join(
        labels.select("doc_id").distinct(), "doc_id", "left_semi"
    ).where((F.col("n_chars") < 600) | F.col("text").contains("%%%")).select("lang", "doc_id")
    return telemetry.scorecard(expected, observed, "lang", "doc_id")


@query("select coalesce(case when l_quantity < 5 then 'too_small' when l_discount > 0.08 then 'discounted' when l_returnflag = 'R' then 'returned' end, 'emitted') as reason, count(*) as n from lineitem group by 1")
def exclusions(spark, d):
    reason = F.when(F.col("l_quantity") < 5, "too_small").when(F.col("l_discount") > 0.08, "discounted").when(F.col("l_returnflag") == "R", "returned")
    return telemetry.exclusions(lens.table(spark, d, "lineitem"), reason)


COUNTERS = ("first", "second", "third")


@query("with s as (select user_id, count(*) as first, count(*) filter (where value > 100) as second, nullif(count(*) filter (where event_type = 'error'), 0) as third from events where user_id in (8, 46) group by 1), "
       "a as (select * from s where user_id = 8), b as (select * from s where user_id = 46) " + " union all ".join(
           f"select '{c}' as counter, (select {c} from b) - (select {c} from a) as delta" for c in COUNTERS
       ))
def counter_delta(spark, d):
    e = lens.table(spark, d, "events")
    rows = e.groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.count("*").alias("first"), F.count_if(F.col("value") > 100).alias("second"),
        F.expr("nullif(count_if(event_type = 'error'), 0)").alias("third")
    )
    return telemetry.counter_delta(rows, "8", "46", COUNTERS)
