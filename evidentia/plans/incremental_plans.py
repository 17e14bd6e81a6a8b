"""Incremental and name queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names
from ..operators.durable import shared_dir
from ..streaming import usage
from . import lens
from .registered import query


def _folder(spark) -> str:
    """A fresh folder where the cluster shares files; a temporary one only where none is named, as in tests."""
    return f"{shared_dir(spark.range(0))}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name: str):
    schema = lens.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


@query("""with k as (select sha256('[' || '"' || user_id || '","' || strftime(ts, '%Y-%m-%d %H') || '"]') as key, event_type as body from events)
select key, count(*) as events, case when min(body) <> max(body) then 'conflict' when count(*) > 1 then 'duplicate' else 'accepted' end as state from k group by key""")
def event_dedup_conflict(spark, d):
    e = lens.table(spark, d, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return usage.deduplicated(e.withColumn("key", usage.event_key("user_id", "hour")), "key", "event_type")


@query("select event_id, user_id, floor(value)::bigint as tokens from events where floor(value) >= 0")
def stream_minimise(spark, d):
    events = _stream(spark, d, "events").withColumn("tokens", F.floor("value"))
    at = _folder(spark)
    return usage.drained(usage.minimised(events, ["event_id", "user_id"], ["tokens"]), f"{at}/rows", f"{at}/log")


@query("""with h as (select l_orderkey as task, l_linenumber::bigint as watermark, min(l_linestatus) as rows_hash, max(l_linestatus) as other from lineitem group by all),
t as (select * from h qualify row_number() over (partition by task order by watermark desc) = 1) select task, watermark, rows_hash from t where rows_hash = other""")
def watermark_sync(spark, d):
    rows = _stream(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task"), F.col("l_linenumber").cast("long").alias("watermark"), F.col("l_linestatus").alias("rows_hash")
    )
    at = _folder(spark)
    return usage.synchronise(rows, f"{at}/state", f"{at}/log")[0]


@query("select kind, key, count(*) as names from (select distinct 'full' as kind, name, rtrim(lower(name), ' .') as key from (select regexp_replace(p_name, 'e', case when p_size > 25 then 'E' else 'e' end, 'g') || case when p_size % 2 = 0 then '.' else '' end as name from part) union all select distinct 'simple', name, rtrim(lower(name), ' .') from (select regexp_replace(p_name, 'e', case when p_size > 25 then 'E' else 'e' end, 'g') || case when p_size % 2 = 0 then '.' else '' end as name from part)) group by all having count(*) > 1")
def name_collisions(spark, d):
    p = lens.table(spark, d, "part")
    name = F.concat(
        F.when(F.col("p_size") > 25, F.replace("p_name", F.lit("e"), F.lit("E"))).otherwise(F.col("p_name")),
        F.when(F.col("p_size") % 2 == 0, ".").otherwise("")
    )
    return names.collisions(p.select(name.alias("name")))
