"""Incremental operators: event minimisation, keyed de-duplication with sticky conflicts, watermark synchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minimised(events: DataFrame, ids: list[str], counters: list[str]) -> DataFrame:
    """Ids and non-negative counters of hook events; rows with a missing id or a negative counter go. Works on streams too."""
    keep = F.lit(True)
    for c in ids:
        keep = keep & F.col(c).isNotNull()
    for c in counters:
        keep = keep & (F.col(c).isNull() | (F.col(c) >= 0))
    return events.where(keep).select(*ids, *counters)


def event_key(*ids: str) -> F.Column:
    """SHA-256 of the ids as a JSON list."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in ids])), 256)


def deduplicated(events: DataFrame, key: str, body: str) -> DataFrame:
    """(key, events, state): accepted if a key has one row, duplicate if more of the same body, conflict if bodies differ. Conflicts stay.

    For batches. Partial aggregates carry two bodies at most for each key, however often it comes.
    """
    per = events.groupBy(key).agg(F.count("*").alias("events"), F.min(body).alias("a"), F.max(body).alias("b"))
    return per.select(key, "events", F.when(F.col("a") != F.col("b"), "conflict").when(F.col("events") > 1, "duplicate").otherwise("accepted").alias("state"))


def deduplicated_stream(events: DataFrame, key: str, body: str, ttl_ms: int | None = None) -> DataFrame:
    """As deduplicated(), for a stream: every micro-batch gives each key's count and state so far. The state is a body's digest, a count and a flag.

    With ttl_ms a key is forgotten that long after its last row, so the state is bounded by what comes in that time; a row after it is accepted anew. Such a stream has time-outs to wait for and
    so never comes to an end by itself: run it by a processing-time trigger, not by availableNow.
    """

    def step(ident: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, n, conflict = state.get if state.exists else (None, 0, False)
        for rows in batches:
            for value in rows["digest"]:
                first = value if first is None else first
                n, conflict = n + 1, conflict or value != first
        state.update((first, n, conflict))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [ident[0]], "events": [n], "state": ["conflict" if conflict else "duplicate" if n > 1 else "accepted"]})

    rows = events.select(F.col(key).cast("string").alias(key), F.sha2(F.col(body).cast("string"), 256).alias("digest"))
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} string, events long, state string", "first string, n long, conflict boolean", "update",
        GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def advance(heads: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New heads (task, watermark, rows_hash) and quarantined tasks (task, reason) after a micro-batch of arrived heads.

    Of several arrivals of a task the largest mark counts. An older mark is ignored, never quarantined; the same mark with another hash is quarantined, and so are two hashes for one
    mark within the batch.
    """
    top = arrived.groupBy("task").agg(F.max("watermark").alias("watermark"))
    now = arrived.join(top, ["task", "watermark"]).groupBy("task", "watermark").agg(F.min("rows_hash").alias("rows_hash"), F.max("rows_hash").alias("other"))
    both = heads.select("task", F.col("watermark").alias("w"), F.col("rows_hash").alias("h")).join(now, "task", "full_outer")
    split = (F.col("rows_hash") != F.col("other")) | ((F.col("watermark") == F.col("w")) & (F.col("rows_hash") != F.col("h")))
    both = both.withColumn("bad", F.coalesce(split & (F.col("w").isNull() | (F.col("watermark") >= F.col("w"))), F.lit(False)))
    newer = ~F.col("bad") & F.col("watermark").isNotNull() & (F.col("w").isNull() | (F.col("watermark") > F.col("w")))
    kept = both.where(newer | F.col("w").isNotNull()).select(
        "task", F.when(newer, F.col("watermark")).otherwise(F.col("w")).alias("watermark"),
        F.when(newer, F.col("rows_hash")).otherwise(F.col("h")).alias("rows_hash")
    )
    return kept, both.where("bad").select("task", F.lit("divergent_task_history").alias("reason"))


def synchronise(stream: DataFrame, folder: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Run a stream of heads to its present end, one writer, and return (heads, quarantine: task, reason). Quarantined tasks are left out of the heads.

    The state is a store of buckets in the folder, of which a micro-batch rewrites those that it changes.
    """
    from .store import Store  # which builds on advance()

    store = Store(stream.sparkSession, folder)
    store.drain(stream, checkpoint)
    return store.heads(), store.pending().select("task", "reason")


def drained(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """A stream's rows up to its present end, appended to Parquet in a folder and read from there."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
