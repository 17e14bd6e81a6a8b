"""Histories: changes of a path, attempts of a task, high-water marks, hash chains, samples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def changes(entries: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Entries that differ from the one before: added (no value before), deleted (none now), modified; null is no value."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    change = F.when(before.isNull() & F.col(value).isNotNull(), "added").when(
        before.isNotNull() & F.col(value).isNull(), "deleted"
    ).when(before != F.col(value), "modified")
    return entries.withColumn("change", change).where("change is not null")


def latest_attempt(runs: DataFrame) -> DataFrame:
    """(task, run, state): the largest run of a task is active, others are superseded."""
    once = runs.select("task", "run").distinct()
    return once.withColumn("state", F.when(F.col("run") == F.max("run").over(W.partitionBy("task")), "active").otherwise("superseded"))


def run_status(events: DataFrame) -> DataFrame:
    """(task, run, status) from events (task, run, kind, event_id, verified).

    Last receipt, completion and claim of a run count: no receipt is a candidate; a verified chain claim < receipt < completion is active for
    the task's latest run and superseded for others; anything else is rejected. One aggregation, then a window over runs.
    """
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("event_id")))
    runs = events.groupBy("task", "run").agg(
        last("claimed").alias("claim"), last("completed").alias("done"),
        F.max(F.when(F.col("kind") == "pr_acceptance", F.struct("event_id", "verified"))).alias("receipt"),
    )
    valid = F.coalesce(F.col("receipt.verified") & (F.col("claim") < F.col("receipt.event_id")) & (F.col("receipt.event_id") < F.col("done")), F.lit(False))
    latest = F.col("run") == F.max("run").over(W.partitionBy("task"))
    status = F.when(valid & latest, "active").when(valid, "superseded").when(F.col("receipt").isNull(), "candidate").otherwise("rejected")
    return runs.withColumn("status", status).select("task", "run", "status")


def active_receipts(status: DataFrame, pending: DataFrame) -> DataFrame:
    """Active runs of tasks that are not pending (column task)."""
    return status.where("status = 'active'").join(pending, "task", "left_anti")


def high_water(heads: DataFrame, pending: DataFrame) -> DataFrame:
    """(project, watermark): the largest over heads and pending tasks."""
    return heads.select("project", "watermark").unionAll(pending.select("project", "watermark")).groupBy("project").agg(F.max("watermark").alias("watermark"))


def task_marks(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """(task, last_event): every task with its largest event id, null without events; events are reduced before the join."""
    last = events.groupBy("task").agg(F.max("event_id").alias("last_event"))
    return tasks.select("task").join(last, "task", "left")


def hash_chain(rows: DataFrame, key: str, order: str, parts: list[str]) -> DataFrame:
    """(key, steps, chain): sha256 folded over a key's rows in order, each step over the digest before and the row's parts.

    Rows come sorted by key and order, and a task folds them as they pass, so a key's history is never held.
    """
    kind = rows.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, steps, chain = None, 0, ""
        for batch in batches:
            done = []
            for k, value in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if steps and k != now:
                    done.append((now, steps, chain))
                    steps, chain = 0, ""
                now, steps, chain = k, steps + 1, hashlib.sha256((chain + value).encode("utf-8", "surrogatepass")).hexdigest()
            if done:
                yield table(done, batch.schema.field("k").type)
            last = batch.schema.field("k").type
        if steps:
            yield table([(now, steps, chain)], last)

    def table(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.int64(), pa.string()), strict=True)], [key, "steps", "chain"]
        )

    line = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.concat_ws("\x1f", *parts).alias("v"))
    return line.repartition("k").sortWithinPartitions("k", "o", "v").drop("o").mapInArrow(fold, f"`{key}` {kind}, steps long, chain string")


def sample_report(samples: DataFrame, key: str, at: str, value: str, restart: str) -> DataFrame:
    """Per key: samples, longest gap in whole seconds, restarts, peak and last-minus-first value. samples has the boolean column restart."""
    w = W.partitionBy(key).orderBy(at)
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    gap = (moment - F.lag(moment).over(w)) / 1_000_000
    rows = samples.withColumn("gap", F.floor(gap))
    return rows.groupBy(key).agg(
        F.count("*").alias("samples"), F.max("gap").alias("longest_gap"), F.count_if(restart).alias("restarts"), F.max(value).alias("peak"),
        F.round(F.max_by(value, at) - F.min_by(value, at), 4).alias("delta")
    )


def merge_observations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Watermarked upsert of task heads (task, watermark, prefix, rows_hash): what becomes of each new head.

    older_snapshot, already_imported, divergent_task_history (same mark but other hashes, or an old mark whose prefix the new history lacks) or imported. new also
    has prefixes, a map of marks to prefixes.
    """
    o = old.select("task", *[F.col(c).alias(f"old_{c}") for c in ("watermark", "prefix", "rows_hash")])
    rows = new.join(o, "task", "left")
    action = (
        F.when(F.col("old_watermark").isNull(), "imported")
        .when(F.col("watermark") < F.col("old_watermark"), "older_snapshot")
        .when(~F.coalesce(F.element_at("prefixes", F.col("old_watermark")) == F.col("old_prefix"), F.lit(False)), "divergent_task_history")
        .when(F.col("watermark") > F.col("old_watermark"), "imported")
        .when(F.col("rows_hash") == F.col("old_rows_hash"), "already_imported")
        .otherwise("divergent_task_history")
    )
    return rows.select("task", "watermark", action.alias("action"))


def recent_changes(entries: DataFrame, key: str, order: str, value: str, commits: int = 64, most: int = 16) -> DataFrame:
    """The last `most` changes among the last `commits` entries of each key, as changes() tells them."""
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    found = changes(entries.withColumn("back", back).where(F.col("back") <= commits).drop("back"), key, [order], value)
    return found.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("nth") <= most).drop("nth")


def page(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of an order, and in `truncated` whether there is one more."""
    head = rows.orderBy(*order).limit(limit + 1)
    n = F.row_number().over(W.orderBy(*order))
    return head.withColumns({"n": n, "all": F.count("*").over(W.partitionBy())}).where(F.col("n") <= limit).withColumn("truncated", F.col("all") > limit).drop("n", "all")


def soak_report(samples: DataFrame, key: str, slack: float = 2.0) -> DataFrame:
    """Per key of samples (at in seconds, live, ready, uptime, rss): failures, restarts, longest gap, peak, and whether it passed.

    A restart is a start (at less uptime) more than `slack` seconds after the one before it; samples without an uptime tell none.
    """
    w = W.partitionBy(key).orderBy("at")
    began = F.when(F.col("uptime") >= 0, F.col("at") - F.col("uptime"))
    rows = samples.withColumn("began", began).withColumns(
        {"gap": F.col("at") - F.lag("at").over(w), "earlier": F.last("began", True).over(w.rowsBetween(W.unboundedPreceding, -1))}
    )
    restart = F.coalesce(F.col("began") > F.col("earlier") + slack, F.lit(False))
    agg = rows.groupBy(key).agg(
        F.count("*").alias("samples"), F.count_if(~F.col("live")).alias("liveness_failures"), F.count_if(~F.col("ready")).alias("readiness_failures"), F.count_if(restart).alias("restarts"),
        F.round(F.max("gap"), 2).alias("longest_gap"), F.max("rss").alias("peak"),
    )
    return agg.withColumn("status", F.when(F.col("liveness_failures") + F.col("readiness_failures") + F.col("restarts") > 0, "failed").otherwise("passed"))
