"""Places and running sums in a total order over any number of rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

#: Bits of monotonically_increasing_id that count rows within a partition.
AT_BITS = 33
_PRIVATE = ("_run", "_at", "_before", "_sum", "_first", "_n", "_sums", "_run2")


def _offsets(totals: DataFrame, keys: list[str]) -> DataFrame:
    """totals: a row for each sorted run and key (_run, keys, _n, _sums). Adds what the runs before hold of the same key: _before and _sum.

    Without keys there are as many rows as runs, i.e. shuffle partitions, and they are added up on the driver; with keys, each key's rows are at most that many.
    """
    if keys:
        before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_sum": F.coalesce(F.sum("_sums").over(before), F.lit(0))})
    rows, n, total = [], 0, 0
    for run, first, count, amount in sorted(tuple(r) for r in totals.select("_run", "_first", "_n", "_sums").collect()):
        rows.append((run, first, count, amount, n, total))
        n, total = n + count, total + (amount or 0)
    return totals.sparkSession.createDataFrame(rows, "_run long, _first long, _n long, _sums long, _before long, _sum long")


def placed(df: DataFrame, order: list[Column | str], keys: list[str] | None = None, amount: Column | None = None) -> DataFrame:
    """df with place (long, from 0): each row's place in `order` among the rows of its keys (all rows without keys). amount: also running (long), its sum up to and with the row.

    Rows are dealt by ranges of keys and order, sorted, and written as runs; a run's rows are numbered as they lie, and the totals of the runs before are added. No
    task holds more than a range: a key with a third of all rows is many ranges, and rows equal in all of keys and order are dealt by a salt, too, so they
    may stand in any order among each other. Nulls come first in a key of its own; null amounts count as 0. Columns that begin with an underscore and
    have one of the names used here are not allowed.
    """
    keys = list(keys or [])
    if clash := set(df.columns) & {*_PRIVATE, "place", *(["running"] if amount is not None else [])}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumns({"_salt": F.monotonically_increasing_id(), "_sums": F.coalesce(amount, F.lit(0)).cast("long") if amount is not None else F.lit(0).cast("long")})
    runs = rows.repartitionByRange(*keys, *order, "_salt").sortWithinPartitions(*keys, *order, "_salt").drop("_salt")
    runs = cut(runs.withColumn("_at", F.monotonically_increasing_id()))
    runs = runs.withColumns({"_run": F.shiftright("_at", AT_BITS), "_at": F.col("_at").bitwiseAND((1 << AT_BITS) - 1)})
    totals = runs.groupBy("_run", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("_sums").alias("_sums"))
    offsets = _offsets(totals, keys).select(F.col("_run").alias("_run2"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_first", "_before", "_sum")
    on = F.col("_run") == F.col("_run2")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = runs.join(offsets if keys else F.broadcast(offsets), on)  # without keys: a row for each run
    out = {"place": F.col("_at") - F.col("_first") + F.col("_before")}
    if amount is not None:
        # the runs are in order in their files, but a join may deal rows anew: the sum goes by place, one run and key at a time
        within = Window.partitionBy("_run", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out["running"] = F.sum("_sums").over(within) + F.col("_sum")
    return joined.withColumns(out).select(*df.columns, *out)
