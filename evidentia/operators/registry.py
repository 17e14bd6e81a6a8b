"""Project registries, audits and tree comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import counted


def first_wins(rows: DataFrame) -> DataFrame:
    """Rows (name, path, ord) kept when read in order, skipping one whose name or path an earlier kept row has.

    Rounds instead of a loop over rows: a row that is first for its name and its path among those left is kept, and takes out all
    that share either. Every round decides at least the first row; chains of shared names and paths make further rounds.
    """
    left, n = counted(rows)
    kept = None
    while n:
        first = left.groupBy("name").agg(F.min("ord").alias("by_name"))
        other = left.groupBy("path").agg(F.min("ord").alias("by_path"))
        now, _ = counted(left.join(first, "name").join(other, "path").where("ord = by_name and ord = by_path").select(*rows.columns))
        kept = now if kept is None else kept.unionByName(now)
        rest = left.join(now.select("name"), "name", "left_anti").join(now.select("path"), "path", "left_anti")
        left, n = counted(rest.select(*rows.columns))
    return rows.limit(0) if kept is None else kept


def merge(manual: DataFrame, discovered: DataFrame) -> DataFrame:
    """Manual rows, then discovered ones whose name and path no manual row has, the first of each; with their source."""
    fresh = discovered.join(manual.select("name"), "name", "left_anti").join(manual.select("path"), "path", "left_anti")
    return manual.select("name", "path", F.lit("manual").alias("source")).unionByName(
        first_wins(fresh.select("name", "path", "ord")).select("name", "path", F.lit("discovered").alias("source"))
    )


def upsert(manual: DataFrame, discovered: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, name, status): what registering candidates does: already_registered by hand (path or name), updated or registered."""
    m_path, m_name = manual.select("path").distinct().withColumn("m1", F.lit(True)), manual.select("name").distinct().withColumn("m2", F.lit(True))
    known = discovered.select("path").distinct().withColumn("k", F.lit(True))
    rows = candidates.join(m_path, "path", "left").join(m_name, "name", "left").join(known, "path", "left")
    return rows.select("path", "name", F.when(F.col("m1") | F.col("m2"), "already_registered").when(F.col("k"), "updated").otherwise("registered").alias("status"))


def readiness(rows: DataFrame) -> DataFrame:
    """(check, conflicts): names with several paths, paths with several names, ids with several paths."""
    def bad(key: str, value: str):
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1").agg(
            F.lit(f"{key}_{value}").alias("check"), F.count("*").alias("conflicts")
        )

    return bad("name", "path").unionByName(bad("path", "name")).unionByName(bad("project_id", "path"))


def session_link(outcomes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(task, status): whether the session of a task's active outcome was observed; outcomes: task, run, session; sessions: id, active rows only."""
    rows = outcomes.join(sessions.select(F.col("id").alias("session"), F.lit(True).alias("seen")).distinct(), "session", "left")
    status = F.when(F.col("run").isNull(), "active_outcome_missing").when(
        F.col("session").isNull(), "origin_session_not_recorded"
    ).when(F.col("seen"), "observed").otherwise("missing_from_session_snapshot")
    return rows.select("task", status.alias("status"))


def diff_audit(changed: DataFrame, writable: DataFrame) -> DataFrame:
    """(path, verdict): whether a changed path is in the write set."""
    ok = writable.select("path").distinct().withColumn("ok", F.lit(True))
    return changed.select("path").distinct().join(ok, "path", "left").select("path", F.when(F.col("ok"), "in_write").otherwise("outside_write").alias("verdict"))


def audit_receipt(audit: DataFrame) -> DataFrame:
    """(paths, outside, receipt): an audit's counts and a digest of its sorted rows, over 256 leaves by the hash of the path."""
    path = F.col("path").cast("string")
    leaves = audit.groupBy(F.substring(F.sha2(path, 256), 1, 2).alias("leaf")).agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "outside_write").alias("o"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", path, "verdict"))), "\n"), 256).alias("d")
    )
    root = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "d"))), lambda x: x["d"]), "\n")
    return leaves.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("paths"), F.coalesce(F.sum("o"), F.lit(0)).alias("outside"),
        F.concat(F.lit("audit_"), F.sha2(root, 256)).alias("receipt")
    )


def tree_match(tree: DataFrame, live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(state, paths): paths by whether the tree, the live files and the snapshot (path, hash) agree; one aggregation over their union."""
    rows = None
    for n, t in enumerate((tree, live, snapshot)):
        part = t.select("path", "hash", F.lit(1 << n).alias("side"))
        rows = part if rows is None else rows.unionByName(part)
    per = rows.groupBy("path").agg(F.bit_or("side").alias("sides"), F.min("hash").alias("a"), F.max("hash").alias("b"))
    state = F.when(F.col("sides") != 7, "missing").when(F.col("a") == F.col("b"), "equal").otherwise("changed")
    return per.groupBy(state.alias("state")).agg(F.count("*").alias("paths"))


def move(paths: DataFrame, old: str, new: str) -> DataFrame:
    """(path, moved): paths at or below the old folder under the new one."""
    below = (F.col("path") == old) | F.col("path").startswith(old + "/")
    return paths.where(below).select("path", F.concat(F.lit(new), F.expr(f"substring(path, {len(old) + 1})")).alias("moved"))
