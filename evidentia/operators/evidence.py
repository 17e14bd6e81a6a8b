"""Evidence checks: JSON components, usage corroboration, citations, task inspection, provider choice, dataset rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(rows: DataFrame, column: str, path: str, expected) -> DataFrame:
    """(verdict, n): whether a JSON path holds the expected value: equal, differs, missing, or invalid where the text is no JSON."""
    doc = F.try_parse_json(column)
    value = F.expr(f"try_variant_get(try_parse_json({column}), '{path}', 'variant')")
    same = F.try_variant_get(value, "$", {bool: "boolean", int: "long", float: "double", str: "string"}[type(expected)]) == F.lit(expected)
    verdict = F.when(doc.isNull(), "invalid").when(value.isNull(), "missing").when(same, "equal").otherwise("differs")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def corroborated(events: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Events with whether a native run has the same keys; runs are made distinct first, so events never multiply."""
    known = runs.select(*keys).distinct().withColumn("seen", F.lit(True))
    return events.join(known, keys, "left").withColumn("corroborated", F.coalesce("seen", F.lit(False))).drop("seen")


def citation(witnesses: DataFrame) -> DataFrame:
    """(path, distance, origin): the nearest witness valid on both snapshots, ties by origin; witnesses: path, distance, origin, own, peer."""
    best = witnesses.where("own and peer").groupBy("path").agg(F.min(F.struct("distance", "origin")).alias("w"))
    return best.select("path", "w.distance", "w.origin")


def inspected(tasks: DataFrame, attempts: DataFrame, pending: DataFrame) -> DataFrame:
    """(task, attempts, watermark, reason): every task with its attempts, largest mark and pending reason, null where there is none."""
    per = attempts.groupBy("task").agg(F.count("*").alias("attempts"), F.max("run").alias("watermark"))
    return tasks.select("task").join(per, "task", "left").join(pending.select("task", "reason"), "task", "left").select(
        "task", F.coalesce("attempts", F.lit(0)).alias("attempts"), "watermark", "reason"
    )


def choose_provider(providers: list[dict], languages: set[str], capability: str) -> tuple[dict | None, list[dict]]:
    """The first provider by priority (high first) and id that speaks a language and has the capability, and the log of attempts."""
    attempts = []
    for p in sorted(providers, key=lambda p: (-p["priority"], p["id"])):
        level = p["capabilities"].get(capability, "none")
        reason = "unsupported_language" if not languages & set(p["languages"]) else "unsupported_capability" if level == "none" else None
        attempts.append({"id": p["id"], "reason": reason, "covered": sorted(languages & set(p["languages"])), "uncovered": sorted(languages - set(p["languages"]))})
        if reason is None:
            return p, attempts
    return None, attempts


def dataset_rows(rows: DataFrame, sessions: DataFrame, counters: list[str]) -> tuple[DataFrame, DataFrame]:
    """Benchmark rows whose counters equal those of the retained session (id), and the reasons of the others."""
    kept = sessions.select("id", *[F.col(c).alias(f"kept_{c}") for c in counters], F.lit(True).alias("retained"))
    both = rows.join(kept, "id", "left")
    equal = F.lit(True)
    for c in counters:
        equal = equal & F.col(c).eqNullSafe(F.col(f"kept_{c}"))
    both = both.withColumn("reason", F.when(F.col("retained").isNull(), "session_missing").when(~equal, "counter_mismatch"))
    return both.where("reason is null").select(*rows.columns), both.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
