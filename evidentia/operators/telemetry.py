"""Capture logs, paired runs and score cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schemas import LOG, LOG_KEYS


def inspect(lines: DataFrame) -> DataFrame:
    """Per line (line_no, line): the first failing code, or null, and the parsed record.

    Codes in order: blank_line, invalid_json, duplicate_keys, not_object, extra_keys, missing_keys, empty_or_non_str, not_bool,
    not_list_of_nonempty_str. All in the JVM: the parser refuses duplicate keys, the key list keeps them, so the two tell the cases apart.
    """
    doc = F.try_parse_json("line")
    rows = lines.withColumns({"doc": doc, "kind": F.schema_of_variant(doc), "keys": F.expr("json_object_keys(line)")})
    text = lambda k: F.expr(f"try_variant_get(doc, '$.{k}', 'string')")
    kind = lambda k: F.expr(f"schema_of_variant(try_variant_get(doc, '$.{k}', 'variant'))")
    paths = lambda k: F.expr(f"try_variant_get(doc, '$.{k}', 'array<variant>')")
    wrong_text = lambda k: (kind(k) != "STRING") | (F.btrim(text(k)) == "")
    wrong_list = lambda k: ~kind(k).startswith("ARRAY") | F.exists(
        paths(k), lambda x: (F.schema_of_variant(x) != "STRING") | (F.btrim(F.try_variant_get(x, "$", "string")) == "")
    )
    code = (
        F.when(F.rtrim(F.regexp_replace("line", "[\r\n]+$", "")) == "", "blank_line")
        .when(F.col("doc").isNull() & (F.size("keys") > F.size(F.array_distinct("keys"))), "duplicate_keys")
        .when(F.col("doc").isNull(), "invalid_json")
        .when(~F.col("kind").startswith("OBJECT"), "not_object")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, LOG_KEYS)))) > 0, "extra_keys")
        .when(F.size("keys") < len(LOG_KEYS), "missing_keys")
        .when(wrong_text("runId") | wrong_text("profile") | wrong_text("sha"), "empty_or_non_str")
        .when(kind("nexusTools") != "BOOLEAN", "not_bool")
        .when(wrong_list("writePaths") | wrong_list("watchPaths"), "not_list_of_nonempty_str")
    )
    rows = rows.withColumn("code", code)
    return rows.select("line_no", "code", F.when(F.col("code").isNull(), F.from_json("line", LOG)).alias("record"))


def log_groups(records: DataFrame, sample: int = 5) -> DataFrame:
    """Per profile and sha: records, distinct runs, true flags, path entries, and the first run ids.

    Runs are made one row each first; then only the first few ids of a group are ever gathered.
    """
    runs = records.groupBy("profile", "sha", "runId").agg(
        F.count("*").alias("records"), F.count_if("nexusTools").alias("true_records"), F.sum(F.size("writePaths")).alias("write_entries"),
        F.sum(F.size("watchPaths")).alias("watch_entries")
    )
    ranked = runs.withColumn("nth", F.row_number().over(W.partitionBy("profile", "sha").orderBy(F.asc_nulls_last("runId"))))
    return ranked.groupBy("profile", "sha").agg(
        F.sum("records").alias("records"), F.count("runId").alias("distinct_runs"), F.sum("true_records").alias("true_records"), F.sum("write_entries").alias("write_entries"), F.sum("watch_entries").alias("watch_entries"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= sample, F.col("runId")))), ";").alias("run_ids_sample"),
    )


METRICS = ("records", "distinct_runs", "true_records", "write_entries", "watch_entries")


def log_compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cohorts (profile, sha) of two captures side by side: side (shared, baseline_only, candidate_only) and candidate minus baseline."""
    a, b = (log_groups(x).select("profile", "sha", *[F.col(m).alias(f"{side}_{m}") for m in METRICS]) for x, side in ((baseline, "baseline"), (candidate, "candidate")))
    both = a.join(b, ["profile", "sha"], "full_outer")
    side = F.when(F.col("baseline_records").isNull(), "candidate_only").when(F.col("candidate_records").isNull(), "baseline_only").otherwise("shared")
    return both.select("profile", "sha", side.alias("side"), *[(F.col(f"candidate_{m}") - F.col(f"baseline_{m}")).alias(f"delta_{m}") for m in METRICS])


def totals(groups: DataFrame) -> DataFrame:
    return groups.agg(*[F.sum(m).alias(m) for m in METRICS])


def paired_deltas(rows: DataFrame, left: str, right: str, metrics: list[str]) -> DataFrame:
    """(repeat, task, metric, delta): right minus left of pairs where both arms completed and have the metric.

    rows: repeat, task, arm, execution and the metrics. One aggregation over pairs in place of a self-join.
    """
    done = rows.where((F.col("execution") == "completed") & F.col("arm").isin(left, right))
    arm = lambda m, a: F.max(F.when(F.col("arm") == a, F.col(m)))
    wide = done.groupBy("repeat", "task").agg(*[(arm(m, right) - arm(m, left)).alias(m) for m in metrics])
    tall = wide.unpivot(["repeat", "task"], metrics, "metric", "delta").where("delta is not null")
    return tall.withColumn("delta", F.round("delta", 3))


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, exact median and max for each key."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))


def completeness(rows: DataFrame, arms: list[str]) -> DataFrame:
    """(repeat, status, tasks): tasks whose every arm completed (complete), some did (partial), none (unavailable)."""
    done = F.count_distinct(F.when(F.col("execution") == "completed", F.col("arm")))
    per = rows.where(F.col("arm").isin(arms)).groupBy("repeat", "task").agg(done.alias("n"))
    return per.groupBy(
        "repeat", F.when(F.col("n") == len(arms), "complete").when(F.col("n") > 0, "partial").otherwise("unavailable").alias("status")
    ).agg(F.count("*").alias("tasks"))


def scorecard(expected: DataFrame, observed: DataFrame, group: str, item: str) -> DataFrame:
    """Per group: hits, missing and unexpected with multiplicity, precision and recall (null over nothing)."""
    count = lambda rows, name: rows.groupBy(group, item).agg(F.count("*").alias(name))
    both = count(expected, "e").join(count(observed, "o"), [group, item], "full_outer").na.fill(0, ["e", "o"])
    sums = both.groupBy(group).agg(F.sum(F.least("e", "o")).alias("hits"), F.sum("e").alias("n_expected"), F.sum("o").alias("n_observed"))
    return sums.select(
        group, "hits", (F.col("n_expected") - F.col("hits")).alias("missing"), (F.col("n_observed") - F.col("hits")).alias("unexpected"),
        F.try_divide("hits", "n_observed").alias("precision"), F.try_divide("hits", "n_expected").alias("recall")
    )


def exclusions(rows: DataFrame, reason: Column) -> DataFrame:
    """(reason, n): why rows were left out; emitted for those that were not."""
    return rows.groupBy(F.coalesce(reason, F.lit("emitted")).alias("reason")).agg(F.count("*").alias("n"))


def counter_delta(sessions: DataFrame, first: str, second: str, counters: tuple[str, ...]) -> DataFrame:
    """(counter, delta): second minus first session, null where either is."""
    two = sessions.where(F.col("id").isin(first, second))
    of = lambda c, s: F.max(F.when(F.col("id") == s, F.col(c)))
    return two.agg(*[(of(c, second) - of(c, first)).alias(c) for c in counters]).unpivot([], list(counters), "counter", "delta")


def text_report(totals: dict, problems: list[dict], groups: list[dict], most: int = 20) -> str:
    """A capture's inspection as lines of text, control characters escaped; problems and groups up to `most`."""
    shown = lambda v: "".join(f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c for c in str("" if v is None else v))
    lines = [f"{k}: {shown(totals[k])}" for k in sorted(totals)]
    for name, rows in (("invalid_records", problems), ("groups", groups)):
        if rows:
            lines += [f"{name} ({min(len(rows), most)} of {len(rows)}):", *["  " + " ".join(f"{k}={shown(v)}" for k, v in row.items()) for row in rows[:most]]]
    return "\n".join(lines) + "\n"
