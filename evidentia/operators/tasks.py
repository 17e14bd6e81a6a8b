"""Bounded scans of tasks and their histories, answers held against oracles, label checks, optimistic reads."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .durable import counted

#: Rows of a task that count; one more shows that there are too many. Fixed values.
MAX_RUNS, MAX_EVENTS = 64, 512
#: Kinds of events whose payload is read at all, and its largest length. Fixed values.
PAYLOAD_KINDS, PAYLOAD_BYTES = ("created", "pr_acceptance"), 65_536


def _capped(rows: DataFrame, order: str, cap: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("task_id").orderBy(order))).where(F.col("nth") <= cap + 1)


def project_rows(
    tasks: DataFrame, runs: DataFrame, events: DataFrame, project: str, max_runs: int = MAX_RUNS, max_events: int = MAX_EVENTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks of a project, and of each its first runs and events up to the cap and one more; payloads of the kinds that need them, unless too long."""
    own = tasks.where(F.col("project_id") == project)
    ids = own.select(F.col("id").alias("task_id"))
    payload = F.when(F.col("kind").isin(*PAYLOAD_KINDS) & (F.length("payload") <= PAYLOAD_BYTES), F.col("payload"))
    return own, _capped(runs.join(ids, "task_id", "left_semi"), "id", max_runs), _capped(
        events.join(ids, "task_id", "left_semi").withColumn("payload", payload), "id", max_events
    )


def observed(tasks: DataFrame, runs: DataFrame, events: DataFrame, project: str, max_runs: int = MAX_RUNS, max_events: int = MAX_EVENTS) -> DataFrame:
    """(task, runs, events, status): tasks of a project with what is read of them; over_limit where a cap is passed, else observed."""
    own, r, e = project_rows(tasks, runs, events, project, max_runs, max_events)
    per = lambda df, name: df.groupBy("task_id").agg(F.count("*").alias(name))
    rows = own.select(F.col("id").alias("task_id")).join(per(r, "runs"), "task_id", "left").join(per(e, "events"), "task_id", "left").fillna(0, ["runs", "events"])
    return rows.select(
        F.col("task_id").alias("task"), "runs", "events",
        F.when((F.col("runs") > max_runs) | (F.col("events") > max_events), "over_limit").otherwise("observed").alias("status")
    )


def session_rows(sessions: DataFrame, messages: DataFrame, wanted: DataFrame, counters: list[str]) -> DataFrame:
    """(id, answer, verdict) of wanted sessions (id, model, prompt): the last assistant message, and whether model, counters and exact first user prompt are as they should be.

    sessions: id, model, counters; messages: session, n, role, content. Every session is reduced to one row before the join.
    """
    of = lambda role, pick: pick(F.when(F.col("role") == role, F.struct("n", "content")))
    said = messages.groupBy(F.col("session").alias("id")).agg(of("assistant", F.max).alias("answer"), of("user", F.min).alias("asked"))
    sound = F.lit(True)
    for c in counters:
        sound = sound & F.col(c).isNotNull() & (F.col(c) >= 0)
    rows = wanted.join(sessions.select("id", F.col("model").alias("used"), sound.alias("sound")), "id", "left").join(said, "id", "left")
    verdict = F.when(F.col("used").isNull(), "session_missing").when(F.col("used") != F.col("model"), "model_mismatch").when(~F.col("sound"), "invalid_counters")
    verdict = verdict.when(
        F.col("asked").isNull() | (F.col("asked.content") != F.col("prompt")), "prompt_mismatch"
    ).when(F.col("answer").isNull(), "answer_missing").otherwise("ok")
    return rows.select("id", F.col("answer.content").alias("answer"), verdict.alias("verdict"))


def answer_verdict(answer: Column, expected: Column) -> Column:
    """pass, wrong_answer or invalid_answer for an answer text that should be {"paths": [...]}, in a fence or not, against an array of paths; order doesn't count."""
    body = F.regexp_extract(F.trim(answer), r"^```(?:json)?\s*\n([\s\S]*?)\n```$", 1)
    text = F.when(body != "", body).otherwise(F.trim(answer))
    value = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    paths = F.try_variant_get(value, "$.paths", "array<string>")
    kinds = F.from_json(F.get_json_object(text, "$.paths"), "array<string>")
    sound = value.isNotNull() & (F.size(keys) == 1) & paths.isNotNull() & kinds.isNotNull() & F.trim(F.get_json_object(text, "$.paths")).rlike(r'^\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$')
    return F.when(~F.coalesce(sound, F.lit(False)), "invalid_answer").when(F.array_sort(paths) == F.array_sort(expected), "pass").otherwise("wrong_answer")


def mentions_expected(text: Column, expected: Column, prefix: str, target: str) -> Column:
    """Whether the paths that prose mentions below a prefix, but for the target, are the expected ones; null for no text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w/-])((?:src|tests)/[A-Za-z0-9_./-]+\.js\b)"), 1))
    mine = F.filter(found, lambda p: p.startswith(prefix) & (p != target))
    return F.when(text != "", F.array_sort(mine) == F.array_sort(F.array_distinct(expected)))


def verified_labels(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(question, verdict): whether a label's cited rows (question, subject, path) are exactly those of an independent index (subject, path): verified, missing, unexpected or both.

    Each side is reduced to its different rows. What the index has of a subject is counted, not written out for each question that asks for it: of those rows the cited ones that are in the
    index are not missing. Unknown questions are equal to none, as in a join.
    """
    cited = labels.select("question", "subject", "path").distinct()
    known, _ = counted(index.select("subject", "path").where("path is not null").distinct())
    sizes, _ = counted(known.groupBy("subject").agg(F.count("*").alias("n")))
    hit = F.coalesce(F.col("k") & F.col("question").isNotNull(), F.lit(False)).cast("long")
    rows = cited.join(known.withColumn("k", F.lit(True)), ["subject", "path"], "left").groupBy("question", "subject").agg(F.count("*").alias("cited"), F.sum(hit).alias("hit"))
    agg = rows.join(sizes, "subject", "left").groupBy("question").agg(
        F.sum(F.coalesce("n", F.lit(0)) - F.col("hit")).alias("missing"), F.sum(F.col("cited") - F.col("hit")).alias("unexpected")
    )
    verdict = F.when(
        (F.col("missing") > 0) & (F.col("unexpected") > 0), "both"
    ).when(F.col("missing") > 0, "missing").when(F.col("unexpected") > 0, "unexpected").otherwise("verified")
    return agg.select("question", "missing", "unexpected", verdict.alias("verdict"))


def multiset_difference(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, missing, unexpected): how often a value is expected and not there, or there and not expected; equal counts give no row."""
    n = lambda df, name: df.groupBy(key, value).agg(F.count("*").alias(name))
    both = n(expected, "e").join(n(actual, "a"), [key, value], "full_outer").fillna(0, ["e", "a"])
    return both.where("e <> a").select(
        key, value, F.greatest(F.col("e") - F.col("a"), F.lit(0)).alias("missing"), F.greatest(F.col("a") - F.col("e"), F.lit(0)).alias("unexpected")
    )


def peer_origins(writes: DataFrame, peers: DataFrame) -> DataFrame:
    """(task, peer): pairs of tasks for which the peer's impact must be taken again: a path that the task writes (task, path) lies in what the peer watches or affects (peer, path)."""
    return writes.select("task", "path").distinct().join(peers.select("peer", "path").distinct(), "path").where("task <> peer").select("task", "peer").distinct()


class Changed(RuntimeError):
    """What was read changed while it was worked on."""


def unchanged(read: Callable[[], DataFrame], work: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """work on what read gives, written out by the caller's work; refused if a second read has other rows.

    The state of a read is one row: its count and the sum of its rows' hashes.
    """
    def state() -> tuple:
        return tuple(read().agg(F.count("*"), F.sum(F.xxhash64(*key).cast("decimal(38,0)"))).first())

    before = state()
    out = work(read())
    if state() != before:
        raise Changed("context_sources_changed")
    return out


def request_diagnostics(request: object, schema: dict[str, type]) -> list[dict]:
    """Problems of a request against the types of its properties, by name: missing, wrong_type, extra_property; not_object for anything but an object."""
    if not isinstance(request, dict):
        return [{"code": "not_object", "property": ""}]
    out = [{"code": "missing", "property": k} for k in schema if k not in request]
    out += [{"code": "wrong_type", "property": k} for k, t in schema.items() if k in request and (not isinstance(request[k], t) or t is int and isinstance(request[k], bool))]
    out += [{"code": "extra_property", "property": k} for k in request if k not in schema]
    return sorted(out, key=lambda x: (x["property"], x["code"]))


def diagnosed(rows: DataFrame, column: str, schema: dict[str, str]) -> DataFrame:
    """(codes) of requests in a JSON column, as request_diagnostics has them: 'code property' joined by ';'. schema: property to VARIANT type names (STRING, BIGINT, BOOLEAN, ARRAY, OBJECT)."""
    doc = F.try_parse_json(column)
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    kind = lambda k: F.regexp_extract(F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant")), "^[A-Z]+", 0)
    found = [F.when(
        ~F.array_contains(keys, k), F.concat(F.lit(k), F.lit(" missing"))
    ).when(kind(k) != t, F.concat(F.lit(k), F.lit(" wrong_type"))) for k, t in schema.items()]
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, schema))), lambda k: F.concat(k, F.lit(" extra_property")))
    codes = F.array_join(F.array_sort(F.concat(F.array_compact(F.array(*found)), extra)), ";")
    return rows.withColumn("codes", F.when(doc.isNull() | ~F.schema_of_variant(doc).startswith("OBJECT"), " not_object").otherwise(codes))


def witness_summary(discovered: Column, retained: Column, reasons: Column) -> Column:
    """Whether a summary of witnesses is sound: counts are not negative, no more retained than discovered, and there is a reason if, and only if, some were left out."""
    return F.coalesce((retained >= 0) & (discovered >= retained) & ((discovered > retained) == (F.size(reasons) > 0)), F.lit(False))


def strict_answer(text: str) -> dict:
    """A tool's JSON answer: one object without repeated keys or non-finite numbers; ValueError otherwise."""

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        return out

    def refuse(constant: str) -> None:
        raise ValueError(constant)

    value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def mismatches(expected: Column, got: Column, names: list[str]) -> Column:
    """Names of the fields in which two structs differ, joined by ';'."""
    return F.array_join(F.array_compact(F.array(*[F.when(~expected[n].eqNullSafe(got[n]), n) for n in names])), ";")


PROJECT_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def valid_parameter(kind: str, value: object) -> bool:
    """Whether a request's parameter is sound: project (a plain name), node or query (text of at most 500 characters)."""
    if not isinstance(value, str) or not value.strip() or re.search(r"[\x00-\x1f\x7f]", value):
        return False
    return bool(PROJECT_NAME.fullmatch(value)) if kind == "project" else len(value) <= 500
