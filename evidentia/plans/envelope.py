"""Driver-side requests and bounded answers; everything relational stays in DataFrames."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph, history, scope, search
from ..schemas import STATUS


class BadRequest(ValueError):
    """A request with unknown, missing or unbounded fields; the message is its code."""


def relative_path(value: object) -> str:
    """A canonical relative path, or BadRequest. Backslashes are taken for slashes, blanks around it and a last slash go."""
    if isinstance(value, str) and not value.strip().startswith(("/", "\\")):
        value = re.sub("/+$", "", value.strip().replace("\\", "/"))
    if not isinstance(value, str) or not 0 < len(value) <= 1024 or re.search(r"[\x00-\x1f\x7f\\]|^[A-Za-z]:", value) or any(
        p in ("", ".", "..") for p in value.split("/")
    ):
        raise BadRequest("invalid_path")
    return value


def bounded(value: object, low: int, high: int, default: int) -> int:
    if value is None:
        return default
    if type(value) is not int or not low <= value <= high:
        raise BadRequest("invalid_limit")
    return value


def clamped(value: object, default: int, low: int, high: int) -> int:
    """A number cut to its bounds, its fraction dropped; the default for what is no finite number."""
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return max(low, min(high, math.floor(number))) if math.isfinite(number) else default


def parsed_limit(value: object, default: int, low: int, high: int) -> int:
    """As clamped(), with the default for anything under 1."""
    try:
        return clamped(value, default, low, high) if float(value) >= 1 else default  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def context_request(raw: dict) -> dict:
    """Closed request of a context pack: projectId, a task with title, description, up to 32 paths and 8 symbols, and section limits of 0 to 250."""
    if not isinstance(raw, dict) or set(raw) - {"projectId", "task", "limits"}:
        raise BadRequest("unknown_field")
    task = raw.get("task")
    if not isinstance(raw.get("projectId"), str) or not raw["projectId"].strip() or not isinstance(task, dict) or set(task) - {
        "title", "description", "paths", "symbols"
    }:
        raise BadRequest("invalid_task")
    lists = {k: task.get(k, []) for k in ("paths", "symbols")}
    if any(not isinstance(v, list) or len(v) > n or len(set(map(str, v))) != len(v) for v, n in zip(lists.values(), (32, 8), strict=True)) or not all(
        isinstance(s, str) and 0 < len(s) <= 128 for s in lists["symbols"]
    ):
        raise BadRequest("invalid_task")
    if not isinstance(task.get("title", ""), str) or not isinstance(task.get("description", ""), str):
        raise BadRequest("invalid_task")
    limits = raw.get("limits", {})
    if not isinstance(limits, dict):
        raise BadRequest("invalid_limit")
    return {
        "projectId": raw["projectId"].strip(),
        "task": {
            "title": task.get("title", ""), "description": task.get("description", ""), "paths": sorted(map(relative_path, lists["paths"])),
            "symbols": sorted(lists["symbols"])
        },
        "limits": {k: bounded(v, 0, 250, 0) for k, v in limits.items()}
    }


def impact_request(raw: dict) -> dict:
    """Closed request of an impact query: projectId, up to 32 different targets, depth 1 to 5, limit 1 to 250."""
    if not isinstance(raw, dict) or set(raw) - {"projectId", "targets", "depth", "limit"}:
        raise BadRequest("unknown_field")
    if not isinstance(raw.get("projectId"), str) or not raw["projectId"].strip():
        raise BadRequest("missing_project")
    targets = raw.get("targets")
    if not isinstance(targets, list) or not 0 < len(targets) <= 32 or len(set(map(str, targets))) != len(targets):
        raise BadRequest("invalid_targets")
    return {
        "projectId": raw["projectId"].strip(), "targets": sorted(map(relative_path, targets)), "depth": bounded(raw.get("depth"), 1, 5, 2),
        "limit": bounded(raw.get("limit"), 1, 250, 100)
    }


def size_of(value: object) -> int:
    return len(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode())


def trim(answer: dict, section: str, most: int) -> dict:
    """The answer with the longest head of one section that keeps its JSON within `most` bytes, and whether it was cut."""
    items = answer[section]
    low, high = 0, len(items)
    made = lambda n: answer | {section: items[:n], "truncated": n < len(items)}
    while low < high:  # sizes grow with n
        mid = (low + high + 1) // 2
        low, high = (mid, high) if size_of(made(mid)) <= most else (low, mid - 1)
    return made(low)


def trim_longest(lists: dict[str, list], most: int) -> dict[str, list]:
    """Lists shortened, the longest first, until their JSON fits; ties by name."""
    out = {k: list(v) for k, v in lists.items()}
    while size_of(out) > most and any(out.values()):
        out[min(out, key=lambda k: (-len(out[k]), k))].pop()
    return out


def with_status(result: DataFrame, reasons: list[str] = (), evaluated: bool = True) -> DataFrame:
    """One row beside a result: an empty result is not the same as one that was not evaluated."""
    spark: SparkSession = result.sparkSession
    if not evaluated:
        return spark.createDataFrame([("unavailable", "not_evaluated", sorted(set(reasons)))], STATUS)
    found = "evidence_found" if result.head(1) else "no_evidence_found"
    return spark.createDataFrame([("partial" if reasons else "available", found, sorted(set(reasons)))], STATUS)


#: Analyzers by project type: functions of a files DataFrame that return nodes and edges.
ANALYZERS: dict[str, Callable] = {}


def register_analyzer(project_type: str, analyze: Callable) -> None:
    if project_type in ANALYZERS:
        raise BadRequest("analyzer_exists")
    ANALYZERS[project_type] = analyze


#: Evidence producers by question.
QUESTIONS: dict[str, Callable] = {
    "symbol": search.located, "impact": graph.file_impact, "tests": scope.test_candidates, "history": history.changes,
    "validated_history": history.active_receipts
}


def ask(question: str, *args) -> DataFrame:
    """Dispatch a bounded question (symbol, tests, impact, history) to the producer registered for it."""
    if question not in QUESTIONS:
        raise BadRequest("unsupported_question")
    return QUESTIONS[question](*args)
