"""Requests in, bounded answers out: the tools that an agent may call, and one handler that turns refusals into codes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explorer, graph, impact, search, verdicts
from ..operators.tasks import Changed
from . import context
from .envelope import BadRequest, context_request, impact_request, parsed_limit

#: Tools by name with the properties of their closed requests.
TOOLS = {
    "project_task_context": ("projectId", "task", "limits"), "project_impact": ("projectId", "targets", "depth", "limit"),
    "search": ("projectId", "query", "limit"), "expand": ("projectId", "node"), "effective_task_scope": ("projectId", "task")
}


@dataclass
class Project:
    """What a project's requests read: its tables, and the snapshot that they are of."""

    tables: dict[str, DataFrame]
    snapshot: str = ""


def effective_task_scope(project: Project, task: dict, depth: int = 2) -> DataFrame:
    """(task, path, category, rule): the scope of a task from its own impact: what it writes, and what lies in reach of that."""
    spark = project.tables["nodes"].sparkSession
    paths = spark.createDataFrame([(p,) for p in task["paths"]], "path string")  # a bounded request
    origins = paths.select(F.col("path").alias("origin"), F.col("path").alias("file"))
    found = impact.affected(
        impact.with_witnesses(
            graph.file_impact(project.tables["nodes"], project.tables["edges"], origins, depth), project.tables["nodes"], project.tables["edges"],
            project.snapshot
        )
    )
    name = F.lit(task.get("title", ""))
    affected = found.select(
        name.alias("task"), F.col("file").alias("path"), "distance", F.col("cut").alias("truncated"),
        F.lit("local_implementation").alias("semantics"), F.lit(False).alias("deletes")
    )
    gated = spark.createDataFrame([(task.get("title", ""), "available")], "task string, status string")
    return verdicts.effective_scope(gated, paths.select(name.alias("task"), "path"), affected, affected.select("task", "path").limit(0))


def _rows(df: DataFrame, limit: int) -> dict:
    found = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return {"items": found[:limit], "truncated": len(found) > limit}


def _impact(project: Project, body: dict) -> dict:
    asked = impact_request(body)
    spark = project.tables["nodes"].sparkSession
    origins = spark.createDataFrame([(t, t) for t in asked["targets"]], "origin string, file string")
    parts = impact.project_impact(project.tables["nodes"], project.tables["edges"], origins, asked["depth"], project.snapshot, limit=asked["limit"])
    return {
        "affectedFiles": _rows(parts["files"].orderBy("place").select("file", "distance", "origins"), asked["limit"]),
        "affectedTests": _rows(parts["tests"].orderBy("place").select("file", "distance"), asked["limit"]),
        "targets": _rows(parts["origins"].orderBy("origin"), 32)
    }


def _context(project: Project, body: dict) -> dict:
    asked = context_request(body)
    return context.context_pack(asked["projectId"], asked["task"], project.tables, asked["limits"])


def _search(project: Project, body: dict) -> dict:
    if not isinstance(body.get("query"), str) or not 0 < len(body["query"]) <= 500:
        raise BadRequest("invalid_record")
    limit = parsed_limit(body.get("limit"), 12, 1, 100)
    return _rows(search.tiered(project.tables["nodes"], body["query"], limit), limit)


def _expand(project: Project, body: dict) -> dict:
    if type(body.get("node")) is not int:
        raise BadRequest("invalid_record")
    nodes, edges = explorer.isolated(project.tables["nodes"], project.tables["edges"], body["node"])
    return {"nodes": _rows(nodes.select("id", "label").orderBy("id"), 36), "edges": _rows(edges.orderBy("src", "dst", "relation"), 36)}


def _scope(project: Project, body: dict) -> dict:
    asked = context_request(body)
    return _rows(effective_task_scope(project, asked["task"]).orderBy("path"), 320)


HANDLERS: dict[str, Callable[[Project, dict], dict]] = {
    "project_task_context": _context, "project_impact": _impact, "search": _search, "expand": _expand, "effective_task_scope": _scope
}


def handle(tool: str, body: object, projects: dict[str, Project], handlers: dict[str, Callable[[Project, dict], dict]] | None = None) -> tuple[int, dict]:
    """(status, answer) of a tool's request; handlers may be replaced. Refusals give their code, anything else is 500 without details."""
    known = HANDLERS if handlers is None else handlers
    try:
        if tool not in known:
            raise BadRequest("unsupported_question")
        if not isinstance(body, dict) or set(body) - set(TOOLS.get(tool, body)):
            raise BadRequest("unknown_field")
        if body.get("projectId") not in projects:
            raise BadRequest("project_not_found")
        return 200, known[tool](projects[body["projectId"]], context.bounded_json(body))
    except (BadRequest, Changed) as refused:
        return context.http_status(refused), {"error": str(refused)}
    except Exception:  # noqa: BLE001  the caller learns that it failed, the log has the rest
        return 500, {"error": "internal_error"}
