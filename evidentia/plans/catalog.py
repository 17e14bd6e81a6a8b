"""All registered queries of the reference's operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import binding_plans, collection_plans, evidence_plans, graph_plans, history_plans, incremental_plans, registry_plans, scope_plans, scoped_plans, search_plans, structure_plans, task_plans, telemetry_plans, text_plans, verdict_plans  # noqa: F401  they register their queries
from .registered import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
