"""Context packs, task briefs, analyses by project type, and a cache of analyses: driver-side answers over bounded DataFrames."""

from __future__ import annotations

import hashlib
import json
import re
import time
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import explorer, graph, scope, search
from .envelope import BadRequest, relative_path, size_of

#: Rows of each section of a pack where the request names no limit, and the sections in the order in which they are cut. Fixed values.
LIMITS = {"references": 40, "symbols": 24, "files": 20, "tests": 16, "documents": 12, "workspaces": 8, "constraints": 8, "diagnostics": 20}
CUT_ORDER = tuple(LIMITS)
#: Lists of a brief: usual and largest lengths; the text's bytes. Fixed values.
BRIEF = {"symbols": (12, 24), "affectedFiles": (20, 80), "testCandidates": (8, 16), "textBytes": (2048, 8192)}


def _explicit(path: Column, paths: list[str]) -> Column:
    hit = F.lit(False)
    for p in paths:
        hit = hit | search.within(path, F.lit(p))
    return hit


def section_rows(task: dict, files: DataFrame, nodes: DataFrame, edges: DataFrame, documents: DataFrame, workspaces: DataFrame) -> dict[str, DataFrame]:
    """The rows of each section that a task calls for, in their order, not yet limited.

    task: title, description, paths, symbols; files: path, byte_size, sha256; nodes: id, label, kind, file; edges: src, dst, relation; documents: kind, path, title; workspaces: id, path, folder. Seeds are nodes of the task's
    paths or symbols, or without both those whose name has a term of the request; their direct neighbours come after them.
    """
    paths, symbols = task.get("paths") or [], task.get("symbols") or []
    terms = codes.terms_of(task.get("title", ""), task.get("description", ""))
    open_ended = not paths and not symbols
    known = nodes.where(codes.symbol_label(F.col("label")) & (F.col("kind") != "module")).join(files.select(F.col("path").alias("file")), "file", "left_semi")
    known = known.join(known.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id"), "id", "left_semi")
    wanted = _explicit(F.col("file"), paths) | (F.col("label").isin(symbols) if symbols else F.lit(False)) | (codes.lexical(F.col("label"), terms) if open_ended else F.lit(False))
    seeds = known.where(wanted).select("id")
    inside = graph.induced(edges, known.select("id"))
    references = graph.closure_of_references(inside, seeds)
    near = references.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(seeds).distinct()
    chosen = known.join(near, "id", "left_semi").join(seeds.withColumn("seed", F.lit(True)), "id", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    base = F.element_at(F.split("path", "/"), -1)
    named = codes.lexical(base, terms) if open_ended else F.lit(False)
    touched = chosen.select(F.col("file").alias("path")).distinct().withColumn("t", F.lit(True))
    targets = files.join(touched, "path", "left").where(F.coalesce("t", F.lit(False)) | _explicit(F.col("path"), paths) | named).drop("t")
    tests = scope.tests_of(files, targets)
    standing = F.col("path").isin("PROJECT.md", "AGENTS.md", "CONTEXT.md", "docs/CURRENT_STATUS.md")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    above = F.lit(False)
    for p in paths:
        above = above | search.within(F.lit(p), F.when(folder == "", ".").otherwise(folder))
    docs = documents.where(
        standing | _explicit(F.col("path"), paths) | F.when(F.col("kind") == "adr", codes.lexical(F.concat_ws(" ", "path", "title"), terms)).otherwise(above)
    )
    covers = F.lit(False)
    for p in paths:
        covers = covers | search.within(F.lit(p), F.col("folder"))
    return {
        "references": references.orderBy("src", "dst", "relation"),
        "symbols": chosen.select("id", "label", "kind", "file", "seed").orderBy(F.desc("seed"), "file", "label", "id"),
        "files": targets.select("path", "byte_size", "sha256").orderBy("path"),
        "tests": tests.select("path").orderBy("path"),
        "documents": docs.select("kind", "path", "title").orderBy("path"),
        "workspaces": workspaces.where(covers).select("id", "path").orderBy("id"),
    }


def section(rows: DataFrame, limit: int) -> dict:
    """A section's first rows, its limit, whether there were more, and its status; one row over the limit is asked for to tell."""
    found = [r.asDict() for r in rows.limit(limit + 1).collect()]
    return {"items": found[:limit], "limit": limit, "truncated": len(found) > limit, "status": "available" if found else "empty"}


def context_pack(project: str, task: dict, tables: dict[str, DataFrame], limits: dict[str, int] | None = None, most_bytes: int = 131_072) -> dict:
    """A bounded context pack: sections with their limits, cut from the end of the least important one until its JSON fits, and a content id."""
    task = {
        "title": str(task.get("title", "")), "description": str(task.get("description", "")),
        "paths": sorted(map(relative_path, task.get("paths") or [])), "symbols": sorted(task.get("symbols") or [])
    }
    limits = LIMITS | (limits or {})
    if set(limits) - set(LIMITS) or any(type(n) is not int or not 0 <= n <= 250 for n in limits.values()):
        raise BadRequest("invalid_limit")
    rows = section_rows(task, *(tables[t] for t in ("files", "nodes", "edges", "documents", "workspaces")))
    sections = {name: section(df, limits[name]) for name, df in rows.items()}
    pack = {
        "schemaVersion": 1, "projectId": project, "task": task, "sections": sections, "incomplete": any(s["truncated"] for s in sections.values()),
        "contextPackId": "context_" + "0" * 64
    }
    for name in CUT_ORDER:
        part = sections.get(name)
        while part and part["items"] and size_of(pack) > most_bytes:
            part["items"].pop()
            part["truncated"] = pack["incomplete"] = True
            part["status"] = part["status"] if part["items"] else "omitted"
    if size_of(pack) > most_bytes:
        raise BadRequest("context_budget_exceeded")
    return pack | {"contextPackId": "context_" + hashlib.sha256(codes.canonical(pack | {"contextPackId": None}).encode()).hexdigest()}


def _label(value: object) -> str:
    if not isinstance(value, str) or not 0 < len(value) <= 1024 or any(unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp") for c in value):
        raise BadRequest("task_brief_evidence_invalid")
    return value if re.fullmatch(r"[A-Za-z0-9_./$-]+", value) else json.dumps(value, ensure_ascii=False)


def task_brief(pack: dict, impact: dict, limits: dict[str, int] | None = None) -> str:
    """A task's symbols, affected files and test candidates as a few lines of bounded text; pack and impact must be of one snapshot and task.

    impact: snapshotToken, paths, status, finding, incomplete, affectedFiles, testCandidates (null if not asked for). Lists lose their last items, the longest list first, until the text fits.
    """
    values = {k: usual for k, (usual, _) in BRIEF.items()} | (limits or {})
    if set(values) != set(BRIEF) or any(type(n) is not int or not (256 if k == "textBytes" else 0) <= n <= BRIEF[k][1] for k, n in values.items()):
        raise BadRequest("invalid_task_brief")
    if pack.get("snapshotToken") != impact.get("snapshotToken") or sorted(pack["task"]["paths"]) != sorted(impact["paths"]):
        raise BadRequest("task_brief_evidence_mismatch")
    tests = impact.get("testCandidates")
    whole = {
        "symbols": [f"{_label(s['label'])}@{_label(s['file'])}" for s in pack["sections"]["symbols"]["items"]],
        "affectedFiles": [*map(_label, impact["affectedFiles"])], "testCandidates": [*map(_label, tests or [])]
    }
    shown = {k: v[: values[k]] for k, v in whole.items()}

    def text() -> str:
        cut = "; briefTruncated=true" if any(len(shown[k]) < len(whole[k]) for k in shown) else ""
        tested = "Tests " + ", ".join(shown["testCandidates"]) if tests is not None else "Tests (not requested)"
        return "\n".join([
            "Symbols " + ", ".join(shown["symbols"]), "Affected " + ", ".join(shown["affectedFiles"]), tested,
            f"Coverage {impact['status']}; {impact['finding']}; sourceIncomplete={json.dumps(bool(impact['incomplete'] or pack['incomplete']))}{cut}"
        ])

    while len(text().encode()) > values["textBytes"] and any(shown.values()):
        shown[max(shown, key=lambda k: (len(shown[k]), k))].pop()
    if len(text().encode()) > values["textBytes"]:
        raise BadRequest("task_brief_budget_exceeded")
    return text()


def input_budget(most_part: int = 131_072, most: int = 327_680, **parts: object) -> None:
    """Refuse evidence whose context pack or impact, or all of it together, is too large as JSON."""
    if any(size_of(parts[k]) > most_part for k in ("pack", "impact") if k in parts) or size_of(parts) > most:
        raise BadRequest("scope_budget_exceeded")


def bounded_json(value: object, depth: int = 32, most: int = 20_000) -> object:
    """A copy of plain JSON data, refused beyond a depth or number of values, or if it holds anything else."""
    count = 0

    def copy(node: object, level: int) -> object:
        nonlocal count
        count += 1
        if level > depth or count > most:
            raise BadRequest("scope_budget_exceeded")
        if node is None or isinstance(node, bool | str | int) or isinstance(node, float) and node - node == 0:
            return node
        if type(node) is list:
            return [copy(x, level + 1) for x in node]
        if type(node) is dict and all(type(k) is str for k in node):
            return {k: copy(x, level + 1) for k, x in node.items()}
        raise BadRequest("invalid_record")

    return copy(value, 0)


@dataclass
class Analysis:
    """What is known of one snapshot: nodes and edges, persisted while it is cached."""

    nodes: DataFrame
    edges: DataFrame
    made: float
    used: float
    hits: int = 0


@dataclass
class AnalysisCache:
    """Analyses by snapshot token: kept for a time, the least recently used one goes beyond `most`; a dropped one is unpersisted."""

    most: int = 12
    seconds: float = 600.0
    clock: Callable[[], float] = time.monotonic
    kept: dict[tuple[str, str], Analysis] = field(default_factory=dict)
    misses: int = 0

    def get(self, project: str, token: str | None, analyze: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        """The analysis of a project's snapshot; without a token (an unclean tree) nothing is kept."""
        now = self.clock()
        found = self.kept.get((project, token or ""))
        if token and found and now - found.made < self.seconds:
            found.used, found.hits = now, found.hits + 1
            return found.nodes, found.edges
        self.misses += 1
        nodes, edges = analyze()
        if token:
            self.clear(project)
            self.kept[project, token] = Analysis(nodes.persist(), edges.persist(), now, now)
            while len(self.kept) > self.most:
                self._drop(min(self.kept, key=lambda k: self.kept[k].used))
        return nodes, edges

    def _drop(self, key: tuple[str, str]) -> None:
        gone = self.kept.pop(key)
        gone.nodes.unpersist()
        gone.edges.unpersist()

    def clear(self, project: str | None = None) -> dict[str, int]:
        """Drop the entries of a project, or all; how many went and how many are left."""
        doomed = [k for k in self.kept if project is None or k[0] == project]
        for k in doomed:
            self._drop(k)
        return {"removed": len(doomed), "remaining": len(self.kept)}

    def statistics(self) -> dict:
        now = self.clock()
        entries = [{"project": p, "token": t, "age": now - a.made, "expired": now - a.made >= self.seconds, "hits": a.hits} for (p, t), a in sorted(self.kept.items())]
        return {"size": len(entries), "hits": sum(e["hits"] for e in entries), "misses": self.misses, "entries": entries}


def cache_identity(project: str, revision: dict) -> tuple[str, bool]:
    """(key, reusable): a digest of project and revision; reusable for a clean checkout, or where there is no version control at all."""
    key = hashlib.sha256(codes.canonical([project, {k: revision.get(k) for k in ("status", "commitSha", "dirty", "worktreeId")}]).encode()).hexdigest()
    return key, revision.get("status") == "not_git" or revision.get("status") == "available" and revision.get("dirty") is False


class Analyzer:
    """One door to the operators on a project's graph; what a provider doesn't support is said, not guessed."""

    def __init__(self, nodes: DataFrame | None, edges: DataFrame | None, capabilities: set[str] = frozenset({"search", "expand", "graph", "impact", "context"})):
        self.nodes, self.edges, self.capabilities = nodes, edges, capabilities
        self.operations: dict[str, Callable[..., DataFrame]] = {
            "search": lambda text, limit=12: search.tiered(nodes, text, limit), "expand": lambda node: graph.expand(nodes, edges, node), "graph": lambda node_limit=500, edge_limit=1200: explorer.admitted(nodes, edges, node_limit, edge_limit)[1],
            "impact": lambda node, depth=2, limit=80: graph.impact_score(nodes, edges, node, depth, limit), "context": lambda node, limit=40: explorer.context(nodes, edges, node, limit)[0],
        }

    def ask(self, operation: str, *args, **options) -> tuple[str, DataFrame | None]:
        """(status, rows): available with rows, or unsupported with none."""
        if operation not in self.operations or operation not in self.capabilities or self.nodes is None:
            return "unsupported", None
        return "available", self.operations[operation](*args, **options)


#: Codes of refused requests and the HTTP status that tells of them; anything else is 500. Fixed values.
STATUS_OF = {
    400: ("invalid_path", "invalid_limit", "unknown_field", "missing_project", "invalid_targets", "invalid_task_brief", "invalid_record", "unsupported_question"),
    404: ("project_unavailable", "project_not_found"), 409: (
        "context_sources_changed", "context_revision_changed", "context_project_changed", "task_brief_evidence_mismatch"
    ),
    413: ("scope_budget_exceeded", "context_budget_exceeded", "task_brief_budget_exceeded", "impact_budget_exceeded"),
}


def http_status(error: Exception) -> int:
    """Status of a refused request by its code."""
    return next((status for status, known in STATUS_OF.items() if str(error) in known), 500)
