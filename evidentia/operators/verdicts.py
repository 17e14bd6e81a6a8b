"""Verdicts over bound evidence: ordered checks whose first failure is the answer, as columns over tables of witnesses, scopes and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scope
from .search import prefixes


def first_of(checks: list[tuple[str, Column]], otherwise: str) -> Column:
    """The code of the first condition that holds."""
    out = F.lit(otherwise)
    for code, failed in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), code).otherwise(out)
    return out


def same(a: Column, b: Column) -> Column:
    """Equal and present: two nulls are not the same."""
    return F.coalesce(a == b, F.lit(False))


# Declarations


def declaration_verdict(files: DataFrame, declared: DataFrame, names: DataFrame, ceiling: int = 256, most: int = 131_072) -> DataFrame:
    """(task, name, matches, verdict) for each queried name (task, name) over the declarations (task, path, name) of a task's files (task, path, byte_size, parsed, sha256, bound).

    Not evaluated if the task has no file, a file is too large or differs from the hash that binds it; with a file that did not parse two and more matches are still ambiguous, fewer
    partial; beyond the ceiling partial; else unique, ambiguous or not_found.
    """
    state = files.groupBy("task").agg(
        F.max(F.col("byte_size") > most).alias("large"), F.max(~same(F.col("sha256"), F.col("bound"))).alias("unbound"),
        F.max(~F.col("parsed")).alias("broken")
    )
    n = declared.join(names, ["task", "name"], "left_semi").groupBy("task", "name").agg(F.count("*").alias("matches"))
    rows = names.join(state, "task", "left").join(n, ["task", "name"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    several = F.col("matches") >= 2
    verdict = first_of([
        ("not_evaluated", F.col("large").isNull() | F.col("large") | F.col("unbound")), ("ambiguous", F.col("broken") & several), ("partial", F.col("broken")),
        ("partial", F.col("matches") > ceiling), ("ambiguous", several), ("not_found", F.col("matches") == 0),
    ], "resolved_unique")
    return rows.select("task", "name", "matches", verdict.alias("verdict"))


def completeness_witness(names: DataFrame, paths: DataFrame, declared: DataFrame, languages: list[str], most_names: int = 8) -> DataFrame:
    """(task, names, paths, reason, holds): whether every required name (task, name) was looked for in every bound path (task, path, language, bound) of its task, and is declared once.

    Reasons in order of priority: binding_mismatch, name_list_truncated, uncovered_language, path_unevaluated; a witness without one holds if all its names are unique.
    """
    asked = names.groupBy("task").agg(F.countDistinct("name").alias("names"))
    seen = paths.groupBy("task").agg(
        F.count("*").alias("paths"), F.min(F.col("bound")).alias("bound"), F.min(F.col("language").isin(languages)).alias("covered"),
        F.min(F.col("language").isNotNull()).alias("known")
    )
    hits = declared.join(names.distinct(), ["task", "name"], "left_semi").groupBy("task", "name").agg(F.count("*").alias("n"))
    unique = hits.groupBy("task").agg(F.sum((F.col("n") == 1).cast("long")).alias("unique"))
    rows = asked.join(seen, "task", "left").join(unique, "task", "left")
    reason = first_of([
        ("binding_mismatch", F.col("paths").isNull() | ~F.col("bound")), ("name_list_truncated", F.col("names") > most_names),
        ("path_unevaluated", ~F.col("known") & F.coalesce(F.col("covered"), F.lit(True))), ("uncovered_language", ~F.coalesce(F.col("covered"), F.lit(False))),
    ], "")
    return rows.select(
        "task", "names", F.coalesce("paths", F.lit(0)).alias("paths"), reason.alias("reason"),
        ((reason == "") & F.coalesce(F.col("unique") == F.col("names"), F.lit(False))).alias("holds")
    )


#: Codes of a consumed witness, in the order of its checks. Fixed values.
WITNESS_CODES = (
    "symbol_target_evidence_missing", "symbol_target_domain_unsupported", "symbol_target_binding_mismatch", "symbol_target_evidence_inconsistent",
    "symbol_target_completeness_not_established", "symbol_target_uniqueness_not_established"
)


def witness_verdict(witnesses: DataFrame, evaluations: DataFrame, required: DataFrame) -> DataFrame:
    """(task, code) for each required (task, names, paths, project, snapshot; arrays): whether its witness is admitted; code is ok or the first check that fails.

    witnesses: task, domain, names, paths, project, snapshot, complete, unique; evaluations: task, name, path, snapshot. Arrays are compared as sets of their elements, evaluations
    must give each name once, within the paths and of the witness's snapshot. Several witnesses of a task are as none.
    """
    keys = F.struct("domain", "names", "paths", "project", "snapshot", "complete", "unique")
    one = witnesses.groupBy("task").agg(F.count("*").alias("n"), F.min(keys).alias("w")).where("n = 1").select("task", "w")
    told = evaluations.groupBy("task").agg(
        F.array_sort(F.collect_list("name")).alias("told"), F.collect_set("path").alias("told_paths"),
        F.collect_set("snapshot").alias("told_snapshots")
    )
    rows = required.join(one, "task", "left").join(told, "task", "left")
    alike = lambda a, b: same(F.array_sort(F.array_distinct(a)), F.array_sort(F.array_distinct(b)))
    bound = alike(F.col("w.names"), F.col("names")) & alike(F.col("w.paths"), F.col("paths")) & same(F.col("w.project"), F.col("project")) & same(F.col("w.snapshot"), F.col("snapshot"))
    agree = same(F.col("told"), F.array_sort("names")) & (F.size(F.array_except("told_paths", "paths")) == 0) & same(F.col("told_snapshots"), F.array("snapshot"))
    missing, domain, binding, inconsistent, complete, unique = WITNESS_CODES
    code = first_of([
        (missing, F.col("w").isNull()), (
            domain, ~same(F.col("w.domain"), F.lit("typescript-direct-declarations"))
        ), (binding, ~bound), (inconsistent, F.col("told").isNull()),
        (binding, ~F.coalesce(agree, F.lit(False))), (
            inconsistent, F.col("w.unique") & ~F.col("w.complete")
        ), (complete, ~F.col("w.complete")), (unique, ~F.col("w.unique")),
    ], "ok")
    return rows.select("task", code.alias("code"))


def shared_declarations(left: DataFrame, right: DataFrame, same_snapshot: bool) -> DataFrame:
    """(path, name, hash): declarations (path, name, hash, declaration) that both sides have with the same source; within one snapshot the same declaration too."""
    b = right.select("path", "name", "hash", F.col("declaration").alias("other"))
    both = left.join(b, ["path", "name", "hash"])
    return (both.where("declaration = other") if same_snapshot else both).select("path", "name", "hash").distinct()


# Files to delete, create and move

#: Verdicts about a file to be created, the strongest first. Fixed values.
ABSENCE_RANK = ("exists", "parent_absent", "ancestor_boundary", "unknown", "absent")


def delete_verdict(targets: DataFrame, context: DataFrame, impact: DataFrame) -> DataFrame:
    """(task, path, code) of files to be deleted (task, path): bound if the context's hash (task, path, hash) equals the impact's (task, path, hash, status), else the first reason."""
    a, b = context.select("task", "path", F.col("hash").alias("a")), impact.select("task", "path", F.col("hash").alias("b"), "status")
    rows = targets.distinct().join(a, ["task", "path"], "left").join(b, ["task", "path"], "left")
    code = first_of([
        ("delete_source_not_evaluated", F.col("a").isNull()), ("delete_target_not_evaluated", F.col("status").isNull() | ~F.col("status").isin("available", "partial")),
        ("delete_hash_mismatch", ~same(F.col("a"), F.col("b"))), ("delete_target_partial", F.col("status") == "partial"),
    ], "bound")
    return rows.select("task", "path", code.alias("code"))


def absence(targets: DataFrame, listings: DataFrame, folders: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(path, verdict) of files to be created, from one listing of each folder.

    listings: folder, name; folders: folder, complete; boundaries: folder (roots of other projects). Verdicts in order: a boundary on the way, no such parent, an incomplete or empty listing
    (unknown, never absent), the name is there, a name that differs in case only or a short-name form (unknown), absent.
    """
    folder, name = F.regexp_replace("path", r"/?[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    rows = targets.select("path").distinct().withColumns({"folder": folder, "name": name})
    named = listings.groupBy("folder").agg(F.count("*").alias("n"))
    state = folders.select("folder", "complete", F.lit(True).alias("there")).join(named, "folder", "left")
    exact = listings.select("folder", "name", F.lit(True).alias("exact")).distinct()
    alike = listings.select("folder", F.lower("name").alias("low"), F.lit(True).alias("alike")).distinct()
    crossed = rows.select(
        "path", F.explode(prefixes(F.col("path"))).alias("folder")
    ).join(boundaries.select("folder").distinct(), "folder").select("path", F.lit(True).alias("crossed")).distinct()
    rows = rows.withColumn("low", F.lower("name")).join(state, "folder", "left").join(exact, ["folder", "name"], "left").join(alike, ["folder", "low"], "left").join(crossed, "path", "left")
    verdict = first_of([
        ("ancestor_boundary", F.col("crossed")), ("parent_absent", F.col("there").isNull()), (
            "unknown", ~F.col("complete") | F.col("n").isNull()
        ), ("exists", F.col("exact")),
        ("unknown", F.col("alike") | F.col("name").rlike("~[0-9]")),
    ], "absent")
    return rows.select("path", verdict.alias("verdict"))


def create_verdict(verdicts: DataFrame) -> DataFrame:
    """(task, code): one code for all files that a task creates (task, path, verdict): the strongest of ABSENCE_RANK, lifted if all are absent."""
    rank = F.array_position(F.array(*map(F.lit, ABSENCE_RANK)), F.col("verdict"))
    low = F.min(rank)
    code = F.element_at(F.array(*[F.lit(c) for c in ("destination_exists", "parent_absent", "ancestor_boundary", "not_proven", "lifted")]), low.cast("int"))
    return verdicts.groupBy("task").agg(code.alias("code"))


def operation_verdict(moves: DataFrame, tree: DataFrame, absences: DataFrame) -> DataFrame:
    """(path, moved, verdict) of files to be moved (path, moved): the source must be in the tree (path), no two go to one place, and the destination must be absent (path, verdict)."""
    known = tree.select("path", F.lit(True).alias("there")).distinct()
    n = moves.groupBy("moved").agg(F.count("*").alias("n"))
    rows = moves.join(known, "path", "left").join(n, "moved").join(absences.select(F.col("path").alias("moved"), "verdict"), "moved", "left")
    verdict = first_of(
        [
            ("source_missing", F.col("there").isNull()), ("destination_shared", F.col("n") > 1),
            ("destination_not_observed", F.col("verdict").isNull()), ("destination_exists", F.col("verdict") == "exists"),
            ("not_proven", F.col("verdict") != "absent")
        ],
        "ready"
    )
    return rows.select("path", "moved", verdict.alias("verdict"))


# Scopes


#: Checks of a scope request against its evidence, in order. Fixed values.
SCOPE_GATES = (
    "task_echo_mismatch", "project_identity_mismatch", "worktree_locator_mismatch", "revision_binding_mismatch", "repository_identity_mismatch",
    "worktree_identity_mismatch", "snapshot_token_mismatch", "provider_mismatch", "origin_set_mismatch"
)


def scope_gate(requests: DataFrame) -> DataFrame:
    """(task, status, code) of scope requests joined with their evidence, one row each.

    Columns: task, and for the request (r), context pack (p) and impact (i) structs of task, paths, project, locator, revision (commit, branch, dirty, linked, status), repository, worktree; p and i also
    snapshot and provider, i origins. The first gate that fails rejects; then an observation that says nothing is not evaluated, one that moved on is stale, one that isn't a clean linked worktree is not evaluated.
    """
    f = F.col
    both = lambda k: same(f(f"p.{k}"), f(f"i.{k}"))
    all3 = lambda k: same(f(f"r.{k}"), f(f"p.{k}")) & both(k)
    revision = ("commit", "dirty", "linked", "status")
    coherent = F.lit(True)
    for k in (*revision, "branch"):
        coherent = coherent & f(f"p.revision.{k}").eqNullSafe(f(f"i.revision.{k}"))
    moved = F.lit(False)
    for k in (*revision, "branch"):
        moved = moved | ~f(f"p.revision.{k}").eqNullSafe(f(f"r.revision.{k}"))
    sets = same(F.array_sort(f("r.paths")), F.array_sort(f("i.origins")))
    echo = same(f("r.task"), f("p.task")) & same(F.array_sort(f("r.paths")), F.array_sort(f("p.paths")))
    gates = dict(zip(
        SCOPE_GATES,
        (echo, all3("project"), all3("locator"), coherent, all3("repository"), all3("worktree"), both("snapshot"), both("provider"), sets),
        strict=True
    ))
    rejected = first_of([(code, ~ok) for code, ok in gates.items()], "")
    silent = f("r.revision.status").isin("unavailable", "unborn", "not_git") | f("r.revision.dirty").isNull() | f("r.revision.commit").isNull() | f("r.revision.linked").isNull()
    unclean = (f("r.revision.status") != "available") | f("r.revision.dirty") | ~f("r.revision.linked")
    status = F.when(rejected != "", "rejected").otherwise(first_of([("not_evaluated", silent), ("stale", moved), ("not_evaluated", unclean)], "available"))
    code = F.when(rejected != "", rejected).otherwise(
        first_of([("working_tree_observation_only", silent), ("scope_stale", moved), ("working_tree_observation_only", unclean)], "")
    )
    return requests.select("task", status.alias("status"), code.alias("code"))


def effective_scope(gated: DataFrame, writes: DataFrame, affected: DataFrame, reserved: DataFrame) -> DataFrame:
    """(task, path, category, rule) of tasks that pass their gate.

    writes: task, path; affected: task, path, distance, truncated, semantics, deletes; reserved: task, path, of a proven strong coupling. A path that a task writes is write whatever else it is; a reserved one
    is reserved unless written; the rest is watch or impact.
    """
    ok = gated.where("status = 'available'").select("task")
    asked = writes.select("task", "path").distinct().withColumn("writes", F.lit(True))
    held = reserved.select("task", "path").distinct().withColumn("reserved", F.lit(True))
    rows = asked.join(affected, ["task", "path"], "full_outer").join(held, ["task", "path"], "full_outer").join(ok, "task", "left_semi")
    rows = rows.withColumns({"writes": F.coalesce("writes", F.lit(False)), "reserved": F.coalesce("reserved", F.lit(False))})
    category, rule = scope.classify(
        *(F.coalesce(F.col(c), d) for c, d in (
            ("distance", F.lit(99)), ("truncated", F.lit(False)), ("semantics", F.lit("local_implementation")), ("writes", F.lit(False)),
            ("deletes", F.lit(False))
        ))
    )
    return rows.select(
        "task", "path", F.when(F.col("writes"), "write").when(F.col("reserved"), "reserved").otherwise(category).alias("category"),
        F.when(F.col("writes"), "declared_write").when(F.col("reserved"), "strong_coupling").otherwise(rule).alias("rule"),
    )


def shared_write_evidence(overlaps: DataFrame, left: DataFrame, right: DataFrame, distinct_commits: bool) -> DataFrame:
    """Overlaps of sibling worktrees that evidence bears out, with their severity: a write on both sides counts with both hashes known.

    overlaps: path, left_category, right_category, severity; left, right: path, hash, as each side's own impact has them. Equal hashes keep the severity; different ones are a warning if the commits differ, else nothing is proven. Other pairs
    count only where proven, so they are left out.
    """
    rows = overlaps.join(left.select("path", F.col("hash").alias("a")), "path").join(
        right.select("path", F.col("hash").alias("b")), "path"
    ).where("left_category = 'write' and right_category = 'write'")
    return rows.where(same(F.col("a"), F.col("b")) | F.lit(distinct_commits)).withColumn(
        "severity", F.when(F.col("a") == F.col("b"), F.col("severity")).otherwise("warning")
    )


def conflict_verdict(overlaps: DataFrame, incomplete: list[str] = (), most: int = 16, distinct_commits: bool = False) -> tuple[DataFrame, DataFrame]:
    """(verdict, overlaps shown): one row with status, finding, severity, action, total, whether it was cut, whether to look again, and the reasons; and the first `most`
    overlaps, the gravest first, then by path.
    """
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    shown = overlaps.withColumn("rank", rank).orderBy("rank", "path").limit(most).drop("rank")
    one = overlaps.agg(F.count("*").alias("total"), F.min(rank).alias("rank"))
    cut = F.col("total") > most
    reasons = F.array_sort(
        F.array_distinct(F.concat(
            F.array(*map(F.lit, incomplete)).cast("array<string>"),
            F.when(cut, F.array(F.lit("overlap_limit"))).otherwise(F.array().cast("array<string>"))
        ))
    )
    unsure = F.size(reasons) > 0
    severity = F.when(F.col("rank").isNotNull(), F.element_at(F.array(F.lit("high"), F.lit("warning"), F.lit("info")), F.col("rank") + 1)).when(~unsure, "none")
    action = F.when(severity == "high", "serialize").when(severity == "warning", "revalidate").when(unsure, "reobserve").otherwise("none")
    verdict = one.select(
        F.when(unsure, "incomplete").otherwise("available").alias("status"), F.when(F.col("total") > 0, "overlap_observed").otherwise("no_overlap_observed").alias("finding"),
        severity.alias("severity"), action.alias("action"), "total", cut.alias("truncated"), (F.lit(distinct_commits) | unsure | F.coalesce(
            severity.isin("warning", "high"), F.lit(False)
        )).alias("look_again"), F.array_join(reasons, ";").alias("reasons"),
    )
    return verdict, shown
