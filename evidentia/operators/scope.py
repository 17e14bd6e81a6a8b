"""Task scopes: intersections, classification, conflicts, budgets and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Fixed values of the scope rules: gates, the paths that are tests, and the extensions that are code.
#: Reasons for which an intersection is not evaluated, in order of priority.
GATES = ("input_not_evaluated", "input_rejected", "input_incomplete", "identity_mismatch", "revision_mismatch")
_TEST = r"(?i)(?:^|/)(?:__tests__|tests?|specs?)(?:/|$)|\.(?:test|spec)\.|Tests?\.cs$|(?:^|/)test_|_test\.go$"
_CODE = r"(?i)\.(?:tsx?|jsx?|cs|py|go|rs|java)$"
_DOCUMENT = r"\.(?:md|rst|txt)$"
#: Declared kinds of change that no path contradicts.
_STANDING = ("public_signature", "interface_contract", "schema_migration", "unknown")


def write_write(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths that both sides write."""
    return left.select("path").intersect(right.select("path"))


def write_watch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths that one side writes and the other watches; sides: path, role (write or watch)."""
    of = lambda side, role: side.where(F.col("role") == role).select("path")
    return of(left, "write").intersect(of(right, "watch")).union(of(right, "write").intersect(of(left, "watch"))).distinct()


def gate(left: dict, right: dict) -> str | None:
    """Why two scope envelopes can't be compared, or null. A side that says nothing of its identity matches nothing."""
    sides = (left, right)
    if any(s.get("status") == "not_evaluated" for s in sides):
        return GATES[0]
    if any(s.get("status") == "rejected" or s.get("error") for s in sides):
        return GATES[1]
    if any(s.get("incomplete") or s.get("status") == "incomplete" for s in sides):
        return GATES[2]
    same = lambda k: left.get(k) is not None and left.get(k) == right.get(k)
    if not (same("project_id") and same("repository_identity")):
        return GATES[3]
    return None if same("commit_sha") and not left.get("dirty") and not right.get("dirty") else GATES[4]


def classify(distance: Column, truncated: Column, semantics: Column, writes: Column, deletes: Column) -> tuple[Column, Column]:
    """(category, rule) of an affected path."""
    risky = semantics.isin("public_signature", "interface_contract", "schema_migration", "unknown")
    category = F.when(writes, "write").when(deletes | truncated | risky | (distance <= 2), "watch").otherwise("impact")
    rule = F.when(deletes & ~writes, "delete_intent_awareness").when(truncated, "truncated_attribution").when(
        risky | (distance <= 2), "distance_1_2_awareness"
    ).otherwise("transitive_impact")
    return category, rule


def severity(a: Column, b: Column) -> Column:
    other = F.when(a == "write", b).otherwise(a)
    return F.when((a != "write") & (b != "write"), "info").when(other.isin("write", "reserved"), "high").when(other == "watch", "warning").otherwise("info")


def conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, left_category, right_category, severity, action): paths in two classified scopes (path, category)."""
    both = left.select("path", F.col("category").alias("left_category")).join(right.select("path", F.col("category").alias("right_category")), "path")
    rows = both.withColumn("severity", severity(F.col("left_category"), F.col("right_category")))
    return rows.withColumn("action", F.when(F.col("severity") == "high", "serialize").when(F.col("severity") == "warning", "revalidate").otherwise("none"))


def conflict_summary(pairs: DataFrame) -> DataFrame:
    """One row: overlaps and the gravest severity (none without any)."""
    rank = F.min(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "warning", 1).otherwise(2))
    return pairs.agg(
        F.count("*").alias("overlaps"),
        F.coalesce(F.element_at(F.array(F.lit("high"), F.lit("warning"), F.lit("info")), rank + 1), F.lit("none")).alias("severity")
    )


def within_budget(rows: DataFrame, key: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """The longest prefix of each key whose running cost stays within the budget; costs are not negative and the order is total."""
    total = F.sum(cost).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", total).where(F.col("running") <= budget)


def reasons(rows: DataFrame, key: str, codes: str) -> DataFrame:
    """(key, reasons): the sorted union of arrays of reason codes, joined by ';'. Distinct pairs are made before codes meet."""
    once = rows.select(key, F.explode(codes).alias("code")).distinct()
    return once.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("code")), ";").alias("reasons"))


def is_test(path: Column) -> Column:
    return path.rlike(_CODE) & path.rlike(_TEST)


def stem(path: Column) -> Column:
    """File name without extension and test affixes, in lower case."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(?i)(?:\.(?:test|spec)|_test|Tests?)$", ""), "(?i)^test_", ""))


def tests_of(files: DataFrame, targets: DataFrame) -> DataFrame:
    """The tests among files (path, ...) for targets (path), with a reason: task_path_or_reference for a test that is a target itself, basename_convention for one whose stem is a target's.

    Stems and paths are made distinct first and only asked for, so a stem that very many files share (index) makes no pairs. A test is listed once for each of its rows.
    """
    stems = targets.select(stem(F.col("path")).alias("_stem")).distinct()
    own = targets.select("path").distinct().withColumn("_own", F.lit(True))
    tests = files.where(is_test(F.col("path"))).withColumn("_stem", stem(F.col("path"))).join(stems, "_stem", "left_semi").join(own, "path", "left")
    return tests.withColumn("reason", F.when(F.col("_own"), "task_path_or_reference").otherwise("basename_convention")).select(*files.columns, "reason")


def test_candidates(files: DataFrame) -> DataFrame:
    """(path, test): files and the tests whose stem equals theirs. Every pair is a row of the result; tests_of() answers for a set of files without pairs."""
    tests = files.where(is_test(F.col("path"))).select(F.col("path").alias("test"), stem(F.col("path")).alias("stem"))
    return files.where(~is_test(F.col("path"))).select("path", stem(F.col("path")).alias("stem")).join(tests, "stem").select("path", "test")


def inferred_semantics(paths: DataFrame, key: str) -> DataFrame:
    """(key, semantics): documentation or test_only if all its paths are, else unknown."""
    docs = F.bool_and(F.col("path").rlike(_DOCUMENT))
    return paths.groupBy(key).agg(F.when(docs, "documentation").when(F.bool_and(is_test(F.col("path"))), "test_only").otherwise("unknown").alias("semantics"))


def resolved_semantics(tasks: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """(key, declared, inferred, effective, provenance, reasons) of tasks (key, declared) with their paths (key, path).

    Without a declaration the paths decide. Declared interfaces, schemas, signatures and unknown changes stand. A declared local implementation stands where the paths say nothing else;
    declared documentation or tests stand only where the paths say the same. Otherwise the effective kind is unknown, for declaration_path_disagreement. A task without paths infers unknown.
    """
    rows = tasks.select(key, "declared").join(inferred_semantics(paths, key).withColumnRenamed("semantics", "inferred"), key, "left")
    rows = rows.withColumn("inferred", F.coalesce("inferred", F.lit("unknown")))
    declared, inferred = F.col("declared"), F.col("inferred")
    agrees = declared.isin(*_STANDING) | (declared == inferred) | ((declared == "local_implementation") & (inferred == "unknown"))
    return rows.select(
        key, "declared", "inferred", F.when(declared.isNull(), inferred).when(agrees, declared).otherwise("unknown").alias("effective"),
        F.when(declared.isNull(), "path_inference").otherwise("task_declaration").alias("provenance"),
        F.when(declared.isNotNull() & ~agrees, "declaration_path_disagreement").otherwise("").alias("reasons")
    )
