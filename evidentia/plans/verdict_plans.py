"""Queries over scopes, conflicts, declarations and file verdicts; tasks are orders, names and paths are made of parts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope, verdicts
from . import lens
from .registered import query
from .scope_plans import PAIRS, _classes


def _lines(spark, d):
    return lens.table(spark, d, "lineitem")


@query("""with f as (select l_orderkey as task, max(l_quantity) > 49 as large, bool_or(l_linestatus = 'F' and l_tax > 0.07) as unbound, bool_or(l_discount > 0.09) as broken from lineitem where l_linenumber > 1 group by 1),
n as (select l_orderkey as task, 's' || l_suppkey % 5 as name, count(*) as matches from lineitem group by all), q as (select o_orderkey as task, 's' || o_custkey % 6 as name from orders)
select q.task, q.name, coalesce(matches, 0) as matches, case when large is null or large or unbound then 'not_evaluated' when broken and matches >= 2 then 'ambiguous' when broken then 'partial' when matches > 3 then 'partial' when matches >= 2 then 'ambiguous' when coalesce(matches, 0) = 0 then 'not_found' else 'resolved_unique' end as verdict
from q left join f using (task) left join n on n.task = q.task and n.name = q.name""")
def declaration_verdict(spark, d):
    li = _lines(spark, d)
    files = li.where("l_linenumber > 1").select(
        F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("path"),
        F.when(F.col("l_quantity") > 49, 200_000).otherwise(10).alias("byte_size"), (F.col("l_discount") <= 0.09).alias("parsed"),
        F.lit("h").alias("sha256"), F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.07), "x").otherwise("h").alias("bound")
    )
    declared = li.select(
        F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("path"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("name")
    )
    names = lens.table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.concat(F.lit("s"), (F.col("o_custkey") % 6).cast("string")).alias("name"))
    return verdicts.declaration_verdict(files, declared, names, ceiling=3)


@query("""with a as (select l_orderkey as task, count(distinct l_suppkey % 12) as names from lineitem group by 1), n as (select distinct l_orderkey as task, l_suppkey % 12 as name from lineitem),
p as (select l_orderkey as task, count(*) as paths, bool_and(l_discount < 0.09) as bound, bool_and(l_shipdate is not null and l_linestatus <> 'F' or l_quantity < 20) as covered from lineitem where l_tax < 0.07 group by 1),
h as (select n.task, n.name, count(*) as k from n join lineitem on l_orderkey = n.task and l_partkey % 12 = n.name group by all), u as (select task, count(*) filter (where k = 1) as uniq from h group by 1),
r as (select a.task, names, coalesce(paths, 0) as paths, uniq, case when paths is null or not bound then 'binding_mismatch' when names > 5 then 'name_list_truncated' when not covered then 'uncovered_language' else '' end as reason from a left join p using (task) left join u using (task))
select task, names, paths, reason, reason = '' and coalesce(uniq = names, false) as holds from r""")
def completeness_witness(spark, d):
    li = _lines(spark, d)
    names = li.select(F.col("l_orderkey").alias("task"), (F.col("l_suppkey") % 12).alias("name")).distinct()
    language = F.when((F.col("l_linestatus") != "F") | (F.col("l_quantity") < 20), "typescript").otherwise("cobol")
    paths = li.where("l_tax < 0.07").select(
        F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("path"), language.alias("language"),
        (F.col("l_discount") < 0.09).alias("bound")
    )
    declared = li.select(F.col("l_orderkey").alias("task"), (F.col("l_partkey") % 12).alias("name"))
    return verdicts.completeness_witness(names, paths, declared, ["typescript"], 5)


@query("""with o as (select o_orderkey as k, o_custkey % 9 as m from orders), has as (select distinct l_orderkey as k from lineitem where l_linenumber = 2)
select k as task, case m when 0 then 'symbol_target_evidence_missing' when 1 then 'symbol_target_domain_unsupported' when 2 then 'symbol_target_binding_mismatch' else (case when k not in (select k from has) then 'symbol_target_evidence_inconsistent' else
(case m when 3 then 'symbol_target_binding_mismatch' when 4 then 'symbol_target_evidence_inconsistent' when 5 then 'symbol_target_completeness_not_established' when 6 then 'symbol_target_uniqueness_not_established' else 'ok' end) end) end as code from o""")
def witness_verdict(spark, d):
    o = lens.table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 9).alias("m"))
    names, paths = F.array(F.lit("A"), F.lit("B")), F.array(F.lit("x.ts"), F.lit("y.ts"))
    required = o.select("task", names.alias("names"), paths.alias("paths"), F.lit("p").alias("project"), F.lit("t").alias("snapshot"))
    domain = F.when(F.col("m") == 1, "other").otherwise("typescript-direct-declarations")
    witnesses = o.where("m <> 0").select(
        "task", domain.alias("domain"), F.reverse(names).alias("names"),
        F.when(F.col("m") == 2, F.array(F.lit("x.ts"))).otherwise(paths).alias("paths"), F.lit("p").alias("project"), F.lit("t").alias("snapshot"),
        (~F.col("m").isin(4, 5)).alias("complete"), (~F.col("m").isin(5, 6)).alias("unique")
    )
    has = _lines(spark, d).where("l_linenumber = 2").select(F.col("l_orderkey").alias("task")).distinct()
    rows = o.join(has, "task", "left_semi").select("task", "m", F.explode(names).alias("name"))
    evaluations = rows.select("task", "name", F.when(F.col("m") == 3, "z.ts").otherwise("x.ts").alias("path"), F.lit("t").alias("snapshot"))
    return verdicts.witness_verdict(witnesses, evaluations, required)


def _side(spark, d, residue: int):
    return _lines(spark, d).where(F.col("l_orderkey") % 3 == residue).select(
        (F.col("l_partkey") % 500).alias("path"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"),
        (F.col("l_suppkey") % 4).alias("hash"), (F.col("l_quantity") % 3).cast("int").alias("declaration")
    ).distinct()


@query("""with s as (select distinct l_orderkey % 3 as side, l_partkey % 500 as path, 'n' || l_linenumber as name, l_suppkey % 4 as hash, (l_quantity % 3)::int as declaration from lineitem)
select distinct a.path, a.name, a.hash from s a join s b on a.side = 0 and b.side = 1 and a.path = b.path and a.name = b.name and a.hash = b.hash and a.declaration = b.declaration""")
def shared_declarations(spark, d):
    return verdicts.shared_declarations(_side(spark, d, 0), _side(spark, d, 1), True)


@query("""with t as (select distinct l_orderkey as task, l_linenumber as path from lineitem where l_returnflag = 'R'), c as (select o_orderkey as task, unnest([1, 2, 3, 4]) as path, o_custkey % 3 as h from orders),
i as (select o_orderkey as task, unnest([1, 2, 3, 5]) as path, o_custkey % 2 as h, case o_orderstatus when 'F' then 'available' when 'O' then 'partial' else 'unavailable' end as status from orders)
select t.task, t.path, case when c.h is null then 'delete_source_not_evaluated' when i.status is null or i.status = 'unavailable' then 'delete_target_not_evaluated' when c.h <> i.h then 'delete_hash_mismatch' when i.status = 'partial' then 'delete_target_partial' else 'bound' end as code
from t left join c using (task, path) left join i using (task, path)""")
def delete_verdict(spark, d):
    o = lens.table(spark, d, "orders")
    task = F.col("o_orderkey").alias("task")
    status = F.when(F.col("o_orderstatus") == "F", "available").when(F.col("o_orderstatus") == "O", "partial").otherwise("unavailable")
    context = o.select(task, F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("path"), (F.col("o_custkey") % 3).alias("hash"))
    impact = o.select(task, F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("path"), (F.col("o_custkey") % 2).alias("hash"), status.alias("status"))
    targets = _lines(spark, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("path"))
    return verdicts.delete_verdict(targets, context, impact)


_CREATE = """l as (select distinct 'n' || c_nationkey as folder, case when c_custkey % 2 = 0 then 'C' else 'c' end || c_custkey || '.ts' as name from customer where c_nationkey % 6 <> 1),
fo as (select 'n' || n_nationkey as folder, n_nationkey % 6 <> 2 as complete, n_nationkey % 6 = 1 as bare from nation where n_nationkey % 6 <> 3),
t as (select distinct o_orderkey as task, 'n' || (o_custkey % 25) as folder, case o_custkey % 4 when 0 then 'c' || o_custkey || '.ts' when 1 then 'new' || o_custkey || '.ts' when 2 then 'c' || (o_custkey // 7) || '.ts' else 'LONG~1.ts' end as name, o_custkey % 25 as n from orders),
v as (select task, t.folder || '/' || t.name as path, case when n in (5, 10) then 'ancestor_boundary' when fo.folder is null then 'parent_absent' when not complete or bare then 'unknown' when l.name is not null then 'exists'
  when (t.folder, lower(t.name)) in (select (folder, lower(name)) from l) or t.name like '%~1%' then 'unknown' else 'absent' end as verdict from t left join fo using (folder) left join l on l.folder = t.folder and l.name = t.name)"""


def _creations(spark, d):
    o = lens.table(spark, d, "orders")
    c = F.col("o_custkey")
    name = F.when(c % 4 == 0, F.concat(F.lit("c"), c.cast("string"), F.lit(".ts"))).when(c % 4 == 1, F.concat(F.lit("new"), c.cast("string"), F.lit(".ts"))).when(
        c % 4 == 2, F.concat(F.lit("c"), F.floor(c / 7).cast("string"), F.lit(".ts"))
    ).otherwise("LONG~1.ts")
    targets = o.select(F.col("o_orderkey").alias("task"), F.concat(F.lit("n"), (c % 25).cast("string"), F.lit("/"), name).alias("path"))
    k = F.col("c_custkey")
    listings = lens.table(spark, d, "customer").where("c_nationkey % 6 <> 1").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("folder"),
        F.concat(F.when(k % 2 == 0, "C").otherwise("c"), k.cast("string"), F.lit(".ts")).alias("name")
    )
    n = lens.table(spark, d, "nation").where("n_nationkey % 6 <> 3")
    folders = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder"), (F.col("n_nationkey") % 6 != 2).alias("complete"))
    boundaries = spark.createDataFrame([("n5",), ("n10",)], "folder string")
    return targets, verdicts.absence(targets, listings, folders, boundaries)


@query(f"with {_CREATE} select distinct path, verdict from v")
def create_absence(spark, d):
    return _creations(spark, d)[1]


@query(f"with {_CREATE}, w as (select task % 50 as task, verdict from v) select task, case min(list_position(['exists', 'parent_absent', 'ancestor_boundary', 'unknown', 'absent'], verdict)) when 1 then 'destination_exists' when 2 then 'parent_absent' when 3 then 'ancestor_boundary' when 4 then 'not_proven' else 'lifted' end as code from w group by task")
def create_verdict(spark, d):
    targets, found = _creations(spark, d)
    return verdicts.create_verdict(targets.join(found, "path").select((F.col("task") % 50).alias("task"), "verdict"))


@query("""with m as (select p_partkey as path, case when p_size % 5 = 0 then 7 else p_partkey + 100000 end as moved, p_size from part), t as (select distinct l_partkey as path from lineitem where l_quantity > 30), n as (select moved, count(*) as n from m group by 1)
select m.path, moved, case when m.path not in (select path from t) then 'source_missing' when n > 1 then 'destination_shared' when p_size % 5 = 1 then 'destination_not_observed' when p_size % 5 = 2 then 'destination_exists' when p_size % 5 = 3 then 'not_proven' else 'ready' end as verdict from m join n using (moved)""")
def operation_verdict(spark, d):
    p = lens.table(spark, d, "part")
    n = F.col("p_size") % 5
    moved = F.when(n == 0, 7).otherwise(F.col("p_partkey") + 100_000)
    tree = _lines(spark, d).where("l_quantity > 30").select(F.col("l_partkey").alias("path"))
    absences = p.where(n > 1).select(moved.alias("path"), F.when(n == 2, "exists").when(n == 3, "unknown").otherwise("absent").alias("verdict"))
    return verdicts.operation_verdict(p.select(F.col("p_partkey").alias("path"), moved.alias("moved")), tree, absences)


def _requests(spark, d):
    """Scope requests of orders; the customer's remainder says which gate fails."""
    m = F.col("o_custkey") % 16
    off = lambda n, a, b="x": F.when(m == n, b).otherwise(a)
    revision = lambda commit, branch, dirty, linked, status: F.struct(
        commit.alias("commit"), branch.alias("branch"), dirty.alias("dirty"), linked.alias("linked"), status.alias("status")
    )
    text, no, yes = F.lit, F.lit(False), F.lit(True)
    task = F.col("o_orderkey")
    paths = F.array(F.lit("a.ts"), F.lit("b.ts"))
    r = F.struct(
        task.alias("task"), paths.alias("paths"), text("p").alias("project"), text("w").alias("locator"),
        revision(F.when(m != 9, off(10, "c1")), text("main"), F.when(m == 11, yes).otherwise(no), yes, text("available")).alias("revision"),
        text("repo").alias("repository"), F.when(m != 5, text("tree")).alias("worktree")
    )
    seen = revision(text("c1"), text("main"), F.when(m == 11, yes).otherwise(no), yes, text("available")).alias("revision")
    p = F.struct(
        task.alias("task"), F.when(m == 0, F.array(F.lit("a.ts"))).otherwise(F.reverse(paths)).alias("paths"), off(1, "p").alias("project"),
        text("w").alias("locator"), seen, off(4, "repo").alias("repository"), F.when(m != 5, text("tree")).alias("worktree"),
        off(6, "t").alias("snapshot"), off(7, "v1").alias("provider")
    )
    other = revision(off(3, "c1"), text("main"), F.when(m == 11, yes).otherwise(no), yes, text("available")).alias("revision")
    i = F.struct(
        text("p").alias("project"), off(2, "w").alias("locator"), other, text("repo").alias("repository"),
        F.when(m != 5, text("tree")).alias("worktree"), text("t").alias("snapshot"), text("v1").alias("provider"),
        F.when(m == 8, F.array(F.lit("a.ts"))).otherwise(paths).alias("origins")
    )
    return lens.table(spark, d, "orders").select(task.alias("task"), r.alias("r"), p.alias("p"), i.alias("i"))


_GATES = ", ".join(f"'{g}'" for g in verdicts.SCOPE_GATES)
_GATED = f"""g as (select o_orderkey as task, o_custkey % 16 as m, case when o_custkey % 16 < 9 then 'rejected' when o_custkey % 16 = 10 then 'stale' when o_custkey % 16 in (9, 11) then 'not_evaluated' else 'available' end as status,
case when o_custkey % 16 < 9 then [{_GATES}][(o_custkey % 16 + 1)::int] when o_custkey % 16 = 10 then 'scope_stale' when o_custkey % 16 in (9, 11) then 'working_tree_observation_only' else '' end as code from orders)"""


@query(f"with {_GATED} select task, status, code from g")
def scope_gate(spark, d):
    return verdicts.scope_gate(_requests(spark, d))


@query(f"""with {_GATED}, a as (select l_orderkey as task, l_linenumber as path, min(l_suppkey % 6) as distance, bool_or(l_tax > 0.07) as truncated, bool_or(l_returnflag = 'R') as writes, bool_or(l_quantity > 45) as held from lineitem group by all)
select task, path, case when writes then 'write' when held then 'reserved' when truncated or distance <= 2 then 'watch' else 'impact' end as category,
case when writes then 'declared_write' when held then 'strong_coupling' when truncated then 'truncated_attribution' when distance <= 2 then 'distance_1_2_awareness' else 'transitive_impact' end as rule
from a join g using (task) where status = 'available'""")
def effective_scope(spark, d):
    a = _lines(spark, d).groupBy(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("path")).agg(
        F.min(F.col("l_suppkey") % 6).alias("distance"), F.bool_or(F.col("l_tax") > 0.07).alias("truncated"),
        F.bool_or(F.col("l_returnflag") == "R").alias("w"), F.bool_or(F.col("l_quantity") > 45).alias("h")
    )
    affected = a.select("task", "path", "distance", "truncated", F.lit("local_implementation").alias("semantics"), F.lit(False).alias("deletes"))
    return verdicts.effective_scope(verdicts.scope_gate(_requests(spark, d)), a.where("w").select("task", "path"), affected, a.where("h").select("task", "path"))


def _overlaps(spark, d):
    return scope.conflicts(_classes(spark, d, "BUILDING"), _classes(spark, d, "MACHINERY"))


@query(f"{PAIRS}, o as (select count(*) as total, min(case severity when 'high' then 0 when 'warning' then 1 else 2 end) as r from s) select case when total > 16 then 'incomplete' else 'available' end as status, case when total > 0 then 'overlap_observed' else 'no_overlap_observed' end as finding, case r when 0 then 'high' when 1 then 'warning' when 2 then 'info' else case when total > 16 then null else 'none' end end as severity, case when r = 0 then 'serialize' when r = 1 then 'revalidate' when total > 16 then 'reobserve' else 'none' end as action, total, total > 16 as truncated, total > 16 or coalesce(r < 2, false) as look_again, case when total > 16 then 'overlap_limit' else '' end as reasons from o")
def conflict_verdict(spark, d):
    return verdicts.conflict_verdict(_overlaps(spark, d))[0]


@query(f"{PAIRS} select path, left_category, right_category, severity, case severity when 'high' then 'serialize' when 'warning' then 'revalidate' else 'none' end as action from s order by case severity when 'high' then 0 when 'warning' then 1 else 2 end, path limit 16")
def conflict_shown(spark, d):
    return verdicts.conflict_verdict(_overlaps(spark, d))[1]


@query(f"{PAIRS}, h as (select *, path % 3 as a, path % 2 as b from s where left_category = 'write' and right_category = 'write' and path % 5 <> 0) select path, case when a = b then severity else 'warning' end as severity from h")
def sibling_writes(spark, d):
    rows = _overlaps(spark, d)
    left, right = rows.where("path % 5 <> 0").select("path", (F.col("path") % 3).alias("hash")), rows.select("path", (F.col("path") % 2).alias("hash"))
    return verdicts.shared_write_evidence(rows, left, right, True).select("path", "severity")
