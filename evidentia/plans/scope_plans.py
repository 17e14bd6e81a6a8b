"""Scope and conflict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope
from . import lens
from .registered import query


def _bought(spark, d, segment: str):
    c, o, li = (lens.table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    keys = o.join(c.where(F.col("c_mktsegment") == segment), o.o_custkey == c.c_custkey, "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = li.join(keys, "l_orderkey", "left_semi")
    return rows.select(F.col("l_partkey").alias("path"), F.when(F.col("l_returnflag") == "R", "write").otherwise("watch").alias("role"))


BOUGHT = "{0} as (select l_partkey as path, case l_returnflag when 'R' then 'write' else 'watch' end as role from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where c_mktsegment = '{1}')"
SIDES = f"with {BOUGHT.format('l', 'BUILDING')}, {BOUGHT.format('r', 'MACHINERY')}"


@query(f"{SIDES} select path from l where role = 'write' intersect select path from r where role = 'write'")
def write_write(spark, d):
    a, b = (_bought(spark, d, s).where("role = 'write'") for s in ("BUILDING", "MACHINERY"))
    return scope.write_write(a, b)


@query(f"{SIDES} (select path from l where role = 'write' intersect select path from r where role = 'watch') union (select path from r where role = 'write' intersect select path from l where role = 'watch')")
def write_watch(spark, d):
    return scope.write_watch(_bought(spark, d, "BUILDING"), _bought(spark, d, "MACHINERY"))


def _classes(spark, d, segment: str):
    """Categories of a segment's parts: reserved where a watched part has a high quantity, else write, watch or impact by returns."""
    rank = F.min(F.when(F.col("role") == "write", 0).otherwise(1))
    n = F.count("*")
    rows = _bought(spark, d, segment).groupBy("path").agg(rank.alias("r"), n.alias("n"))
    return rows.select(
        "path",
        F.when((F.col("r") == 0) & (F.col("n") > 3), "write").when(F.col("n") > 4, "reserved").when(F.col("n") > 2, "watch").otherwise("impact").alias("category")
    )


CLASSES = "{0}c as (select path, case when min(case role when 'write' then 0 else 1 end) = 0 and count(*) > 3 then 'write' when count(*) > 4 then 'reserved' when count(*) > 2 then 'watch' else 'impact' end as category from {0} group by path)"
PAIRS = f"""{SIDES}, {CLASSES.format('l')}, {CLASSES.format('r')}, p as (select path, lc.category as left_category, rc.category as right_category from lc join rc using (path)),
s as (select *, case when left_category <> 'write' and right_category <> 'write' then 'info' else (case (case when left_category = 'write' then right_category else left_category end) when 'write' then 'high' when 'reserved' then 'high' when 'watch' then 'warning' else 'info' end) end as severity from p)"""


@query(f"{PAIRS} select *, case severity when 'high' then 'serialize' when 'warning' then 'revalidate' else 'none' end as action from s")
def conflict_pairs(spark, d):
    return scope.conflicts(_classes(spark, d, "BUILDING"), _classes(spark, d, "MACHINERY"))


@query(f"{PAIRS} select count(*) as overlaps, coalesce(case min(case severity when 'high' then 0 when 'warning' then 1 else 2 end) when 0 then 'high' when 1 then 'warning' when 2 then 'info' end, 'none') as severity from s")
def conflict_summary(spark, d):
    return scope.conflict_summary(scope.conflicts(_classes(spark, d, "BUILDING"), _classes(spark, d, "MACHINERY")))


@query("""with a as (select l_partkey as path, min(l_linenumber) as distance, count(*) > 40 as truncated, bool_or(l_discount > 0.09) as deletes, sum(l_quantity) > 900 as writes from lineitem group by 1),
s as (select a.*, case p_type when 'ECONOMY' then 'public_signature' when 'PROMO' then 'unknown' else 'local_implementation' end as semantics from a join part on p_partkey = path)
select path, case when writes then 'write' when deletes or truncated or semantics in ('public_signature', 'unknown') or distance <= 2 then 'watch' else 'impact' end as category,
case when deletes and not writes then 'delete_intent_awareness' when truncated then 'truncated_attribution' when semantics in ('public_signature', 'unknown') or distance <= 2 then 'distance_1_2_awareness' else 'transitive_impact' end as rule from s""")
def scope_classes(spark, d):
    li = lens.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(
        F.min("l_linenumber").alias("distance"), (F.count("*") > 40).alias("truncated"), F.bool_or(F.col("l_discount") > 0.09).alias("deletes"),
        (F.sum("l_quantity") > 900).alias("writes")
    )
    part = lens.table(spark, d, "part").select(
        F.col("p_partkey").alias("path"),
        F.when(F.col("p_type") == "ECONOMY", "public_signature").when(F.col("p_type") == "PROMO", "unknown").otherwise("local_implementation").alias("semantics")
    )
    category, rule = scope.classify(*(F.col(c) for c in ("distance", "truncated", "semantics", "writes", "deletes")))
    return li.join(part, "path").select("path", category.alias("category"), rule.alias("rule"))


@query("""select l_orderkey, count(*) as n_kept, max(running) as running from (select l_orderkey, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as running from lineitem) where running <= 60 group by 1""")
def budget_prefix(spark, d):
    kept = scope.within_budget(lens.table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", 60)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n_kept"), F.max("running").alias("running"))


@query("select o_custkey, array_to_string(list_sort(list_distinct(list(code))), ';') as reasons from (select o_custkey, unnest(['status_' || o_orderstatus, 'prio_' || o_orderpriority]) as code from orders) group by 1")
def reasons_union(spark, d):
    rows = lens.table(spark, d, "orders").select(
        "o_custkey", F.array(F.concat(F.lit("status_"), "o_orderstatus"), F.concat(F.lit("prio_"), "o_orderpriority")).alias("codes")
    )
    return scope.reasons(rows, "o_custkey", "codes")


def _paths(spark, d):
    """Parts as source paths: small sizes are tests."""
    p = lens.table(spark, d, "part")
    name = F.concat_ws("_", F.translate("p_name", " ", "_"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lower("p_type"))
    path = F.when(
        F.col("p_size") < 10, F.concat(F.lit("tests/"), name, F.lit(".test.ts"))
    ).when(F.col("p_size") < 20, F.concat(F.lit("lib/test_"), name, F.lit(".py"))).otherwise(F.concat(F.lit("src/"), name, F.lit(".ts")))
    return p.select(path.alias("path"), F.col("p_brand").alias("brand")).distinct()


PATHS = """f as (select distinct p_brand as brand, p_size, replace(p_name, ' ', '_') || '_' || lower(replace(p_brand, '#', '')) || '_' || lower(p_type) as name from part),
f2 as (select distinct brand, name, case when p_size < 10 then 'tests/' || name || '.test.ts' when p_size < 20 then 'lib/test_' || name || '.py' else 'src/' || name || '.ts' end as path from f)"""


@query(f"with {PATHS} select a.path, b.path as test from f2 a join f2 b on a.name = b.name and a.path like 'src/%' and b.path not like 'src/%'")
def test_candidates(spark, d):
    return scope.test_candidates(_paths(spark, d).select("path"))


@query(f"""with {PATHS}, p as (select brand, path, name from f2), t as (select path, name from p where brand in ('Brand#2', 'Brand#17'))
select distinct path, case when path in (select path from t) then 'task_path_or_reference' else 'basename_convention' end as reason from p where path not like 'src/%' and name in (select name from t)""")
def tests_of_brands(spark, d):
    """All tests for the files of two brands."""
    rows = _paths(spark, d)
    return scope.tests_of(rows.select("path").distinct(), rows.where(F.col("brand").isin("Brand#2", "Brand#17")))


@query(f"with {PATHS} select brand || '/' || (path like 'src/%')::varchar as task, case when bool_and(path not like 'src/%') then 'test_only' else 'unknown' end as semantics from f2 group by 1")
def change_semantics(spark, d):
    rows = _paths(spark, d).withColumn("task", F.concat_ws("/", "brand", F.col("path").startswith("src/").cast("string")))
    return scope.inferred_semantics(rows, "task")


@query("""with t as (select o_orderkey as task, case o_custkey % 8 when 0 then 'public_signature' when 1 then 'interface_contract' when 2 then 'schema_migration' when 3 then 'local_implementation'
  when 4 then 'documentation' when 5 then 'test_only' when 6 then 'unknown' end as declared from orders),
p as (select l_orderkey as task, case when l_orderkey % 3 = 0 and (l_orderkey % 5 > 0 or l_linenumber > 1) then 'docs/' || l_partkey || ['.md', '.rst', '.txt'][(l_partkey % 3 + 1)::int]
  when l_orderkey % 3 = 1 and (l_orderkey % 5 > 0 or l_linenumber > 1) then 'tests/p' || l_partkey || '.ts' when l_orderkey % 3 < 2 then 'docs/' || l_partkey || '.MD' else 'src/p' || l_partkey || '.ts' end as path from lineitem),
i as (select task, case when bool_and(path like '%.md' or path like '%.rst' or path like '%.txt') then 'documentation' when bool_and(path like 'tests/%') then 'test_only' else 'unknown' end as inferred from p group by 1),
r as (select task, declared, coalesce(inferred, 'unknown') as inferred from t left join i using (task))
select task, declared, inferred, case when declared is null then inferred when declared in ('public_signature', 'interface_contract', 'schema_migration', 'unknown') then declared
  when declared = 'local_implementation' then case when inferred = 'unknown' then declared else 'unknown' end when declared = inferred then declared else 'unknown' end as effective,
case when declared is null then 'path_inference' else 'task_declaration' end as provenance,
case when declared = 'local_implementation' and inferred in ('documentation', 'test_only') or declared in ('documentation', 'test_only') and declared <> inferred then 'declaration_path_disagreement' else '' end as reasons from r""")
def declared_semantics(spark, d):
    """Orders as tasks that declare a kind or none; their lines as the paths: documents, tests or sources, one in five tasks with a file of another kind."""
    k, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey").cast("string")
    kinds = ("public_signature", "interface_contract", "schema_migration", "local_implementation", "documentation", "test_only", "unknown")
    declared = F.get(F.array(*map(F.lit, kinds)), (F.col("o_custkey") % 8).cast("int"))
    pure = (k % 5 > 0) | (line > 1)
    ending = F.element_at(F.array(F.lit(".md"), F.lit(".rst"), F.lit(".txt")), (F.col("l_partkey") % 3 + 1).cast("int"))
    path = F.when((k % 3 == 0) & pure, F.concat(F.lit("docs/"), part, ending)).when((k % 3 == 1) & pure, F.concat(F.lit("tests/p"), part, F.lit(".ts")))
    path = path.when(k % 3 < 2, F.concat(F.lit("docs/"), part, F.lit(".MD"))).otherwise(F.concat(F.lit("src/p"), part, F.lit(".ts")))
    tasks = lens.table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), declared.alias("declared"))
    return scope.resolved_semantics(tasks, lens.table(spark, d, "lineitem").select(k.alias("task"), path.alias("path")), "task")
