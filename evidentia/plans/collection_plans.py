"""Queries over collected sources, discovered projects, symbols' categories and bounded histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import collection, extract, history, registry, search
from . import lens
from .registered import query

_TREE = """t as (select case p_size % 6 when 0 then p_type || '/' || replace(p_brand, '#', '') || '/package.json' when 1 then p_type || '/package.json' when 2 then p_type || '/' || replace(p_brand, '#', '') || '/x/' || p_type || '.csproj' when 3 then 'node_modules/' || p_type || '/package.json'
  when 4 then 'apps/' || replace(p_brand, '#', '') || '/tsconfig.json' else 'apps/' || replace(p_brand, '#', '') || '/src/main.ts' end as path, p_type from part where p_type <> 'PROMO' or p_size % 6 <> 1)"""


def _tree(spark, d):
    p = lens.table(spark, d, "part").where("p_type <> 'PROMO' or p_size % 6 <> 1")
    brand, n = F.regexp_replace("p_brand", "#", ""), F.col("p_size") % 6
    path = F.when(n == 0, F.concat_ws("/", "p_type", brand, F.lit("package.json"))).when(n == 1, F.concat_ws("/", "p_type", F.lit("package.json"))).when(
        n == 2, F.concat_ws("/", "p_type", brand, F.lit("x"), F.concat("p_type", F.lit(".csproj")))
    )
    path = path.when(
        n == 3, F.concat_ws("/", F.lit("node_modules"), "p_type", F.lit("package.json"))
    ).when(n == 4, F.concat_ws("/", F.lit("apps"), brand, F.lit("tsconfig.json"))).otherwise(F.concat_ws("/", F.lit("apps"), brand, F.lit("src/main.ts")))
    return p.select(path.alias("path"))


@query(f"""with {_TREE}, m as (select distinct regexp_replace(path, '/[^/]*$', '') as folder, regexp_extract(path, '[^/]+$') as name from t where path not like 'node_modules/%' and path not like '%.ts'),
o as (select * from m where not exists (select 1 from m b where starts_with(m.folder, b.folder || '/')))
select folder, case when bool_or(name like '%.csproj') then 'dotnet' when bool_or(name = 'tsconfig.json') then 'typescript' else 'nodejs' end as type, string_agg(name, ';' order by name) as signals from o group by folder""")
def project_boundaries(spark, d):
    return collection.boundaries(_tree(spark, d))


def _sources(spark, d):
    k = F.col("doc_id")
    path = F.when(
        k % 17 == 0, F.concat(F.lit("node_modules/"), k.cast("string"), F.lit(".ts"))
    ).when(k % 19 == 0, F.concat(F.lit("a/b/c/d/"), k.cast("string"), F.lit(".py"))).otherwise(F.concat(
        F.lit("src/"), (k % 7).cast("string"), F.lit("/"), (k % 300).cast("string"), F.lit(".cs")
    ))
    text = F.coalesce("text", F.lit(""))
    return lens.table(spark, d, "documents").select(path.alias("path"), text.alias("text"), F.octet_length(text).cast("long").alias("byte_size"), k.alias("k"))


_SOURCES = "s as (select doc_id as k, case when doc_id % 17 = 0 then 'node_modules/' || doc_id || '.ts' when doc_id % 19 = 0 then 'a/b/c/d/' || doc_id || '.py' else 'src/' || (doc_id % 7) || '/' || (doc_id % 300) || '.cs' end as path, coalesce(text, '') as text, strlen(coalesce(text, ''))::bigint as byte_size from documents)"


@query(f"with {_SOURCES}, n as (select *, count(*) over (partition by path) as c from s) select distinct case when k % 17 = 0 then 'invalid_path' else 'duplicate_path' end as code, path from n where k % 17 = 0 or c > 1")
def source_issues(spark, d):
    return collection.normalized(_sources(spark, d))[1]


_COLLECT = f"{_SOURCES}, u as (select path || '#' || k as path, byte_size, k from s where k % 17 <> 0), f as (select *, k % 19 = 0 as deep, byte_size > 9000 as large from u), g as (select path, byte_size, row_number() over (order by path) as n, sum(byte_size) over (order by path rows unbounded preceding) as running from f where not deep and not large)"


def _collected(spark, d):
    rows = _sources(spark, d).withColumn("path", F.concat_ws("#", "path", F.col("k").cast("string")))
    return collection.collected(rows, 100, 9000, 200_000, 3)


@query(f"with {_COLLECT} select path, byte_size from g where n <= 100 and running <= 200000")
def collected_sources(spark, d):
    return _collected(spark, d)[0].select("path", "byte_size")


@query(f"with {_COLLECT} select code, files from (select 'depth_limit' as code, count(*) as files from f where deep union all select 'file_too_large', count(*) from f where large and not deep union all select 'source_limit', count(*) from g where n > 100 or running > 200000) where files > 0")
def collection_diagnostics(spark, d):
    return _collected(spark, d)[1]


@query(f"with {_SOURCES} select case when k % 17 = 0 then 'typescript' when k % 19 = 0 then 'python' else 'csharp' end as language, count(*) as files from s group by 1")
def source_languages(spark, d):
    return collection.languages(_sources(spark, d))


@query(f"with {_SOURCES} select split_part(path, '/', 1) as project, split_part(path, '.', 2) as extension, count(*) as files, sum(byte_size)::bigint as bytes from s group by all")
def project_extensions(spark, d):
    return collection.by_extension(_sources(spark, d).withColumn("project", F.substring_index("path", "/", 1)))


_SCOPED = [{"id": "w1", "folder": "src1"}, {"id": "w2", "folder": "src2", "include": ["src2/*.md", "src1/1*.md"]}, {"id": "w3", "folder": "none"}]


@query(f"with {lens.FILES}, m as (select path, 'w1' as workspace from files where path like 'src1/%' union all select path, 'w2' from files where path like 'src2/%' or path like 'src1/1%'), h as (select *, row_number() over (partition by workspace order by path) as n from m) select workspace, count(*) as paths, string_agg(path, ';' order by path) filter (where n <= 8) as shown, count(*) > 8 as truncated from h group by workspace")
def scope_report(spark, d):
    files = lens.files(spark, d)
    return collection.scope_report(search.scope_matches(files, _SCOPED), files)[0]


@query(f"with {lens.FILES} select path from files where path not like 'src1/%' and path not like 'src2/%'")
def scope_unmatched(spark, d):
    files = lens.files(spark, d)
    return collection.scope_report(search.scope_matches(files, _SCOPED), files)[1]


@query("""with n as (select p_partkey, p_size % 8 as m, ['controller', 'interface', 'service', 'repository', 'database', 'contract', 'domain', 'unknown'][(p_size % 8 + 1)::int] as category from part) select p_partkey, category from n""")
def symbol_categories(spark, d):
    m = (F.col("p_size") % 8 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), m)
    name = pick("OrderController", "IOrder", "OrderService", "OrderRepository", "ShopDbContext", "OrderDto", "Order", "Thing")
    space = pick("Shop", "Shop.Services", "Shop.Repositories", "Shop.Persistence", "Shop.Contracts", "Shop", "Shop.Entities", "Shop")
    kind = pick("class", "interface", "class", "class", "class", "record", "class", "class")
    return lens.table(spark, d, "part").select("p_partkey", texts.category(name, space, kind, F.lit("Shop")).alias("category"))


@query("select l_partkey as path, l_suppkey % 40 as specifier from lineitem where l_returnflag = 'R' except select l_partkey, l_suppkey % 40 from lineitem where l_returnflag <> 'R'")
def unrepresented_imports(spark, d):
    li = lens.table(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), (F.col("l_suppkey") % 40).alias("specifier"), "l_returnflag")
    return extract.unrepresented(li.where("l_returnflag = 'R'").select("path", "specifier").distinct(), li.where("l_returnflag <> 'R'"))


@query("with n as (select p_partkey - p_partkey % 2 * (p_size % 3 // 2) as id, p_name as label from part), s as (select id from n group by id having count(*) = 1) select distinct l_partkey as src, l_suppkey as dst, l_returnflag as relation from lineitem where l_partkey in (select id from s) and l_suppkey in (select id from s)")
def native_evidence(spark, d):
    p = lens.table(spark, d, "part")
    nodes = p.select((F.col("p_partkey") - F.col("p_partkey") % 2 * F.floor(F.col("p_size") % 3 / 2)).alias("id"), F.col("p_name").alias("label"))
    edges = lens.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"))
    return extract.native_evidence(nodes, edges)[1]


@query("select l_orderkey, l_linenumber, l_suppkey from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n = 1")
def unique_rows(spark, d):
    return extract.unique_rows(lens.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""with e as (select c_nationkey as path, c_custkey as commit, case when c_acctbal < 0 then null else c_mktsegment end as v from customer), k as (select *, row_number() over (partition by path order by commit desc) as back from e),
h as (select *, lag(v) over (partition by path order by commit) as b from k where back <= 20), ch as (select *, case when b is null and v is not null then 'added' when b is not null and v is null then 'deleted' when b <> v then 'modified' end as change from h),
r as (select *, row_number() over (partition by path order by commit desc) as n from ch where change is not null) select path, commit, change from r where n <= 5""")
def bounded_file_history(spark, d):
    c = lens.table(spark, d, "customer")
    entries = c.select(F.col("c_nationkey").alias("path"), F.col("c_custkey").alias("commit"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("v"))
    return history.recent_changes(entries, "path", "commit", "v", 20, 5).select("path", "commit", "change")


@query("""with s as (select user_id, ts, epoch_us(ts) / 1000000.0 as moment, event_type <> 'error' as live, event_type <> 'click' as ready, case when event_type = 'error' then null else value end as uptime, value * 3 as rss from events),
b as (select *, moment - uptime as began, lag(moment) over (partition by user_id order by moment) as before from s), f as (select *, lag(began ignore nulls) over (partition by user_id order by moment) as last from b)
select user_id, count(*) as samples, count(*) filter (where not live) as liveness_failures, count(*) filter (where not ready) as readiness_failures, count(*) filter (where began > last + 2) as restarts, round(max(moment - before), 2) as longest_gap, max(rss) as peak,
case when count(*) filter (where not live or not ready) > 0 or count(*) filter (where began > last + 2) > 0 then 'failed' else 'passed' end as status from f group by user_id""")
def soak_report(spark, d):
    e = lens.table(spark, d, "events")
    kind = F.col("event_type")
    samples = e.select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), (kind != "error").alias("live"),
        (kind != "click").alias("ready"), F.when(kind != "error", F.col("value")).alias("uptime"), (F.col("value") * 3).alias("rss")
    )
    return history.soak_report(samples, "user_id")


@query("select l_orderkey as task, run, status, truncated from (select l_orderkey, l_linenumber as run, l_returnflag as status, row_number() over (order by l_orderkey, l_linenumber, l_returnflag) as n, (select count(*) from (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem where l_linestatus = 'F')) > 30 as truncated from (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem where l_linestatus = 'F')) where n <= 30")
def history_page(spark, d):
    rows = lens.table(spark, d, "lineitem").where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("status")
    ).distinct()
    return history.page(rows, ["task", "run", "status"], 30)


@query("""with c as (select distinct l_partkey as path from lineitem where l_quantity > 40), w as (select distinct l_partkey as path from lineitem where l_returnflag = 'R'), v as (select c.path, case when w.path is null then 'outside_write' else 'in_write' end as verdict from c left join w using (path))
select any_value(paths_) as paths, any_value(o) as outside, 'audit_' || sha256(string_agg(d, chr(10) order by leaf)) as receipt from (select leaf, sha256(string_agg(path || ':' || verdict, chr(10) order by path || ':' || verdict)) as d, count(*) as n from (select *, sha256(path::varchar)[1:2] as leaf from v) group by leaf) l, (select count(*) as paths_, count(*) filter (where verdict = 'outside_write') as o from v) group by ()""")
def audit_receipt(spark, d):
    li = lens.table(spark, d, "lineitem")
    return registry.audit_receipt(
        registry.diff_audit(li.where("l_quantity > 40").select(F.col("l_partkey").alias("path")), li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("path")))
    )
