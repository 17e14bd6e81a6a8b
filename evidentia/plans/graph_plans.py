"""Graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import budget, explorer, graph, impact, modules
from . import lens
from .lens import GRAPH
from .registered import query

DEG = "deg as (select id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, sum(i + o)::bigint as total from (select src as id, 0 as i, 1 as o from edges union all select dst, 1, 0 from edges) group by id)"


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return lens.nodes(spark, d), lens.edges(spark, d)


@query(f"{GRAPH}, {DEG} select n.id, label, in_degree, out_degree, total from (select * from deg order by total desc, id limit 20) join nodes n using (id)")
def graph_hubs(spark, d):
    return graph.hubs(*_both(spark, d))


@query(f"{GRAPH} select coalesce(nullif(feature, ''), nullif(layer, ''), nullif(file, ''), 'unknown') as module, count(*) as nodes from nodes group by 1")
def graph_modules(spark, d):
    return graph.modules(lens.nodes(spark, d))


@query(f"{GRAPH}, few as (select * from edges where relation = 'imports' and (src + dst) % 19 = 0) select id, label from nodes where id not in (select src from few union select dst from few)")
def graph_orphans(spark, d):
    nodes, edges = _both(spark, d)
    return graph.orphans(nodes, edges.where("relation = 'imports' and (src + dst) % 19 = 0"))


@query(f"{GRAPH} select (select count(*) from nodes) as nodes, (select count(distinct nullif(file, '')) from nodes) as files, (select count(distinct nullif(feature, '')) from nodes) as features, (select count(*) from edges) as edges")
def graph_stats(spark, d):
    return graph.stats(*_both(spark, d))


@query(f"{GRAPH} select distinct a.src as a, a.dst as b from edges a join edges b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def graph_reciprocal(spark, d):
    return graph.reciprocal(lens.edges(spark, d))


@query(f"{GRAPH} select relation, count(*) as n_edges from edges where src in (select id from nodes where layer = 'ECONOMY' and feature in ('Brand#2', 'Brand#17')) and dst in (select id from nodes where layer = 'ECONOMY' and feature in ('Brand#2', 'Brand#17')) group by 1")
def graph_filtered(spark, d):
    _, inside = graph.filtered(*_both(spark, d), ["ECONOMY"], ["Brand#2", "Brand#17"])
    return inside.groupBy("relation").agg(F.count("*").alias("n_edges"))


@query(f"{GRAPH} select src, dst, relation, (case relation when 'uses' then -10 when 'references' then -3 else 0 end) as score from edges order by score, src, dst, relation limit 100")
def graph_prioritized(spark, d):
    return graph.prioritized(*_both(spark, d))


ONE = T.StructType().add("origin", "long").add("id", "long")
REACH = "reach as (select 1::bigint as id, 0 as depth union select e.src, r.depth + 1 from reach r join edges e on e.dst = r.id and e.src <> e.dst where r.depth < {depth})"


@query(f"{GRAPH}, {REACH.format(depth=2)} select 1::bigint as origin, id, min(depth) as depth from reach group by id having min(depth) > 0")
def reverse_reach(spark, d):
    return graph.reverse_reach(lens.edges(spark, d), spark.createDataFrame([(1, 1)], ONE), 2)


@query(f"{GRAPH} select direction, id, label, relation from ((select 'out' as direction, dst as id, relation from edges where src = 1 order by relation, id limit 14) union all (select 'in', src, relation from edges where dst = 1 order by relation, src limit 22)) join nodes using (id)")
def node_expand(spark, d):
    return graph.expand(*_both(spark, d), 1)


@query(f"""{GRAPH}, {REACH.format(depth=2)}, t as (select id, min(depth) as depth from reach group by id having min(depth) > 0 order by 2, 1 limit 80),
a as (select src as id from (select src, relation from edges where dst = 1 order by 1, 2 limit 80)), u as (select id from a union all select id from t union all select 1),
c as (select (select count(*) from a) as direct, (select count(*) from t) as transitive, (select count(distinct coalesce(nullif(file, ''), id::varchar)) from u join nodes using (id)) as affected_files)
select *, direct + transitive + least(affected_files, 20) as score, case when direct + transitive + least(affected_files, 20) >= 30 then 'high' when direct + transitive + least(affected_files, 20) >= 10 then 'medium' when direct + transitive + affected_files > 0 then 'low' else 'isolated' end as level from c""")
def impact_score(spark, d):
    return graph.impact_score(*_both(spark, d), 1)


def _impact_sql(origins: list[str], depth: int) -> str:
    rows = ", ".join(f"('{o}')" for o in origins)
    return f"""{GRAPH}, o(origin) as (values {rows}),
    e as (select distinct src, dst, s.file as src_file, t.file as dst_file, (s.file <> t.file)::int as cost from edges join nodes s on s.id = src join nodes t on t.id = dst where src <> dst),
    walk as (select origin, id, 0 as distance from o join nodes on file = origin union select w.origin, e.src, w.distance + e.cost from walk w join e on e.dst = w.id where w.distance + e.cost <= {depth}),
    seen as (select origin, id, file, min(distance) as distance from walk join nodes using (id) group by all),
    best as (select origin, file, min(distance) as distance from seen group by all),
    shown as (select b.origin, b.file, b.distance, min((e.src, e.dst)) as w from e join seen x on x.id = e.src join seen y on y.id = e.dst and y.origin = x.origin
      join best b on b.origin = x.origin and b.file = x.file and b.distance = x.distance where x.distance = y.distance + e.cost and b.file <> b.origin group by all),
    impact as (select origin, file, distance, w[1] as witness_src, w[2] as witness_dst from shown)"""


@query(_impact_sql(["Brand#2/ECONOMY"], 1) + " select * from impact")
def impact_files(spark, d):
    one = spark.createDataFrame([("Brand#2/ECONOMY",)], "origin string").withColumn("file", F.col("origin"))
    return graph.file_impact(*_both(spark, d), one, 1)


MANY = ["Brand#2/ECONOMY", "Brand#17/ECONOMY", "Brand#5/PROMO"]


_MERGED = """, r as (select *, row_number() over (partition by file order by distance, origin) as k from impact)
select file, min(distance) as distance, count(*) as origins, string_agg(origin, ';' order by distance, origin) filter (where k <= 8) as nearest from r group by file"""


@query(_impact_sql(MANY, 1) + _MERGED)
def impact_multi_origin(spark, d):
    many = spark.createDataFrame([(o,) for o in MANY], "origin string").withColumn("file", F.col("origin"))
    return graph.merge_origins(graph.file_impact(*_both(spark, d), many, 1))


@query(_impact_sql(["Brand#2/ECONOMY"], 2) + " select * from impact")
def impact_files_deep(spark, d):
    """Two levels, the default of impact_request."""
    one = spark.createDataFrame([("Brand#2/ECONOMY",)], "origin string").withColumn("file", F.col("origin"))
    return graph.file_impact(*_both(spark, d), one, 2)


@query(_impact_sql(MANY, 2) + _MERGED)
def impact_multi_origin_deep(spark, d):
    many = spark.createDataFrame([(o,) for o in MANY], "origin string").withColumn("file", F.col("origin"))
    return graph.merge_origins(graph.file_impact(*_both(spark, d), many, 2))


def _sample_category():
    """Categories of parts by size, so that every rank occurs."""
    names = [*explorer.CATEGORY_RANK, "other"]
    return F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % len(names) + 1).cast("int"))


CATEGORIES = [*explorer.CATEGORY_RANK, "other"]
_RANKS = f"[{', '.join(str(explorer.CATEGORY_RANK.get(c, 99)) for c in CATEGORIES)}]"
SERVICED = f"""{GRAPH}, named as (select p_partkey as id, case p_size % 7 when 0 then 'OrderService' when 1 then 'OrderController' when 2 then 'Shop.Tests.Order' else p_name end as label, {CATEGORIES!r}[(p_size % {len(CATEGORIES)} + 1)::int] as category,
  {_RANKS}[(p_size % {len(CATEGORIES)} + 1)::int] as rank, p_type as kind, p_brand || '/' || p_type as file from part),
bonus(part, points) as (values ('Controller', -6), ('Service', -5), ('Handler', -4), ('Repository', -3), ('.Tests', 20)),
es as (select e.src, e.dst, relation, (case relation when 'uses' then -10 when 'references' then -3 else 0 end + (select coalesce(sum(points), 0) from bonus where contains(s.label, part)) + case when contains(d.label, '.Tests') then 20 else 0 end)::int as score
  from edges e join named s on s.id = e.src join named d on d.id = e.dst)"""


def _serviced(spark, d):
    """Nodes whose labels reach every bonus and penalty of the edge score."""
    p = lens.table(spark, d, "part")
    n = F.col("p_size") % 7
    label = F.when(n == 0, "OrderService").when(n == 1, "OrderController").when(n == 2, "Shop.Tests.Order").otherwise(F.col("p_name"))
    return p.select(
        F.col("p_partkey").alias("id"), label.alias("label"), _sample_category().alias("category"), F.col("p_type").alias("kind"),
        F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_brand").alias("feature"), F.col("p_type").alias("layer")
    )


@query(f"{SERVICED} select src, dst, relation, score from es order by score, src, dst, relation limit 100")
def graph_prioritized_names(spark, d):
    return graph.prioritized(_serviced(spark, d), lens.edges(spark, d))


@query(f"{SERVICED} select id, label, rank from named order by rank, file, label, kind, id limit 300")
def node_priority(spark, d):
    return explorer.by_priority(_serviced(spark, d), 300).select("id", "label", "rank")


@query(f"""{SERVICED}, o as (select row_number() over (order by score, src, dst, relation) as n, * from es),
walk(step, n, inside, src, dst, relation, score) as (select 0, 0::bigint, []::bigint[], null::bigint, null::bigint, null::varchar, null::int union all
  select w.step + 1, x.n, list_distinct(list_concat(w.inside, [x.src, x.dst])), x.src, x.dst, x.relation, x.score
  from walk w, lateral (select * from o where o.n > w.n and len(list_distinct(list_concat(w.inside, [o.src, o.dst]))) <= 40 order by o.n limit 1) x where w.step < 90)
select src, dst, relation, score from walk where step > 0""")
def bounded_graph(spark, d):
    return explorer.admitted(_serviced(spark, d), lens.edges(spark, d), 40, 90)[1]


@query(f"""{GRAPH}, o as (select dst as id, 'dependency' as role, 1 as r from edges where src = 1 order by dst, relation limit 40), i as (select src as id, 'dependent' as role, 2 as r from edges where dst = 1 order by src, relation limit 40),
n as (select id, min_by(role, r) as role, min(r) as r from (select * from o union all select * from i union all select 1, 'target', 0) group by id),
f as (select id, 'same_file' as role, 3 as r from nodes where file = (select file from nodes where id = 1) and id not in (select id from n) order by id limit 40)
select id, label, role from (select * from (select * from n union all select * from f) order by r, id limit 40) join nodes using (id)""")
def context_nodes(spark, d):
    nodes, edges = _both(spark, d)
    return explorer.context(nodes, edges, 1)[0]


@query(f"{GRAPH} select id, label, file from nodes where lower(label) like '%red%' or id::varchar = 'red' order by id limit 1")
def resolved_target(spark, d):
    return explorer.resolve_target(lens.nodes(spark, d), "Red").select("id", "label", "file")


@query(f"{GRAPH} select id, label from nodes where id = 1 or id in (select src from edges where dst = 1 union select dst from edges where src = 1)")
def isolated_neighbourhood(spark, d):
    return explorer.isolated(*_both(spark, d), 1)[0].select("id", "label")


@query(f"""{SERVICED}, k as (select id from named join part on p_partkey = id where category in ('service', 'api', 'enum') and p_type in ('ECONOMY', 'PROMO') and p_brand < 'Brand#3')
select id, category from named where id in (select id from k) and id in (select unnest([src, dst]) from edges where src in (select id from k) and dst in (select id from k))""")
def visible_nodes(spark, d):
    brands = [f"Brand#{n}" for n in range(1, 100) if f"Brand#{n}" < "Brand#3"]
    return explorer.visible(_serviced(spark, d), lens.edges(spark, d), ["service", "api", "enum"], ["ECONOMY", "PROMO"], brands, True)[0].select("id", "category")


def _tested(spark, d):
    """Nodes whose files are source paths, some of them tests."""
    n = lens.nodes(spark, d)
    return n.withColumn(
        "file",
        F.concat(F.when(F.col("layer").isin("PROMO", "SMALL"), "tests/").otherwise("src/"), F.translate("feature", "#", ""), F.lit("_"), F.lower("layer"), F.lit(".ts"))
    )


_TESTED = f"{GRAPH}, tn as (select id, case when layer in ('PROMO', 'SMALL') then 'tests/' else 'src/' end || replace(feature, '#', '') || '_' || lower(layer) || '.ts' as file from nodes)"
_ORIGINS = ["src/Brand2_economy.ts", "src/Brand17_economy.ts", "src/Brand5_large.ts"]


def _project_impact_sql(depth: int, keep: int, budget: int = 60) -> str:
    sql = _impact_sql(_ORIGINS, depth).replace(GRAPH, _TESTED).replace("join nodes s", "join tn s").replace("join nodes t", "join tn t").replace("join nodes on", "join tn on").replace(
        "walk join nodes using", "walk join tn using"
    )
    return sql + f""", one as (select src, dst, min(relation) as relation from edges group by all),
    wit as (select i.*, 'impact_edge_' || sha256('["snap","native","1",{{"from":"' || witness_src || '","to":"' || witness_dst || '","relation":"' || relation || '","location":null}}]') as witness from impact i join one on src = witness_src and dst = witness_dst),
    rk as (select *, row_number() over (partition by file order by distance, origin, witness) as k from wit),
    item as (select file, min(distance) as distance, count(*) as origins, least(count(*), {keep}) as kept, min_by(witness, k) as first, count(*) > {keep} as cut from rk group by file),
    head as (select *, sum(kept) over (order by distance, file, first rows unbounded preceding) as running, row_number() over (order by distance, file, first) as place from item),
    files as (select * from head where running <= {budget} and place <= 100)"""


def _project_impact(spark, d, budget: int = 60):
    many = spark.createDataFrame([(o,) for o in _ORIGINS], "origin string").withColumn("file", F.col("origin"))
    return impact.project_impact(_tested(spark, d), lens.edges(spark, d), many, 1, "snap", witnesses=budget, keep=2)


@query(_project_impact_sql(1, 2) + " select place, file, distance, origins, cut, first as witness from files")
def project_impact(spark, d):
    return _project_impact(spark, d)["files"].select("place", "file", "distance", "origins", "cut", F.get("near", F.lit(0))["witness"].alias("witness"))


@query(_project_impact_sql(1, 2, 400) + """, t as (select *, sum(kept) over (order by distance, file, first rows unbounded preceding) as r2, row_number() over (order by distance, file, first) as p2 from files where file like 'tests/%')
select p2 as place, file, distance, origins from t where r2 <= 400 - (select sum(kept) from files)""")
def affected_tests(spark, d):
    return _project_impact(spark, d, 400)["tests"].select("place", "file", "distance", "origins")


@query(_project_impact_sql(1, 2) + """, f as (select origin, count(*) as found from wit group by 1), s as (select origin, count(*) as shown from rk join files using (file) where k <= 2 group by 1),
dl as (select distinct x.origin from seen x join e on e.dst = x.id where x.distance + e.cost > 1 and not exists (select 1 from seen y where y.origin = x.origin and y.id = e.src)),
r as (select o.origin, known, coalesce(found, 0) as found, array_to_string(list_filter([case when dl.origin is not null then 'depth_limit' end, case when coalesce(found, 0) > coalesce(shown, 0) then 'output_limit' end], lambda x: x is not null), ';') as reasons
  from (select origin, origin in (select file from tn) as known from o) o left join f using (origin) left join s using (origin) left join dl using (origin))
select origin, case when not known then 'unavailable' when reasons <> '' then 'partial' else 'available' end as status, case when not known then 'not_evaluated' when found > 0 then 'evidence_found' else 'no_evidence_found' end as finding,
case when not known then 'source_unavailable' else reasons end as reasons from r""")
def impact_origins(spark, d):
    """With budgets that nothing exceeds, so that only the depth cuts a traversal short; impact_budget has the other reason."""
    nodes, edges = _tested(spark, d), lens.edges(spark, d)
    many = spark.createDataFrame([(o,) for o in _ORIGINS], "origin string").withColumn("file", F.col("origin"))
    spent = budget.budgeted(nodes, edges.where("src <> dst"), many, 1, 1_000_000, 1_000_000)[0]
    return impact.project_impact(nodes, edges, many, 1, "snap", witnesses=60, keep=2, traversal=spent)["origins"]


_BUDGET = 5_000


@query(f"""{GRAPH}, e as (select distinct src, dst, relation from edges where src <> dst), o(origin, id) as (select 'f' || p_partkey, p_partkey from part where p_partkey in (5, 17, 40)),
l1 as (select distinct origin, e.src as id from o join e on e.dst = o.id where e.src <> o.id),
l2 as (select distinct l1.origin, e.src as id from l1 join e on e.dst = l1.id where (l1.origin, e.src) not in (select (origin, id) from o) and (l1.origin, e.src) not in (select (origin, id) from l1)),
known as (select *, 0 as distance from o union all select *, 1 from l1 union all select *, 2 from l2),
ex as (select origin, k.id as start, distance, e.*, row_number() over (order by origin, distance, e.dst, e.src, e.relation) as g from known k join e on e.dst = k.id),
x as (select * from ex where g <= {_BUDGET}), seen as (select origin, src as id from x where distance < 2 union select origin, id from o),
c as (select o.origin, (select count(*) from seen where seen.origin = o.origin) as states, (select count(*) from x where x.origin = o.origin) as edges, (select count(*) from ex where ex.origin = o.origin) as every,
  exists (select 1 from x where x.origin = o.origin and distance = 2 and (x.origin, x.src) not in (select (origin, id) from seen)) as far from o)
select origin, states, edges, states - 1 as files, case when far or edges < every then 'partial' else 'available' end as status,
  case when states > 1 then 'evidence_found' when every > edges then 'not_evaluated' else 'no_evidence_found' end as finding,
  array_to_string(list_filter([case when far then 'depth_limit' end, case when edges < every then 'traversal_work_limit' end], lambda r: r is not null), ';') as reasons from c""")
def impact_budget(spark, d):
    """Every part a file of its own; three origins share 5,000 examinations, so the first spends most of them and the last may not begin."""
    nodes = lens.nodes(spark, d).withColumn("file", F.concat(F.lit("f"), F.col("id").cast("string")))
    many = nodes.where(F.col("id").isin(5, 17, 40)).select(F.col("file").alias("origin"), "file")
    return budget.budgeted(nodes, lens.edges(spark, d).where("src <> dst"), many, 2, 100_000, _BUDGET)[0]


_PARENTS = """pe as (select p_partkey as src, case when p_partkey % 10 <> 0 then p_partkey - 1 else p_partkey // 3 end as dst from part where p_partkey > 0 union select l_partkey, l_partkey - 100 from lineitem where l_partkey >= 100 and l_quantity > 49)"""


@query(f"""with recursive {_PARENTS}, r(target, id) as (select p_partkey, p_partkey from part where p_partkey in (1, 13, 40, 90) union select r.target, src from r join pe on dst = r.id)
select target, id from r where target <> id""")
def reachable_importers(spark, d):
    """Parts on chains of ten, each chain's head on an earlier part, and some a hundred further on: paths as long as there are parts."""
    p, li = lens.table(spark, d, "part"), lens.table(spark, d, "lineitem")
    k = F.col("p_partkey")
    up = F.when(k % 10 != 0, k - 1).otherwise(F.floor(k / 3))
    edges = p.where(k > 0).select(k.alias("src"), up.cast("long").alias("dst")).unionByName(li.where("l_partkey >= 100 and l_quantity > 49").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") - 100).alias("dst")))
    return graph.reachable_importers(edges, p.where(k.isin(1, 13, 40, 90)).select(k.alias("target"), k.alias("id")))


@query("select distinct lang as language, case when lang in ('en', 'de', 'xx') then 'covered' else 'uncovered' end as state from documents where lang is not null")
def language_coverage(spark, d):
    spoken = spark.createDataFrame([("en",), ("de",), ("xx",)], "language string")
    return impact.coverage(lens.table(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("language")), spoken)


@query(f"""{GRAPH}, s as (select id from nodes where file = (select file from nodes where id = 1) union select src from edges where dst = 1 or src = 1 union select dst from edges where dst = 1 or src = 1)
select src, dst, relation from edges where src in (select id from s) and dst in (select id from s)""")
def context_subgraph(spark, d):
    return graph.context(*_both(spark, d), 1)


@query(f"{GRAPH}, s as (select id from nodes where file = 'Brand#2/ECONOMY') select src, dst, relation from edges where src in (select id from s) or dst in (select id from s)")
def reference_closure(spark, d):
    n, e = _both(spark, d)
    return graph.closure_of_references(e, n.where("file = 'Brand#2/ECONOMY'").select("id"))


_SITES = """with recursive m as (select p_partkey as k, p_partkey // 10 * 10 as g, p_size % 4 as skip, (select max(p_partkey) from part) as top from part),
s as (select k, g as t, skip + 1 as line, length('import type { Sym' || (g + 1) || ' as First, Sym' || (g + 11) || ', Two' || (g + 2) || ' } from ') + 2 as col from m where k % 10 <> 0
  union all select k, g + k % 9 + 1, skip + 2, length('import Main, { Sym' || (g + k % 9 + 1) || ' } from ') + 2 from m where k % 10 <> 0
  union all select k, k + 1, skip + 2, length('export { Sym' || (k + 1) || ' as Sym' || (k + 1) || ' , Sym' || (k + 2) || ' as Two' || (k + 2) || ' } from ') + 2 from m where k % 10 = 0
  union all select k, k + 2, skip + 3, length('export { Sym' || (k + 2) || ' as Two' || (k + 2) || ' } from ') + 2 from m where k % 10 = 0
  union all select k, k + 10, skip + 4, length('export * from ') + 2 from m where k % 10 = 0 and k % 50 <> 40),
e as (select k as src, t as dst, line, col from s where t <> k and t in (select k from m)),
o as (select * from (values (1), (52), (103)) v(origin) where origin in (select k from m)),
walk as (select origin, origin as id, 0 as distance from o union select origin, src, distance + 1 from walk join e on dst = id where distance < 3),
best as (select origin, id, min(distance) as distance from walk group by all having min(distance) > 0)"""


def _written_modules(spark, d):
    """Modules under a head of up to three lines of comments."""
    heads = F.array(*[F.lit("// head\n" * n) for n in range(4)])
    sizes = lens.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return lens.module_files(spark, d).join(sizes, "k").select("path", F.concat(F.get(heads, (F.col("p_size") % 4).cast("int")), "text").alias("text"))


@query(_SITES + """, w as (select b.origin, b.id, b.distance, min('src/m' || n.id || '.ts') as via from best b join e on e.src = b.id join (select * from walk) n on n.origin = b.origin and n.id = e.dst and n.distance = b.distance - 1 group by all)
select 'src/m' || w.origin || '.ts' as origin, 'src/m' || w.id || '.ts' as file, w.distance, min((line, col))[1] as line, min((line, col))[2] as "column", 'src/m' || w.id || '.ts' as source from w join e on e.src = w.id and 'src/m' || e.dst || '.ts' = via group by all""")
def impact_locations(spark, d):
    """Three modules' importers to three steps, each with the line and column of the specifier that leads back."""
    files = _written_modules(spark, d)
    nodes = files.select(F.col("path").alias("id"), F.col("path").alias("file"))
    edges = modules.located_edges(files)
    origins = spark.createDataFrame([(f"src/m{k}.ts",) for k in (1, 52, 103)], "origin string").withColumn("file", F.col("origin"))
    found = impact.with_witnesses(graph.file_impact(nodes, edges.select("src", "dst", "relation"), origins, 3), nodes, edges, "snap")
    return found.select("origin", "file", "distance", "location.line", "location.column", "source")
