"""Queries over project structure, modules, naming rules and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import extract, modules, structure
from . import lens
from .lens import DOTNET
from .registered import query


@query(f"""with {DOTNET}, s as (select path, name, 'class' as kind, case when k % 6 = 0 then project || '.Core' when k % 3 = 0 then project || '.Billing' else project || '.Models' end as namespace, 0 as ord from dnf
union all select path, 'Kind' || k, 'enum', case when k % 6 = 0 then project || '.Core' when k % 3 = 0 then project || '.Billing' else project || '.Models' end, 1 from dnf)
select path || '#' || name as id, path, name, kind, namespace, ord from s""")
def dotnet_symbols(spark, d):
    return structure.symbols(lens.dotnet_files(spark, d))


@query(f"""with {DOTNET}, d as (select path || '#' || n as id, k, unnest([(k * 7 + 3) % 200, (k * 11 + 5) % 200, (k * 13 + 1) % 200]) as t from (select *, unnest([name, 'Kind' || k]) as n from dnf) where n = name
union select path || '#Kind' || k, k, unnest([(k * 7 + 3) % 200, (k * 13 + 1) % 200]) from dnf)
select distinct d.id, t.name as dep_name from d join dn t on t.k = d.t""")
def likely_dependencies(spark, d):
    return structure.likely_dependencies(lens.dotnet_files(spark, d))


@query(f"""with {DOTNET}, d as (select path || '#' || name as src, unnest([(k * 7 + 3) % 200, (k * 11 + 5) % 200, (k * 13 + 1) % 200]) as t from dnf union all select path || '#Kind' || k, unnest([(k * 7 + 3) % 200, (k * 13 + 1) % 200]) from dnf)
select distinct d.src, t.path || '#' || t.name as dst, 'uses' as relation from d join dnf t on t.k = d.t where src <> t.path || '#' || t.name""")
def dotnet_edges(spark, d):
    files = lens.dotnet_files(spark, d)
    return extract.dependency_edges(structure.likely_dependencies(files).withColumn("relation", F.lit("uses")), structure.symbols(files))


@query(f"""with {DOTNET} select feature, count(*) as files, array_to_string(list_sort(list_distinct(list(project))), ';') as projects,
array_to_string(list_filter(['API', 'Application', 'Domain', 'Infrastructure'], lambda x: list_contains(list(layer), x)), ';') as layers from dnf where feature is not null group by feature""")
def feature_rollup(spark, d):
    return structure.feature_rollup(structure.with_features(lens.dotnet_files(spark, d)))


@query(f"with {DOTNET} select project, layer, count(*) as files, count(distinct feature) as features from dnf group by all")
def project_rollup(spark, d):
    return structure.project_rollup(structure.with_features(lens.dotnet_files(spark, d)))


@query(f"""with {DOTNET} select (select count(*) from dnf) as files, 4 as projects, 4 as layers, (select count(distinct feature) from dnf) as features, (select count(*) from (select distinct l_partkey, l_suppkey from lineitem)) as dependencies,
(select count(*) from documents where doc_id % 10 = 0) as documents, 'all;project;layer;feature' as modes""")
def project_overview(spark, d):
    docs, _ = structure.document_index(_documents(spark, d), most=1 << 30)
    return structure.overview(structure.with_features(lens.dotnet_files(spark, d)), lens.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), docs)


def _documents(spark, d):
    """Documents as files of a project: every tenth is an architecture decision, others are notes or manifests."""
    k = F.col("doc_id")
    path = F.when(
        k % 10 == 0, F.concat(F.lit("docs/adr/"), k.cast("string"), F.lit(".md"))
    ).when(k % 10 == 1, F.concat(F.lit("a"), k.cast("string"), F.lit("/AGENT.md"))).when(
        k % 10 == 2, F.concat(F.lit("p"), k.cast("string"), F.lit("/PROJECT.md"))
    ).otherwise(F.concat(F.lit("notes/"), k.cast("string"), F.lit(".txt")))
    text = F.coalesce("text", F.lit(""))
    return lens.table(spark, d, "documents").select(path.alias("path"), text.alias("text"), F.octet_length(text).cast("long").alias("byte_size"), k.alias("k"))


@query("""select 'adr' as kind, 'docs/adr/' || doc_id || '.md' as path, strlen(coalesce(text, ''))::bigint as byte_size from documents where doc_id % 10 = 0 and strlen(coalesce(text, '')) <= 20000 order by path limit 50""")
def document_index(spark, d):
    return structure.document_index(_documents(spark, d), most=50, largest=20_000)[0].select("kind", "path", "byte_size")


_MANIFESTS = "m as (select 'a' || doc_id || '/AGENT.md' as path, case when doc_id % 7 = 0 then null else 'w' || (doc_id // 20) % 40 end as id, case when doc_id % 3 = 0 then 'other' else 'shop' end as project from documents where doc_id % 10 = 1)"


def _manifests(spark, d):
    k = F.col("k")
    rows = _documents(spark, d).where("path like 'a%/AGENT.md'")
    return rows.select(
        "path", F.when(k % 7 != 0, F.concat(F.lit("w"), (F.floor(k / 20) % 40).cast("string"))).alias("id"),
        F.when(k % 3 == 0, "other").otherwise("shop").alias("project")
    )


@query(f"with {_MANIFESTS}, g as (select *, count(*) over (partition by id) as n from m where id is not null and project = 'shop') select id, path from g where n = 1")
def workspace_index(spark, d):
    return structure.workspace_index(_manifests(spark, d), "shop", most=1 << 30)[0]


@query(f"""with {_MANIFESTS}, g as (select *, count(*) over (partition by id) as n from m where id is not null and project = 'shop'),
e as (select 0 as r, 'workspace' as source, case when id is null then 'invalid_manifest' else 'workspace_project_mismatch' end as code, path from m where id is null or project <> 'shop'
union all select 0, 'workspace', 'duplicate_workspace_id', path from g where n > 1
union all select 1, 'document', 'document_too_large', 'docs/adr/' || doc_id || '.md' from documents where doc_id % 10 = 0 and strlen(text) > 20000)
select source, code, path from (select * from e order by r, path, code limit 60)""")
def index_issues(spark, d):
    return structure.issues(
        {"workspace": structure.workspace_index(_manifests(spark, d), "shop")[1], "document": structure.document_index(_documents(spark, d), largest=20_000)[1]},
        60
    )


@query("""with f as (select 'packages/' || lower(replace(p_brand, '#', '')) || '/' || p_type || case when p_size % 3 = 0 then '/package.json' when p_size % 3 = 1 then '/' || p_type || '.csproj' else '/index.ts' end as path from part)
select distinct regexp_replace(path, '/[^/]*$', '') as module, case when path like '%.csproj' then 'csproj' else 'workspace' end as marker from f
where path like '%.csproj' or (path like '%/package.json' and path like 'packages/brand1%/%' and path not like '%/PROMO/%')""")
def workspace_modules(spark, d):
    p = lens.table(spark, d, "part")
    tail = F.when(F.col("p_size") % 3 == 0, "/package.json").when(F.col("p_size") % 3 == 1, F.concat(F.lit("/"), "p_type", F.lit(".csproj"))).otherwise("/index.ts")
    paths = p.select(F.concat(F.lit("packages/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/"), "p_type", tail).alias("path"))
    return structure.modules(paths, ["packages/brand1*/*", "!**/PROMO"])


MODULES = """m as (select p_partkey as k, (p_partkey // 10) * 10 as g, (select max(p_partkey) from part) as top from part),
x as (select k, 'Sym' || k as name, k as origin, 'Sym' || k as label from m where k % 10 <> 0 union all select k, 'default', k, 'Sym' || k from m where k % 10 <> 0),
b0 as (select k, 'Sym' || (k + 1) as name, k + 1 as origin, 'Sym' || (k + 1) as label from m where k % 10 = 0 and k + 1 <= top union all select k, 'Two' || (k + 2), k + 2, 'Sym' || (k + 2) from m where k % 10 = 0 and k + 2 <= top),
b as (select a.k, c.name, c.origin, c.label from m a join b0 c on c.k >= a.k and c.k // 50 = a.k // 50 where a.k % 10 = 0),
e as (select k, name, origin, label from x union all select k, name, origin, label from b)"""


def _declared(spark, d):
    return extract.exports(lens.module_files(spark, d)).select("path", "name")


@query(f"with {MODULES} select 'src/m' || k || '.ts' as path, name, 'src/m' || origin || '.ts' as origin, label from e where name <> 'default'")
def barrel_closure(spark, d):
    return modules.export_table(lens.module_files(spark, d).drop("k"), _declared(spark, d))


@query(f"""with {MODULES}, w as (select k, g as t, unnest(['Sym' || (g + 1), 'Sym' || (g + 11), 'Two' || (g + 2)]) as name from m where k % 10 <> 0 union all select k, g + k % 9 + 1, 'Sym' || (g + k % 9 + 1) from m where k % 10 <> 0),
r as (select w.k, e.origin, e.label from w join e on e.k = w.t and e.name = w.name where w.t <> w.k), l as (select m.k, 7 as origin, 'Sym7' as label from m where k % 10 <> 0)
select distinct 'src/m' || k || '.ts' as src_file, 'src/m' || origin || '.ts' as dst_file, label, verdict from (select *, 'resolved' as verdict from r union all select *, 'by_name' from l) where k <> origin""")
def import_edges(spark, d):
    files = lens.module_files(spark, d).drop("k")
    return modules.import_edges(files, _declared(spark, d))


@query(f"""with {MODULES} select 'src/m' || k || '.ts' as src_file, 'src/m' || g || '.ts' as dst_file from m where k % 10 <> 0
union select 'src/m' || k || '.ts', 'src/m' || (k + 10) || '.ts' from m where k % 10 = 0 and k % 50 <> 40 and k + 10 <= top""")
def barrel_edges(spark, d):
    return modules.barrel_edges(lens.module_files(spark, d).drop("k"))


@query("""select p_partkey, lower(printf('%x', abs(list_reduce(list_prepend(0::bigint, list_transform(string_split(p_name || p_partkey, ''), lambda c: unicode(c)::bigint)),
lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)))) as code from part""")
def simple_hashes(spark, d):
    return lens.table(spark, d, "part").select("p_partkey", codes.simple_hash(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("code"))


@query("select event_id, '{\"a\":{\"b\":[1,2.5,null],\"k\":' || (props::json ->> 'k') || '},\"user\":\"u' || user_id || '\",\"z\":' || (value * 100)::int || '}' as canonical, strlen(canonical)::int as n_bytes from events")
def canonical_json(spark, d):
    e = lens.table(spark, d, "events")
    raw = F.concat(
        F.lit('{ "z": '), F.round(F.col("value") * 100).cast("int").cast("string"), F.lit('.0, "user" : "u'), F.col("user_id").cast("string"),
        F.lit('", "a": {"k": '), F.get_json_object("props", "$.k"), F.lit(', "b": [1.0, 2.50, null]}}')
    )
    return e.select("event_id", codes.canonical_json(raw).alias("canonical")).withColumn("n_bytes", F.octet_length("canonical"))


@query("""select p_partkey, case p_size % 4 when 0 then 'Part' || p_partkey when 1 then p_type when 2 then p_name else null end as clean from part""".replace(
    "p_name else", "split_part(p_name, ' ', 2) else"
))
def clean_types(spark, d):
    raw = F.when(
        F.col("p_size") % 4 == 0, F.concat(F.lit("List<Part"), F.col("p_partkey").cast("string"), F.lit(">?"))
    ).when(
        F.col("p_size") % 4 == 1, F.concat(F.lit("Map<string, "), "p_type", F.lit("[]>"))
    ).when(F.col("p_size") % 4 == 2, F.concat(F.lit("("), "p_name", F.lit(")"))).otherwise("<?>")
    return lens.table(spark, d, "part").select("p_partkey", codes.clean_type(raw).alias("clean"))


@query("""select p_partkey, case p_size % 4 when 0 then p_type when 1 then '"' || p_name || '"' when 2 then null else '"' || p_brand || '\\"\\\\"' end as quoted from part""")
def quoted_labels(spark, d):
    raw = F.when(F.col("p_size") % 4 == 0, F.col("p_type")).when(F.col("p_size") % 4 == 1, F.col("p_name")).when(
        F.col("p_size") % 4 == 2, F.concat("p_name", F.lit("​"))
    ).otherwise(F.concat("p_brand", F.lit('"\\')))
    return lens.table(spark, d, "part").select("p_partkey", codes.quoted(raw).alias("quoted"))


@query("select doc_id, replace(replace(replace(coalesce(text, ''), chr(9), '\\x09'), chr(10), '\\x0a'), chr(13), '\\x0d') as shown from documents")
def escaped_text(spark, d):
    return lens.table(spark, d, "documents").select("doc_id", codes.escaped_controls(F.col("text")).alias("shown"))


@query("""select p_partkey, p_size % 5 in (0, 4) as ok from part""")
def symbol_labels(spark, d):
    n = F.col("p_size") % 5
    raw = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("../"), "p_name")).when(
        n == 2, F.concat(F.lit("https://"), "p_type")
    ).when(n == 3, F.concat("p_name", F.lit("/.git/x"))).otherwise(F.concat(F.lit("std::"), "p_type"))
    return lens.table(spark, d, "part").select("p_partkey", codes.symbol_label(raw).alias("ok"))


@query("""with l as (select doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') as lines from documents) select doc_id, coalesce(doc_id % 7 between 1 and len(lines) and doc_id % 60 between 1 and length(lines[doc_id % 7]) + 1, false) as ok from l""")
def source_positions(spark, d):
    k = F.col("doc_id")
    return lens.table(spark, d, "documents").select("doc_id", codes.position_in(F.coalesce("text", F.lit("")), (k % 7).cast("int"), k % 60).alias("ok"))


@query("select p_partkey from part where contains(lower(p_name), 'red') or contains(lower(p_name), 'small')")
def lexical_terms(spark, d):
    return lens.table(spark, d, "part").where(codes.lexical(F.col("p_name"), codes.terms_of("Update the RED parts", "and small; fix"))).select("p_partkey")


@query("""with p as (select ['src/' || p_type || '/components/' || p_name || '.tsx', 'app/hooks/' || p_type || '.ts', 'lib/' || p_name || '.ts', p_brand || '/services/x.ts', 'src/x.ts'][(p_size % 5 + 1)::int] as path, p_size % 5 as n, p_type, p_name, p_brand from part)
select distinct path, ['presentation', 'logic', 'common', 'services', 'unknown'][(n + 1)::int] as layer, [p_type, 'shared', 'shared', p_brand, 'shared'][(n + 1)::int] as feature from p""")
def folder_names(spark, d):
    c = F.col
    path = F.element_at(
        F.array(
            F.concat(F.lit("src/"), c("p_type"), F.lit("/components/"), c("p_name"), F.lit(".tsx")),
            F.concat(F.lit("app/hooks/"), c("p_type"), F.lit(".ts")), F.concat(F.lit("lib/"), c("p_name"), F.lit(".ts")),
            F.concat(c("p_brand"), F.lit("/services/x.ts")), F.lit("src/x.ts")
        ),
        (c("p_size") % 5 + 1).cast("int")
    )
    return lens.table(spark, d, "part").select(path.alias("path")).distinct().select(
        "path", codes.folder_layer(c("path")).alias("layer"), codes.folder_feature(c("path")).alias("feature")
    )


@query("""with k as (select p_partkey as k, p_size % 6 as m, lower(p_type) as t from part)
select 'src/' || t || '/hooks/m' || k || '.tsx' as path, ['use' || k, 'Part' || k || 'Provider', 'Part' || k, 'part' || k, 'PartService', 'PartContext'][(m + 1)::int] as name, ['hook', 'component', 'class', 'function', 'interface', 'component'][(m + 1)::int] as kind,
['hook', 'provider', 'component', 'symbol', 'service', 'context'][(m + 1)::int] as category, 'logic' as layer, t as feature, m <> 3 as exported, m = 2 as is_default from k""")
def module_symbols(spark, d):
    k, m = F.col("p_partkey").cast("string"), F.col("p_size") % 6
    texts = [F.concat(F.lit("export function use"), k, F.lit("() {}")), F.concat(F.lit("export const Part"), k, F.lit("Provider = 1; const x = 2;")), F.concat(
        F.lit("import a from 'b'\nexport default abstract class Part"), k, F.lit(" {}")
    ),
             F.concat(
                 F.lit("async function part"), k, F.lit("() {}\nlet y = 1")
             ), F.lit("export interface PartService {}"), F.lit("export let PartContext = 0\nexport const PartContext = 1")]
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/hooks/m"), k, F.lit(".tsx"))
    return modules.symbols(lens.table(spark, d, "part").select(path.alias("path"), F.element_at(F.array(*texts), (m + 1).cast("int")).alias("text")))
