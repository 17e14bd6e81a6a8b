"""Queries over scoped declarations, positions, aliases, pattern sets and excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import aliases, excerpts, extract, ordered, patterns, scoped
from . import lens
from .registered import query


def _sources(spark, d):
    """Parts as TypeScript files with what declares nothing: a comment, a template, a string, members, a namespace's own and a function's own."""
    k, s = F.col("p_partkey"), F.col("p_size")
    n = k.cast("string")
    if_ = lambda on, *parts: F.when(on, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])).otherwise("")
    text = F.concat(
        if_(k % 2 == 0, "/* class Gone", n, " {}\n */\n"), F.repeat(F.lit("\n"), (s % 4).cast("int")), F.lit("export class Top"), n, F.lit(" {\n  inner() { class In"), n, F.lit(" {} }\n}\n"),
        if_(k % 3 == 0, "const t", n, " = `class Fake", n, " ${ `x", n, "` }\n`, u", n, " = '};';\n"), if_(k % 5 == 0, "namespace N", n, " { export class Deep", n, " {} }\n"),
        F.repeat(F.lit(" "), (s % 7).cast("int")), F.lit("export default function Main"), n, F.lit("(a = {}) { const inner = 1; }\n"),
    )
    return lens.spread(lens.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("src/s"), n, F.lit(".ts")).alias("path"), text.alias("text"))


@query("""with p as (select p_partkey as k, p_size as s, 1 + case when p_partkey % 2 = 0 then 2 else 0 end + p_size % 4 as top from part), q as (select *, 'src/s' || k || '.ts' as path from p)
select path, 'Top' || k as name, 'class' as word, true as exported, false as is_default, top::bigint as line, 14::bigint as column from q
union all select path, 't' || k, 'const', false, false, top + 3, 7 from q where k % 3 = 0 union all select path, 'u' || k, 'const', false, false, top + 4, 4 from q where k % 3 = 0
union all select path, 'Main' || k, 'function', true, true, top + 3 + case when k % 3 = 0 then 2 else 0 end + case when k % 5 = 0 then 1 else 0 end, s % 7 + 25 from q""")
def scoped_declarations(spark, d):
    return scoped.positions(_sources(spark, d)).drop("at")


@query(f"""with {lens.FILES}, l as (select path, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from files),
m as (select path, line, regexp_split_to_array(content, '[A-Z][a-z]+') as p, regexp_extract_all(content, '[A-Z][a-z]+') as w from l), n as (select *, unnest(w) as word, generate_subscripts(w, 1) as k from m)
select path, word, line::bigint as line, (1 + list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0))::bigint as column from n""")
def declaration_positions(spark, d):
    """Line and column of every capitalised word of all documents, from its offset in the whole text."""
    files = lens.files(spark, d).select("path", "text")
    return scoped.located(scoped.found(files, "[A-Z][a-z]+", {"word": 0}).select("path", "at", "word"), files).drop("at")


@query("""with e as (select 'p' || l_partkey % 400 as name, 1 + (l_returnflag = 'R')::int as cost, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem),
r as (select *, sum(cost) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, cost rows unbounded preceding) as running from e), n as (select name, count(*) filter (where running - cost < 20000) as matches from r group by name)
select name, matches, least(matches, 40) as retained, case when matches > 40 or (select max(running - cost) from r) >= 20000 then 'partial' when matches = 1 then 'unique' when matches = 0 then 'not_found' else 'ambiguous' end as verdict from n""")
def inspected_ceiling(spark, d):
    entries = lens.table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), (F.col("l_partkey") % 400).cast("string")).alias("name"), (F.lit(1) + (F.col("l_returnflag") == "R").cast("int")).alias("cost"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    return extract.inspected_census(entries, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cost"], 40)


@query("""select o_orderkey, row_number() over (order by o_orderpriority, k, o_orderkey % 7, o_orderkey)::bigint as place from (select *, case o_custkey % 4 when 0 then 2 when 1 then 1 when 2 then 0 else 3 end as k from orders)""")
def code_unit_order(spark, d):
    """Texts of an order's priority, a character and a digit: a private-use character sorts after an astral one by code units, before it by code points, and both after letters."""
    m = F.col("o_custkey") % 4
    char = F.when(m == 0, F.lit("")).when(m == 1, F.lit("\U0001f600")).when(m == 2, F.lit("z")).otherwise(F.lit("￮"))
    text = F.concat("o_orderpriority", char, (F.col("o_orderkey") % 7).cast("string"))
    rows = lens.table(spark, d, "orders").select("o_orderkey", texts.code_units(text).alias("units"))
    return ordered.placed(rows, ["units", "o_orderkey"]).select("o_orderkey", (F.col("place") + 1).alias("place"))


BASE = '// what all share\n{"compilerOptions": {"baseUrl": ".", /* two for @lib */ "paths": {"@lib/*": ["lib/*", "alt/*"], "@lib/deep/*": ["deep/*"],}}}'


def _aliased(spark, d):
    """Nations as projects whose configurations extend one of all; a third have paths of their own, in place of its. Parts as files and imports by name."""
    n, p = lens.table(spark, d, "nation"), lens.table(spark, d, "part")
    own = F.when(F.col("n_nationkey") % 3 == 0, ', "compilerOptions": {"paths": {"@own/*": ["./own/*"]}}').otherwise("")
    configs = n.select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit("/tsconfig.json")).alias("path"), F.concat(F.lit('{"extends": "../base"'), own, F.lit("}")).alias("text"))
    configs = configs.unionByName(n.limit(1).select(F.lit("base.json").alias("path"), F.lit(BASE).alias("text")))
    k = F.col("p_partkey")
    project, j = F.concat(F.lit("p"), (k % 25).cast("string")), (k % 40)
    s, name = F.floor(k / 7) % 5, F.concat(F.lit("x"), j.cast("string"))
    specifier = F.when(s == 0, F.concat(F.lit("@lib/"), name)).when(s == 1, F.concat(F.lit("@lib/deep/"), name)).when(s == 2, F.concat(F.lit("@own/"), name)).when(s == 3, "react").otherwise(F.concat(F.lit("@lib/none"), k.cast("string")))
    imports = p.select(F.concat(project, F.lit("/tsconfig.json")).alias("config"), F.concat(project, F.lit("/m"), k.cast("string"), F.lit(".ts")).alias("path"), specifier.alias("specifier"))
    there = [(j % 2 == 0, F.concat(F.lit("lib/"), name, F.lit(".ts"))), (j % 3 == 0, F.concat(F.lit("alt/"), name, F.lit("/index.ts"))), (j % 4 == 0, F.concat(F.lit("deep/"), name, F.lit(".js"))),
             (j % 5 == 0, F.concat(project, F.lit("/own/"), name, F.lit(".ts")))]
    files = p.select(F.explode(F.array_compact(F.array(*[F.when(on, path) for on, path in there]))).alias("path")).distinct()
    return configs, imports, files


@query("""with i as (select p_partkey as k, p_partkey % 25 as n, p_partkey % 40 as j, p_partkey // 7 % 5 as s from part)
select 'p' || n || '/tsconfig.json' as config, 'p' || n || '/m' || k || '.ts' as path, case s when 0 then '@lib/x' || j when 1 then '@lib/deep/x' || j when 2 then '@own/x' || j when 3 then 'react' else '@lib/none' || k end as specifier,
case when n % 3 = 0 then case when s = 2 then '@own/*' end when s in (0, 4) then '@lib/*' when s = 1 then '@lib/deep/*' end as pattern,
case when n % 3 = 0 then case when s = 2 and j % 5 = 0 then 'p' || n || '/own/x' || j || '.ts' end when s = 0 and j % 2 = 0 then 'lib/x' || j || '.ts' when s = 0 and j % 3 = 0 then 'alt/x' || j || '/index.ts' when s = 1 and j % 4 = 0 then 'deep/x' || j || '.js' end as target from i""")
def alias_imports(spark, d):
    configs, imports, files = _aliased(spark, d)
    return aliases.resolved(imports, files, aliases.configurations(configs))


def _scoped_paths(spark, d):
    """Documents as paths of three folders and a name; every seventh name and every ninth folder begins with a dot."""
    k = F.col("doc_id")
    return lens.table(spark, d, "documents").select(F.concat(
        "source", F.lit("/"), F.when(k % 9 == 0, ".").otherwise(""), "lang", F.lit("/"), F.when(k % 7 == 0, ".").otherwise("d"), k.cast("string"), F.when(k % 2 == 0, ".md").otherwise(".ts")
    ).alias("path")).distinct()


@query("""with p as (select distinct source || '/' || case when doc_id % 9 = 0 then '.' else '' end || lang || '/' || case when doc_id % 7 = 0 then '.' else 'd' end || doc_id || case when doc_id % 2 = 0 then '.md' else '.ts' end as path,
  source, lang, doc_id % 9 = 0 as hidden, doc_id % 7 = 0 as dotted, doc_id as k, doc_id % 2 = 0 as md from documents),
w as (select n_nationkey as n, 'w' || n_nationkey as workspace, 'src' || n_nationkey % 10 as root from nation)
select workspace, path from w join p on source = root where (n % 4 = 0 and not hidden and not dotted and not (k % 10 in (1, 3, 5)))
  or (n % 4 = 1 and not hidden and not dotted and md and lang in ('en', 'es')) or (n % 4 = 2 and not (not hidden and lang = 'fr' and not dotted)) or (n % 4 = 3 and hidden and not dotted and lang <> 'de')""")
def pattern_scopes(spark, d):
    """Nations as workspaces: recursive, class and dot patterns, and folders without patterns, each with excludes."""
    n = lens.table(spark, d, "nation")
    m, root = F.col("n_nationkey") % 4, F.concat(F.lit("src"), (F.col("n_nationkey") % 10).cast("string"))
    at = lambda *tails: F.array(*[F.concat(root, F.lit(t)) for t in tails])
    include = F.when(m == 0, at("/**")).when(m == 1, at("/e[ns]/*.md")).when(m == 3, at("/.e?/*", "/.[!de]?/d*"))
    exclude = F.when(m == 0, at("/*/d*[135].??")).when(m == 2, at("/fr/*", "/zz/**"))
    spaces = n.select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("id"), root.alias("folder"), include.alias("include"), exclude.alias("exclude"))
    return patterns.scopes(_scoped_paths(spark, d), spaces)


_LETTERS = "regexp_replace(coalesce(text, ''), '[^a-z \\n]', '', 'g')"


@query(f"""with t as (select case when source in ('src1', 'src2') then 0 else 1 end as rank, source || '/' || doc_id as path, {_LETTERS} as text, string_split({_LETTERS}, chr(10)) as lines from documents),
e as (select rank, path, substring(array_to_string(lines[1:12], chr(10)), 1, 512) as x, strlen(text) as n, len(lines) as k from t),
r as (select *, sum(strlen(x)) over (order by rank, path rows unbounded preceding)::bigint as running, row_number() over (order by rank, path) - 1 as place from e)
select case rank when 0 then 'documents' else 'files' end as section, path, x as text, 1 as start_line, least(12, len(string_split(x, chr(10))))::int as end_line, k > 12 or strlen(x) < n as truncated, place, running from r where running <= 200000""")
def context_excerpts(spark, d):
    """First windows of all documents, two sources first, within 200,000 bytes over both sections."""
    rows = lens.table(spark, d, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z \n]", "").alias("text"), F.col("source").isin("src1", "src2").alias("doc")
    )
    return excerpts.sectioned({"documents": rows.where("doc"), "files": rows.where("not doc")}, 200_000)


@query("""with w as (select s_suppkey as k, s_nationkey as n, s_acctbal as b from supplier), p as (select k, unnest(case when k % 50 = 0 then range(0, 101) else range(0, k % 14) end) as i from w),
c as (select k, case when i % 4 = 3 then 'Bad ' || i else 'p' || ((k * 7 + i * 5) % 23) || '.ok' end as v from p), s as (select k, list_sort(list(distinct v)) as l from c where v not like 'Bad%' group by k)
select 's' || w.k as id, case when n % 3 > 0 then n % 3 = 1 end as can_read, case when b > 0 then b > 5000 end as can_write, (n % 3 > 0)::int + (b > 0)::int as declared,
array_to_string(coalesce(l, [])[1:8], ',') as preconditions, coalesce(len(l), 0) > 8 as truncated, w.k % 50 = 0 as refused from w left join s using (k)""")
def context_constraints(spark, d):
    """Suppliers as workspaces that declare some permissions, an unknown one, and preconditions of which a quarter are unsound."""
    k, n, b = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    permissions = F.create_map(
        F.lit("read"), F.when(n % 3 > 0, n % 3 == 1), F.lit("write"), F.when(b > 0, b > 5000), F.lit("fly"), F.lit(True)
    )
    count = F.when(k % 50 == 0, 101).otherwise(k % 14).cast("int")
    items = F.transform(F.sequence(F.lit(1), count), lambda i: F.when((i - 1) % 4 == 3, F.concat(F.lit("Bad "), (i - 1).cast("string"))).otherwise(F.concat(F.lit("p"), ((k * 7 + (i - 1) * 5) % 23).cast("string"), F.lit(".ok"))))
    rows = lens.table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), permissions.alias("permissions"), F.when(count > 0, items).alias("preconditions"))
    c = excerpts.constraints(rows)
    return c.select(
        "id", F.col("permissions")["read"].alias("can_read"), F.col("permissions")["write"].alias("can_write"), F.size("permissions").alias("declared"),
        F.array_join("preconditions", ",").alias("preconditions"), "truncated", "refused"
    )
