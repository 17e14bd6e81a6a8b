"""Text, file and symbol queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import extract
from . import lens
from .lens import FILES
from .registered import query

WORDS = ", ".join(f"'{w}'" for w in texts.IGNORED_WORDS)


@query(f"""with {FILES}, f as (select split_part(path, '/', 1) as source, * from files), l as (select source, sha256(path)[1:3] as leaf, count(*) as n, sum(byte_size) as b, sha256(string_agg(path || ':' || sha256, chr(10) order by path || ':' || sha256)) as d from f group by all)
select source, sum(n)::bigint as files, sum(b)::bigint as bytes, sha256(string_agg(leaf || ':' || d, chr(10) order by leaf || ':' || d)) as token from l group by source""")
def file_snapshot(spark, d):
    return extract.snapshot_token(lens.files(spark, d).withColumn("source", F.substring_index("path", "/", 1)), "source")


@query(f"""with {FILES}, f as (select case when source = 'src1' then source else source || '/' || split_part(split_part(path, '/', 2), '.', 1)::bigint // 100 end as project, * from (select split_part(path, '/', 1) as source, * from files)),
t as (select project, count(*) as n, max(path like 'src2/%') as wide, string_agg('["' || path || '","' || sha256 || '"]', ',' order by path) as pairs from f group by 1)
select project, n as files, case when n <= 500 then sha256('["' || project || '",{{"status":' || case when wide then '"available"' else '"not_git"' end || ',"commitSha":' || case when wide then '"' || sha256(project) || '"' else 'null' end
  || ',"branch":null,"repositoryId":null,"worktreeId":null,"dirty":' || case when wide then 'false' else 'null' end || ',"isGit":' || wide::varchar || ',"isLinkedWorktree":null}},[' || pairs || ']]') end as token from t""")
def provider_tokens(spark, d):
    """Hundreds of documents as projects, one source as a single project, which may have too many files; those of another have a revision."""
    files = lens.files(spark, d).withColumn("source", F.substring_index("path", "/", 1))
    number = F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("long")
    files = files.withColumn("project", F.when(F.col("source") == "src1", "src1").otherwise(F.concat_ws("/", "source", F.floor(number / 100).cast("string"))))
    git = F.startswith("project", F.lit("src2/"))
    projects = files.select("project").distinct().select(
        "project", F.when(git, "available").otherwise("not_git").alias("status"), F.when(git, F.sha2("project", 256)).alias("commitSha"), F.when(git, False).alias("dirty"), git.alias("isGit")
    )
    return extract.provider_tokens(files, projects)


@query(f"""with {FILES}, w as (select path, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1))) as identifier from files)
select identifier, count(*) as files from w where length(identifier) >= 3 and identifier not in ({WORDS}) group by 1""")
def identifier_index(spark, d):
    return extract.identifier_index(lens.files(spark, d))


def _symbols(spark, d):
    p = lens.table(spark, d, "part")
    named = p.select(F.col("p_partkey").alias("id"), F.concat_ws("#", "p_name", F.col("p_size").cast("string")).alias("name"))
    deps = [p.select(
        F.col("p_partkey").alias("id"), F.concat_ws("#", "p_name", (F.col("p_size") + n).cast("string")).alias("dep_name"), F.lit(r).alias("relation")
    ) for n, r in ((1, "uses"), (2, "references"))]
    return deps[0].unionByName(deps[1]), named


@query("""with s as (select p_partkey as id, p_name || '#' || p_size as name from part), e as (select p_partkey as id, p_name || '#' || (p_size + 1) as dep_name, 'uses' as relation from part union all select p_partkey, p_name || '#' || (p_size + 2), 'references' from part)
select distinct e.id as src, s.id as dst, relation from e join s on e.dep_name = s.name where e.id <> s.id""")
def symbol_edges(spark, d):
    return extract.dependency_edges(*_symbols(spark, d))


@query(f"""with {FILES} select path, coalesce(nullif(regexp_extract(text, '(?m)^#[ \\t]+(.+?)[ \\t]*#*[ \\t]*\\r?$', 1), ''), regexp_replace(split_part(path, '/', 2), '\\.[^.]+$', '')) as title,
case when text = '' then 0 else len(string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n'))::int end as lines, byte_size from files""")
def doc_titles(spark, d):
    return lens.files(spark, d).select("path", texts.title(F.col("text"), F.col("path")).alias("title"), texts.line_count(F.col("text")).alias("lines"), "byte_size")


BOUND = r"\b"
RED = "regexp_replace(regexp_replace(regexp_replace(text, '" + "', '[REDACTED]', 'g'), '".join(
    p.replace("'", "''").replace("(?<![A-Za-z0-9_])", BOUND).replace("(?![A-Za-z0-9_])", BOUND) for p in texts.SECRETS
) + "', '[REDACTED]', 'g')"


@query(f"with {FILES}, r as (select path, {RED} as t from files) select path, t[1 : list_max(list_filter(range(0, 513), lambda n: strlen(t[1 : n]) <= 512))] as text from r")
def redacted_text(spark, d):
    return lens.files(spark, d).select("path", texts.bounded(F.col("text"), 512).alias("text"))


@query("select lang, source, count(*) as n from documents group by grouping sets ((lang, source), (lang), (source))")
def structure_rollup(spark, d):
    return extract.rollup(lens.table(spark, d, "documents"), ["lang", "source"])


@query("select case k when 1 then 'unique' else 'ambiguous' end as verdict, count(*) as keys from (select count(*) as k from lineitem group by l_orderkey || '/' || l_linenumber) group by 1")
def duplicate_keys(spark, d):
    rows = lens.table(spark, d, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))
    return extract.duplicates(rows, "key")


@query("select url, not (regexp_matches(p, '[\\x00-\\x1f\\x7f]') or p = '' or regexp_matches('/' || p || '/', '//|/\\.{1,2}/|/(?:\\.git|\\.vs|\\.vscode|node_modules|bin|obj|dist|build|coverage|\\.next)/') or regexp_matches('/' || lower(p) || '/', '/(?:\\.env(?:\\.[^/]*)?|\\.ssh|\\.aws|\\.azure|\\.npmrc|\\.pypirc|credentials?(?:\\.[^/]*)?|secrets?(?:\\.[^/]*)?|service[-_]account(?:\\.[^/]*)?|id_rsa|id_ed25519)/')) as allowed from (select url, regexp_replace(url, '^[a-z]+://', '') as p from pages)")
def paths_allowed(spark, d):
    return lens.table(spark, d, "pages").select("url", texts.path_allowed(F.regexp_replace("url", "^[a-z]+://", "")).alias("allowed"))


@query("select case when n > 40 then 'partial' when n = 0 then 'not_found' when n = 1 then 'unique' else 'ambiguous' end as verdict, n as matches from (select count(*) as n from part where p_name = 'red widget')")
def decl_census(spark, d):
    declared = lens.table(spark, d, "part").select(F.col("p_name").alias("name"))
    return extract.census(declared, "red widget", 40)
