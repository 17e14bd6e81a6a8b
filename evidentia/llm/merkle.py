"""A Merkle manifest of a dataset: sorted leaf runs, a node store in Parquet by level, proofs read off by coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import placed
from .common import fresh_path, small, written

#: Nodes that make one node of the next level.
FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that fields side by side are told apart; a null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, shown): a row for each document. tree names its language so that null is first; shown is the leaf of the text with small letters where it is tampered with."""
    fields = lambda text: F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = fields(F.col("text"))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
        F.when(tampered, fields(F.translate("text", UPPER, LOWER))).alias("shown")
    )
    return rows.withColumn("shown", F.coalesce("shown", "leaf"))


def joined_digest(members: Column) -> Column:
    return F.sha2(F.array_join(F.transform(members, lambda m: m["digest"]), ""), 256)


def around(members: Column, at: Column) -> Column:
    """The digests before and after the member at `at` (from 0) of its run, each joined."""
    digests = F.transform(members, lambda m: m["digest"])
    after = F.slice(digests, at + 2, F.size(digests))
    return F.struct(F.array_join(F.slice(digests, F.lit(1), at), "").alias("before"), F.array_join(after, "").alias("after"))


def raised(nodes: DataFrame, name: str, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, digest) of each tree's root, and the store's levels from the lowest: (tree, n, run, members), where members are the `fan` or fewer nodes of a run in order.

    nodes: tree, n (nodes of the tree), place (from 0), digest, and what else the lowest runs shall carry. The store is a folder for each level. Every level is made by one pass over
    the files of the level below, of which it has an eighth; there are log8 of the largest tree of them. A tree that has come down to one node is done.
    """
    path, spark, found, levels = fresh_path(nodes.sparkSession, name), nodes.sparkSession, [], []
    more = [c for c in nodes.columns if c not in ("tree", "n", "place", "digest")]
    while True:
        found.append(nodes.where("n = 1").select("tree", "digest"))
        runs = nodes.where("n > 1").groupBy("tree", "n", F.floor(F.col("place") / fan).cast("long").alias("run"))
        level = runs.agg(F.array_sort(F.collect_list(F.struct("place", "digest", *more))).alias("members"))  # `fan` at most
        at = f"{path}/level={len(levels)}"
        level.write.option("compression", "zstd").parquet(at)
        level = spark.read.schema(level.schema).parquet(at)
        if not level.head(1):
            break
        levels.append(level)
        nodes, more = level.select("tree", F.ceil(F.col("n") / fan).cast("long").alias("n"), F.col("run").alias("place"), joined_digest(F.col("members")).alias("digest")), []
    roots = found[0]
    for rest in found[1:]:
        roots = roots.unionByName(rest)
    return written(roots, f"{name}-roots"), levels


def depth(n: Column, fan: int = FAN) -> Column:
    """Levels above n nodes."""
    return F.size(F.filter(F.array(*[F.lit(fan**k) for k in range(63) if fan**k < 1 << 63]), lambda p: n > p))


def descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest members of the levels with their proofs: (tree, place, digest, carried columns, up, and the other columns of tops).

    tops: tree, depth, up (the steps from the tree's root upwards) and what else shall be handed down. Level by level from the top, runs meet the steps of their parent by coordinate
    (tree, run): a sort-merge join of two tables of which neither has a key with more than one row. A step is what lies before and after a node in its run.
    """
    rest = [c for c in tops.columns if c not in ("tree", "depth", "up")]
    known = None
    for k in reversed(range(len(levels))):
        parents = tops.where(F.col("depth") == k + 1).select("tree", F.lit(0).cast("long").alias("run"), "up", *rest)
        parents = parents if known is None else parents.unionByName(known)
        runs = levels[k].join(parents, ["tree", "run"]).select("tree", "up", "members", *rest, F.posexplode("members").alias("at", "m"))
        nodes = runs.select("tree", "m.*", F.concat(F.array(around(F.col("members"), F.col("at"))), F.col("up")).alias("up"), *rest)
        known = nodes.select("tree", F.col("place").alias("run"), "up", *rest)
    return nodes


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot (of its language), root, proof_sha256, folded_root, verified.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored. A leaf is the digest of the row's fields. The leaves of a language in order of doc_id, nulls first, make a tree of
    runs of `fan`; the languages' roots, null first and then by bytes, make the tree whose root is the manifest's. Rows that repeat a doc_id are ordered by their leaves; wholly equal rows
    have places of their own, in any order, as their leaves are equal. folded_root is worked out from the leaf, of the text with small letters where it is tampered with, and the siblings
    of the proof; verified says that it is the root. Empty texts have a leaf like others; an empty table has no rows.

    Texts are read once and never shuffled, only their digests are. Leaves are dealt by ranges of (tree, doc_id), so a language with most rows is many sorted runs, and places come
    from totals per run.
    """
    spark = docs.sparkSession
    rows = written(leaves(docs), "leaves")
    sizes = written(rows.groupBy("tree").agg(F.count("*").alias("n")), "sizes")  # a row for each language
    if not sizes.head(1):
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return spark.createDataFrame([], schema)
    nodes = placed(rows, ["doc_id", "leaf"], ["tree"]).join(small(sizes), "tree").withColumnRenamed("leaf", "digest")
    nodes = written(nodes, "nodes")
    roots, levels = raised(nodes, "manifest", fan)

    order = placed(roots.select(F.col("tree").alias("lang_tree"), "digest"), ["lang_tree"])
    above = written(order.select(F.lit("").alias("tree"), F.lit(sizes.count()).cast("long").alias("n"), "place", "digest", "lang_tree"), "subroots")
    top, upper = raised(above, "languages", fan)
    root = top.first()["digest"]
    if upper:
        start = spark.createDataFrame([("", len(upper))], "tree string, depth int").withColumn("up", F.array().cast("array<struct<before:string,after:string>>"))
        subroots = descended(upper, start).select(F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), "up")
    else:
        subroots = above.select(F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), F.array().cast("array<struct<before:string,after:string>>").alias("up"))
    tops = written(subroots.join(sizes, "tree").select("tree", depth(F.col("n"), fan).alias("depth"), "up", "subroot"), "tops")

    columns = ["doc_id", "digest", "shown", "subroot", "up"]
    out = nodes.where("n = 1").join(tops, "tree").select(*columns)
    if levels:
        out = descended(levels, tops).select(*columns).unionByName(out)
    siblings = F.array_join(F.transform("up", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("up", F.col("shown"), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    return out.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8, upper: int = 3, fan: int = FAN) -> str:
    """The same in SQL, for trees of at most fan**levels leaves and fan**upper languages."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    letters = f"translate(text, '{UPPER}', '{LOWER}')"
    # crc32, byte by byte and bit by bit: -1 stands for a shift
    todo = "list_prepend(4294967295, flatten(list_transform(string_split(doc_id::varchar, ''), lambda b: list_prepend(ascii(b)::bigint, [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[]))))"
    crc = f"xor(list_reduce({todo}, lambda c, v: case when v < 0 then xor(c >> 1, 3988292384 * (c & 1)) else xor(c, v) end), 4294967295)"
    parts = [
        f"d as (select doc_id, coalesce('=' || lang, '-') as tree, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(letters)} else {leaf('text')} end as shown from documents)",
        "a0 as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n, leaf as digest from d)",
    ]
    for name, top in (("a", levels), ("b", upper)):
        if name == "b":
            roots = " union all ".join(f"select tree, digest from a{k} where n = 1" for k in range(levels + 1))
            parts.append(f"roots as ({roots})")
            parts.append("b0 as (select '' as tree, tree as lang_tree, digest, row_number() over (order by tree) - 1 as place, count(*) over () as n from roots)")
        for k in range(top):
            parts.append(f"{name}r{k} as (select tree, place // {fan} as run, n, list(digest order by place) as m from {name}{k} where n > 1 group by all)")
            parts.append(f"{name}{k + 1} as (select tree, run as place, (n + {fan - 1}) // {fan} as n, sha256(array_to_string(m, '')) as digest from {name}r{k})")
    parts.append("x0 as (select doc_id, leaf, tree, place, '' as proof, shown as f from a0)")
    step = lambda name, k, x, keep: f"""{x}{k + 1} as (select {keep}, {x}{k}.tree, place // {fan} as place,
      proof || coalesce(array_to_string(m[1 : place % {fan}], '') || array_to_string(m[place % {fan} + 2 :], ''), '') as proof,
      case when m is null then f else sha256(array_to_string(m[1 : place % {fan}], '') || f || array_to_string(m[place % {fan} + 2 :], '')) end as f
      from {x}{k} left join {name}r{k} r on r.tree = {x}{k}.tree and r.run = place // {fan})"""  # noqa: E731
    parts += [step("a", k, "x", "doc_id, leaf") for k in range(levels)]
    parts.append(f"y0 as (select doc_id, leaf, b0.digest as subroot, b0.tree, b0.place, proof, f from x{levels} join b0 on b0.lang_tree = x{levels}.tree)")
    parts += [step("b", k, "y", "doc_id, leaf, subroot") for k in range(upper)]
    root = " union all ".join(f"select digest from b{k} where n = 1" for k in range(upper + 1))
    return f"""with {", ".join(parts)}, root as ({root})
    select doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, f as folded_root, f = digest as verified from y{upper}, root"""
