"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, text_or_empty, written
from .shingles import hashed, shingles, words

SIZE = 5
CONTAINMENT = 0.8


def sketches(items: DataFrame, size: int, containment: float) -> DataFrame:
    """(size_class, h): for each class of items by size, the smallest hashes of each item's shingles, as many as the class needs.

    A text that holds at least c = ceil(containment * n) of an item's n shingles misses n - c at most, so it holds one of any n - c + 1. Items are put into
    classes of n by powers of two; a class takes the number that its largest possible n needs, so no item above the threshold can be missed,
    however long the text is.
    """
    kept = items.select("size_class", F.array_sort(F.array_distinct("hash")).alias("hash")).where(F.size("hash") > 0)
    top = F.pow(F.lit(2.0), F.col("size_class").cast("double"))
    need = (top - F.ceil(F.lit(containment) * top - F.lit(1e-9)) + 1).cast("int")
    return kept.select("size_class", F.explode(F.slice("hash", F.lit(1), need)).alias("h")).distinct()


def _runs(items: Column, n: int, kind: str, make) -> Column:
    """make(i, n) for each i (from 1) at which n items begin; nothing where there are fewer."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: make(i, n))).otherwise(F.array().cast(f"array<{kind}>"))


def of_text(word: Column, size: int, short: list[int]) -> Column:
    """The shingles that a text can share with items: those of `size` words, and those of the lengths `short` that shorter items have."""
    return F.concat(*[_runs(word, n, "string", lambda i, n: F.array_join(F.slice(word, i, n), " ")) for n in (size, *short)])


def hashes_of_text(word_hash: Column, size: int, short: list[int]) -> Column:
    """The hashes of of_text(), from those of the words."""
    one = lambda i, n: F.xxhash64(*[F.get(word_hash, i - 1 + k) for k in range(n)])
    return F.concat(*[_runs(word_hash, n, "bigint", one) for n in (size, *short)])


def size_class(n: Column) -> Column:
    """The least k with n at most 2**k."""
    return F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs (doc_id, item_id) where the document has at least `containment` of the item's different shingles.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are runs without white space in lower case. An item of fewer than `size` words is one
    shingle, which a text has where these words follow each other in it: texts are taken apart at the lengths that such items have, too. Empty and null texts have no shingles and are in no
    pair. Rows that repeat an id count as one text with the shingles of all. Also returned: n_shared, n_item (long) and containment (double).

    Items are partitioned by size: each class has its own sketches, and a document is a candidate for the classes whose sketches it meets, only with whose items it is
    compared. Documents are read twice and not shuffled: once to probe hashes with the sketches, once, the candidates only, to verify with the
    shingles themselves. Items are broadcast while small; beyond that the probes are shuffled by hash.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.lower(text_or_empty())).alias("w")).where("item_id is not null")
    short = sorted(r[0] for r in items.select(F.size("w")).distinct().where(F.size("w").between(1, size - 1)).collect())  # size - 1 at most
    items = items.select(
        "item_id", shingles(F.col("w"), size).alias("s"), F.transform("w", lambda w: F.xxhash64(w)).alias("wh")
    ).select("item_id", "s", hashed(F.col("wh"), size).alias("hash"))
    full = items.select("item_id", F.explode("s").alias("s")).distinct()
    sizes = full.groupBy("item_id").agg(F.count("*").alias("n_item")).withColumn("size_class", size_class(F.col("n_item")))
    sketch = small(written(sketches(items.join(sizes, "item_id"), size, containment), "sketch"))
    full = small(written(full.join(sizes, "item_id"), "shingles"))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_or_empty()).alias("text")).where("doc_id is not null")
    probes = texts.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.transform("w", lambda w: F.xxhash64(w)).alias("wh"))
    probes = probes.select("doc_id", F.explode(hashes_of_text(F.col("wh"), size, short)).alias("h"))
    found = written(probes.join(sketch, "h").groupBy("doc_id").agg(F.collect_set("size_class").alias("classes")), "candidates")  # some thirty classes at most
    found = small(found.select("doc_id", "classes"))

    shared = texts.join(found, "doc_id").select("doc_id", "classes", words(F.col("text")).alias("w"))
    shared = shared.select(
        "doc_id", "classes", F.explode(F.array_distinct(of_text(F.col("w"), size, short))).alias("s")
    ).join(full, "s").where(F.array_contains("classes", F.col("size_class")))
    shared = shared.select("doc_id", "item_id", "n_item", "s").distinct()
    counted = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    enough = F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("n_item") - F.lit(1e-9))
    return counted.where(enough).select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, containment: float = CONTAINMENT) -> DataFrame:
    """docs without those in a pair of leaks(); all columns stay, rows with a null doc_id stay."""
    bad = small(written(leaks(docs, benchmark, size, containment).select("doc_id").distinct(), "leaks"))
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def oracle(size: int = SIZE, containment: float = CONTAINMENT) -> str:
    words = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')"
    windows = lambda n: f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n} - 1], ' '))"
    return f"""
    with bw as (select item_id, {words} as w from benchmark), dw as (select doc_id, {words} as w from documents),
    short as (select coalesce(list(distinct len(w)), []) as lengths from bw where len(w) between 1 and {size - 1}),
    b as (select distinct item_id, unnest(case when len(w) >= {size} then {windows(size)} when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from bw),
    d as (select distinct doc_id, unnest(list_concat({windows(size)}, flatten(list_transform(lengths, lambda n: {windows("n")})))) as s from dw, short),
    n as (select item_id, count(*) as n_item from b group by 1)
    select doc_id, item_id, count(*) as n_shared, n_item, count(*)::double / n_item as containment
    from d join b using (s) join n using (item_id) group by doc_id, item_id, n_item
    having count(*) >= ceil({containment} * n_item - 1e-9)"""
