"""Near duplicates by Jaccard similarity: candidates from SimHash and from banded MinHash, links verified by whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from . import simhash
from .common import given_back, in_batches, small, text_or_empty, written
from .components import components

SEED = 42
SIZE = 5
#: Similarity from which two texts are near copies, as a fraction.
SIMILAR = (4, 5)
#: Bits in which linked SimHash fingerprints differ at most.
DISTANCE = 4
#: A pair of similarity s shares a band with probability 1 - (1 - s**6)**40: 0.999995 at 0.8, and more above.
BANDS, ROWS = 40, 6
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, size=(3, BANDS * ROWS), dtype=np.uint64)
FACTORS, TERMS, MIXERS = _DRAWN[0] | np.uint64(1), _DRAWN[1], _DRAWN[2] | np.uint64(1)
#: Sets smaller than this are similar to equal sets only.
LEAST = SIMILAR[0]
#: Rounds in which the members of a band's bucket are compared with one of them.
STARS = 2
#: Bytes of the sets of a bucket up to which the rest of its pairs are compared within one task; larger ones are divided by further bands.
GROUP_BYTES = 32 << 20
#: How often a bucket is divided, and by how many bands of how many rows; what is still too large then is compared part by part.
LEVELS, SUB_BANDS, SUB_ROWS = 2, 40, 8
#: Hashes permuted at a time.
CHUNK = 512


def shingle_set(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of `size` lower-cased words; of fewer words the whole sequence, of none nothing."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(whole, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins, ends = np.r_[0, ends[:-size]].tolist(), (ends[size - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(whole[b:e], SEED) for b, e in zip(begins, ends, strict=True)), dtype=np.uint64, count=len(begins)))


def name_of(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def _minima(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[k : k + CHUNK, None] * factors + terms).min(axis=0), out=least)
    return least


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS minima."""
    if len(hashes) < LEAST:
        return np.empty(0, np.int64)
    return (_minima(hashes, FACTORS, TERMS) * MIXERS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def sub_bands(hashes: np.ndarray, level: int) -> np.ndarray:
    """Keys of the bands that divide a bucket at a level; each level draws permutations of its own."""
    drawn = np.random.default_rng([SEED, level]).integers(0, 1 << 64, size=(3, SUB_BANDS * SUB_ROWS), dtype=np.uint64)
    return (_minima(hashes, drawn[0] | np.uint64(1), drawn[1]) * (drawn[2] | np.uint64(1))).reshape(SUB_BANDS, SUB_ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a digest of the text as it is (column digest)."""
    return docs.withColumn("digest", F.xxhash64(text_or_empty()))


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, digest, fp, bands, print): one narrow pass; fp names the set of shingles, so copies are equal; print is the SimHash fingerprint. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, prints = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, size)
                prints.append(simhash.fingerprint(text))
                fps.append(name_of(hashes))
                keys.append(bands(hashes))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fps, pa.int64()), lists, pa.array(prints, pa.int64())], ["doc_id", "digest", "fp", "bands", "print"])

    rows = _keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "digest", text_or_empty().alias("text"))
    return in_batches(rows).mapInArrow(given_back(run), "doc_id long, digest long, fp long, bands array<long>, print long")


def similar(common, sizes_a, sizes_b):
    """common / union >= 4 / 5"""
    return common * sum(SIMILAR) >= SIMILAR[0] * (sizes_a + sizes_b)


def forest(names: np.ndarray, sets: list[np.ndarray], label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (larger name, smaller name) of similar sets that connect what similar pairs connect. label: sets with an equal one are connected already.

    By rising size, each set is compared with those that are at most a quarter larger, of other labels.
    """
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    order = np.argsort([len(s) for s in sets], kind="stable")
    names, label, sets = np.asarray(names)[order], label[order], [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    begins = np.r_[0, np.cumsum(sizes)]
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(values), bool)
    ends = np.searchsorted(sizes, sizes * SIMILAR[1] // SIMILAR[0], side="right")
    links: list[tuple[int, int]] = []
    for a in range(len(sets) - 1):
        end = int(ends[a])
        if end <= a + 1 or (label[a + 1 : end] == label[a]).all():
            continue
        own = flat[begins[a] : begins[a + 1]]
        mine[own] = True
        common = np.add.reduceat(mine[flat[begins[a + 1] : begins[end]]], begins[a + 1 : end] - begins[a + 1], dtype=np.int64)
        mine[own] = False
        there = np.flatnonzero(similar(common, sizes[a], sizes[a + 1 : end])) + a + 1
        there = there[label[there] != label[a]]
        if len(there):
            joined, first = np.unique(label[there], return_index=True)
            links += [(max(x, y), min(x, y)) for x, y in ((int(names[a]), int(names[b])) for b in there[first])]
            label[np.isin(label, joined)] = label[a]
    return links


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column.to_pylist()]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, label, hashes) come sorted by key; the last group of a batch waits for the next batch."""
    rows, sets = np.empty((3, 0), np.int64), []

    def links(until: int) -> Iterator[pa.RecordBatch]:
        keys = rows[0]
        cuts = np.r_[0, np.flatnonzero(keys[1:until] != keys[: until - 1]) + 1, until] if until else np.zeros(1, int)
        found = [x for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for x in forest(rows[1, b:e], sets[b:e], rows[2, b:e])]
        if found:
            yield _links(found)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.c_[rows, np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "label")])]
        sets += _unpacked(batch.column("hashes"))
        cut = int(np.searchsorted(rows[0], rows[0, -1], side="left"))
        yield from links(cut)
        rows, sets = rows[:, cut:], sets[cut:]
    yield from links(rows.shape[1])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, with their sets) that are similar."""
    for batch in batches:
        left, right = _unpacked(batch.column("x")), _unpacked(batch.column("y"))
        fine = [k for k, (x, y) in enumerate(zip(left, right, strict=True)) if similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))]
        yield batch.select(["a", "b"]).take(pa.array(fine, pa.int64()))


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Those pairs (a, b) whose sets are similar. Pairs of too different sizes go before any set is moved; a set that many are compared with is a join key that Spark splits."""
    sizes = small(sets.select("fp", F.col("n").cast("long").alias("n")))
    near = pairs.join(sizes.withColumnsRenamed({"fp": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"fp": "b", "n": "nb"}), "b")
    near = near.where(F.greatest("na", "nb") * SIMILAR[0] <= F.least("na", "nb") * SIMILAR[1]).select("a", "b")
    both = near.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b")
    return written(in_batches(both.select("a", "b", "x", "y")).mapInArrow(given_back(_compared), "a long, b long"), name)


def _open(members: DataFrame, links: DataFrame, tested: list[str]) -> DataFrame:
    """members (key, fp, and columns of fps they were compared with) with label, their component, in buckets where some two members of different components were not compared."""
    label = components(links).toDF("node", "label")
    rows = members.join(label, members["fp"] == label["node"], "left").select(*members.columns, F.coalesce("label", "fp").alias("label"))
    rows = written(rows, "labelled")
    left = F.lit(True)
    for c in tested:
        left = left & (F.col("fp") != F.col(c))
    kinds = rows.where(left).groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
    # a member that all others were compared with is done with
    return written(rows.where(left).join(small(written(kinds, "open_keys")), "key", "left_semi"), "open")


def _distinct_buckets(members: DataFrame) -> DataFrame:
    """Buckets with the same members are one."""
    same = members.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("fp", F.lit(1)).cast("decimal(38,0)")).alias("t"))
    kept = same.groupBy("k", "s", "t").agg(F.min("key").alias("key")).select("key")
    return members.join(small(written(kept, "kept_keys")), "key", "left_semi")


def _all_pairs(members: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Links among the members of each bucket, a bucket in one task."""
    rows = members.select("key", "fp", "label").join(sets.select("fp", "hashes"), "fp").select("key", "fp", "label", "hashes")
    return written(in_batches(rows.repartition("key").sortWithinPartitions("key")).mapInArrow(given_back(_within), "a long, b long"), name)


def _by_parts(members: DataFrame, sets: DataFrame, group_bytes: int) -> DataFrame:
    """As _all_pairs() for buckets of any size: a bucket is cut into parts of half the bytes of a task, and each two parts meet in a task of their own."""
    sized = members.select("key", "fp", "label").join(sets.select("fp", (8 * F.col("n")).alias("bytes")), "fp")
    placed = ordered.placed(sized, ["fp"], ["key"], F.col("bytes")).withColumn("part", F.floor((F.col("running") - F.col("bytes")) * 2 / group_bytes))
    placed = written(placed.select("key", "fp", "label", "part"), "parts")
    most = placed.groupBy(F.col("key").alias("k")).agg(F.max("part").alias("most"))
    each = placed.join(small(most), F.col("key") == F.col("k")).select("key", "fp", "label", "part", F.explode(F.sequence(F.lit(0), "most")).alias("other"))
    pair = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    return _all_pairs(each.select(pair.alias("key"), "fp", "label"), sets, "links_by_parts")


def _divided(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """(key, fp): the members of each bucket dealt anew by SUB_BANDS bands of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sub_bands(s, level) for s in _unpacked(batch.column("hashes"))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * SUB_BANDS), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), lists], ["fp", "bands"])

    once = sets.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", "hashes")
    more = written(in_batches(once).mapInArrow(given_back(run), "fp long, bands array<long>"), "sub_bands")
    rows = members.select("fp", F.col("key").alias("of")).join(more, "fp").select("fp", "of", F.posexplode("bands").alias("n", "band"))
    return rows.select(F.xxhash64("of", "n", "band").alias("key"), "fp")


def links_of(buckets: DataFrame, sets: DataFrame, group_bytes: int = GROUP_BYTES, levels: int = LEVELS) -> DataFrame:
    """(a, b): similar pairs that connect whatever similar pairs connect within the buckets (key, fp). A fixed number of jobs, whatever the buckets hold.

    Every link is verified by whole sets before it joins anything, so unrelated texts that share a bucket by chance never make one group. First all members of a bucket are compared with its
    least one, then with its greatest: a group of near copies is joined by that. What is left are buckets with members of different components that were not compared;
    those up to group_bytes are compared in one task each, skipping pairs that are connected already. Larger ones are divided by further bands and treated alike; and
    what is too large after the last level is compared part by part, every part with every part.
    """
    spark = sets.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    for level in range(levels + 1):
        members = written(buckets.select("key", "fp").distinct(), "members")
        tested: list[str] = []
        for star in range(STARS):
            pick = F.min("fp") if star % 2 == 0 else F.max("fp")
            lead = members.groupBy("key").agg(pick.alias(f"lead{star}"), F.count("*").alias("k")).where("k > 1").drop("k")
            members = written(members.join(small(written(lead, "leads")), "key"), "members")
            tested.append(f"lead{star}")
            x, y = F.col("fp"), F.col(f"lead{star}")
            pairs = members.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
            links = links.unionByName(_verified(pairs, sets, "links"))
            members = _open(members, links, tested).drop("label") if star + 1 < STARS else _open(members, links, tested)
        members = written(_distinct_buckets(members), "open")
        bytes_of = members.join(small(sets.select("fp", "n")), "fp").groupBy("key").agg(F.sum(8 * F.col("n")).alias("bytes"))
        large = small(written(bytes_of.where(F.col("bytes") > group_bytes).select("key"), "large"))
        links = links.unionByName(_all_pairs(members.join(large, "key", "left_anti"), sets, "links"))
        rest = members.join(large, "key", "left_semi")
        if not rest.head(1):
            return links
        rest = _open(rest.select("key", "fp"), links, [])
        if level == levels:
            return links.unionByName(_by_parts(rest, sets, group_bytes))
        buckets = _divided(rest, sets, level + 1)
    return links


def simhash_buckets(sketched: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, key): sets by the component of their SimHash fingerprint over links of at most `distance` bits, as operator 5 finds them."""
    pairs = written(sketched.select("fp", "print").distinct(), "prints")
    member = components(simhash.near_links(pairs.select(F.col("print").alias("fp")).distinct(), distance)).withColumnRenamed("node", "print")
    return pairs.join(member, "print", "left").select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("root", "print")).alias("key"))


def similar_links(docs: DataFrame, sketched: DataFrame, size: int = SIZE, group_bytes: int = GROUP_BYTES, levels: int = LEVELS) -> DataFrame:
    """(a, b): links of sets with a Jaccard similarity of 4/5 and more that connect whatever such links connect among sets that share a SimHash component or a band."""
    probes = sketched.select("fp", F.explode("bands").alias("key")).unionByName(written(simhash_buckets(sketched), "simhash"))
    shared = probes.groupBy("key").agg(F.min("fp").alias("l"), F.max("fp").alias("m")).where("l <> m").select("key")
    buckets = written(probes.join(small(written(shared, "bands")), "key").select("key", "fp").distinct(), "buckets")
    # one row stands for all copies of a set
    one = sketched.groupBy("fp").agg(F.min(F.struct("digest", "doc_id")).alias("o")).select("fp", F.col("o.digest").alias("digest"), F.col("o.doc_id").alias("at"))
    wanted = written(buckets.select("fp").distinct().join(one, "fp"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            made = {fp: shingle_set(text, size) for fp, text in zip(batch.column("fp").to_pylist(), batch.column("text").to_pylist(), strict=True) if fp not in seen}
            seen.update(made)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64()), pa.array(map(len, made.values()), pa.int32()), pa.array([h.tobytes() for h in made.values()], pa.binary())], ["fp", "n", "hashes"])

    wanted = small(wanted)
    texts = _keyed(docs).select("digest", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = texts.join(wanted, (texts["digest"] == wanted["digest"]) & F.col("doc_id").eqNullSafe(F.col("at"))).select("fp", "text")
    sets = written(in_batches(texts).mapInArrow(given_back(run), "fp long, n int, hashes binary").dropDuplicates(["fp"]), "sets")  # rows that are repeated
    return links_of(buckets, sets, group_bytes, levels)


def near_copies(docs: DataFrame, size: int = SIZE, group_bytes: int = GROUP_BYTES, levels: int = LEVELS) -> DataFrame:
    """Per document the digest of its text and its component: texts of which each two neighbours have a Jaccard similarity of 0.8 and more.

    component_id is the smallest doc_id of the component and component_digest the text's digest beside it. Texts without words are copies of each other.
    A null doc_id never is a representative unless its whole component has none (then component_id is null).
    """
    sketched = written(sketches(docs, size), "sketches")
    member = written(components(similar_links(docs, sketched, size, group_bytes, levels)), "members").withColumnRenamed("node", "fp")
    least = sketched.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("least"))
    found = sketched.select("fp").distinct().join(least, "fp", "left").join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = written(found, "distinct")
    first = found.groupBy("root").agg(F.min("least").alias("first"))
    label = written(found.join(first, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("component_digest")), "labels")
    return sketched.join(label, "fp").select("doc_id", "digest", "component_id", "component_digest")


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs that represent their component: one for each group; all columns stay.

    Rows are told apart by doc_id and text, so texts of different groups stay even where they share a doc_id. Rows whose doc_id is null are kept, as no
    group can name them; of rows that repeat a doc_id with its text one is kept.
    """
    found = written(near_copies(docs, size).where("doc_id is not null"), "groups")
    gone = found.where("doc_id <> component_id or digest <> component_digest").select("doc_id", "digest").distinct()
    gone = small(written(gone, "gone"))
    kept = _keyed(docs).join(gone, ["doc_id", "digest"], "left_anti")
    if found.groupBy("doc_id", "digest").count().where("count > 1").head(1):
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "digest"]).unionByName(kept.where("doc_id is null"))
    return kept.select(docs.columns)
