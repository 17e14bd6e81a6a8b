"""Near duplicates by SimHash fingerprints and multi-index hashing with small Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, in_batches, text_or_empty, written
from .components import components

SEED = 42
#: Three segments: of at most 5 differing bits, some segment holds one at most.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MOST_DISTANCE = 5
#: Rows of one segment value beyond which the value is divided by further segments of the other bits.
HOT_ROWS = 20_000
#: Fingerprints compared at a time within one key.
BLOCK = 2048
#: Keys of at most so many rows are compared by whole columns, their links not reduced.
LITTLE = 16


def fingerprint(text: str, size: int = 4) -> int:
    """64-bit SimHash of the shingles of `size` words, repeats included; signed. A-Z are lowered, other letters are not."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= size:
        votes, n = _votes(np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype="<u8")), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        begins, ends = np.r_[0, ends[:-size]].tolist(), (ends[size - 1 :] - 1).tolist()
        digest, n, votes = xxhash.xxh64_intdigest, len(begins), 0
        for k in range(0, n, 1 << 16):
            hashes = [digest(whole[b:e], SEED) for b, e in zip(begins[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)]
            votes = votes + _votes(np.array(hashes, dtype="<u8"))
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): one narrow pass; a null text counts as empty (fingerprint 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, fp long")


def ball(fps: np.ndarray, shift: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one segment: (index of fp, segment value, visitor). Each fp is at home at its own value and visits those with one more bit.

    Two values one bit apart meet where the smaller visits the larger, so half of the ball is enough.
    """
    value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    flips = np.uint64(1) << np.arange(width, dtype=np.uint64)
    who, bit = np.nonzero((value[:, None] & flips) == 0)
    index = np.r_[np.arange(len(fps)), who]
    return index, np.r_[value, value[who] | flips[bit]], np.r_[np.zeros(len(fps), bool), np.ones(len(who), bool)]


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for number, (shift, width) in enumerate(SEGMENTS):
            index, value, visitor = ball(fps, shift, width)
            key = (value | np.uint64(number << 32)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[index].view(np.int64)), pa.array(visitor.astype(np.int8))], ["key", "fp", "visitor"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot keys once more by four parts of the bits outside their segment; bit 1 of visitor: visitor of the part."""
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        first = batch.column("visitor").to_numpy(zero_copy_only=False)
        for number in range(len(SEGMENTS)):
            mine = np.flatnonzero(keys >> 32 == number)
            if not len(mine):
                continue
            rest = [(s + h * (w // 2), w // 2 if h == 0 else w - w // 2) for k, (s, w) in enumerate(SEGMENTS) if k != number for h in (0, 1)]
            for part, (shift, width) in enumerate(rest):
                index, value, visitor = ball(fps[mine], shift, width)
                at = mine[index]
                key = keys[at] | (value.astype(np.int64) << 36) | (part + 1 << 48)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fps[at].view(np.int64)), pa.array((first[at] | visitor.astype(np.int8) << 1).astype(np.int8))],
                    ["key", "fp", "visitor"]
                )


def _forest(fps: np.ndarray, visitor: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of one key that join its near fingerprints: a forest, not all pairs.

    All pairs are compared, block by block, except visitors of the same level with each other.
    """
    label = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), BLOCK):
            near = np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, j : j + BLOCK]) <= distance
            near &= (visitor[i : i + BLOCK, None] & visitor[None, j : j + BLOCK]) == 0
            for a in (np.flatnonzero(near.any(axis=1)) + i).tolist():
                there = np.flatnonzero(near[a - i]) + j
                there = there[label[there] != label[a]]
                if len(there):
                    joined, first = np.unique(label[there], return_index=True)
                    links += [(int(fps[a].view(np.int64)), int(fps[b].view(np.int64))) for b in there[first]]
                    label[np.isin(label, joined)] = label[a]
    return links


def _linker(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch waits for the next batch."""
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8)]

        def links(key, fp, visitor):
            fp, out, far = fp.view(np.uint64), [], []
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
            ends = np.r_[begins[1:], len(key)]
            sizes = ends - begins
            # small groups: the k-th next row of the same key, for all keys at once
            little = np.repeat(sizes <= LITTLE, sizes)
            for k in range(1, min(LITTLE, max(sizes, default=1))):
                same = np.flatnonzero((key[k:] == key[:-k]) & little[k:])
                if not len(same):
                    break
                near = same[(np.bitwise_count(fp[same] ^ fp[same + k]) <= distance) & ((visitor[same] & visitor[same + k]) == 0) & (fp[same] != fp[same + k])]
                far += [(fp[near].view(np.int64), fp[near + k].view(np.int64))]
            for b, e in zip(begins[sizes > LITTLE].tolist(), ends[sizes > LITTLE].tolist(), strict=True):
                out += _forest(fp[b:e], visitor[b:e], distance)
            a = np.concatenate([x[0] for x in far] + [np.array([x[0] for x in out], np.int64)])
            b = np.concatenate([x[1] for x in far] + [np.array([x[1] for x in out], np.int64)])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "visitor")]
            rows = [np.concatenate(p) for p in zip(rest, new, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            rest = [c[cut:] for c in rows]
            yield from links(*[c[:cut] for c in rows])
        yield from links(*rest)

    return run


def near_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links of fingerprints at most `distance` bits apart that connect whatever such links connect.

    fps: one row for each different fingerprint (column fp). Multi-index hashing: every fingerprint enters a table for each
    segment and looks up the small Hamming ball around its own value; candidates are verified over all 64 bits. A value with more than HOT_ROWS rows is
    divided further by the same scheme over the remaining bits, which loses no pair. Pairs of a key are reduced to a forest.
    """
    if not 0 <= distance <= MOST_DISTANCE:
        raise ValueError(f"distance is 0 to {MOST_DISTANCE}")
    probes = written(fps.mapInArrow(given_back(_probes), "key long, fp long, visitor byte"), "probes")
    hot = written(probes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("key"), "hot")
    rows = probes
    if hot.head(1):
        # at most one hot key for each HOT_ROWS rows
        rows = probes.join(hot, "key", "left_anti").unionByName(probes.join(hot, "key", "left_semi").mapInArrow(given_back(_refined), "key long, fp long, visitor byte"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(given_back(_linker(distance)), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """Per document its fingerprint (16 hex digits) and the smallest doc_id reachable over links of at most `distance` bits.

    Equal fingerprints are one vertex, so copies are never expanded into pairs. Empty and null texts share fingerprint zero and are linked like others.
    Repeated rows stay; a null doc_id never is a representative unless its whole component has none (then component_id is null).
    """
    found = written(fingerprints(docs, size), "fingerprints")
    least = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    member = written(components(near_links(least.select("fp"), distance)), "members").withColumnRenamed("node", "fp")
    linked = least.join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    label = written(linked.select("fp", "root").join(first, "root").select("fp", "component_id"), "labels")
    return found.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
