"""Packing of token sequences into windows by minimum bin slack."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import default_vocabulary, word_tokenizer
from .common import given_back, in_batches, slices, text_or_empty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NO_DOC = np.iinfo(np.int64).min
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, times), with the largest sum up to capacity.

    counts: length -> pieces left. Subset sums are bits of an integer; lengths enter from the longest to the shortest, each at most as
    often as there are pieces, until the bit of the capacity itself is set. Backtracking takes each length as seldom as
    possible. The longest length that fits is preferred only by that order.
    """
    mask, reach, trail = (1 << capacity + 1) - 1, 1, []
    for size in sorted((s for s in counts if s <= capacity and counts[s]), reverse=True):
        trail.append((size, reach))
        left, block = min(counts[size], capacity // size), 1
        while left:  # 1, 2, 4, ... copies at a time reach every number of copies
            block = min(block, left)
            reach |= reach << size * block & mask
            left -= block
            block *= 2
        if reach >> capacity & 1:
            break
    target, out = reach.bit_length() - 1, []
    for size, before in reversed(trail):
        times = 0
        while not before >> target & 1:
            target, times = target - size, times + 1
        if times:
            out.append((size, times))
    return out


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> Iterator[list[int]]:
    """Indices of lengths window by window. Every window starts with the longest piece left and gets the best filling of the rest.

    A pattern found is used again while all its lengths last, so the work follows the number of different patterns.
    """
    order = np.argsort(lengths, kind="stable")
    sizes, begins = np.unique(lengths[order], return_index=True)
    stacks = {int(s): part.tolist() for s, part in zip(sizes, np.split(order, begins[1:]), strict=True)} if len(order) else {}
    counts = {s: len(x) for s, x in stacks.items()}
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            need = {longest: 1}
            for size, times in fill(counts, capacity - longest) if longest < capacity else []:
                need[size] = need.get(size, 0) + times
            counts[longest] += 1
            for _ in range(min(counts[s] // k for s, k in need.items())):
                yield [stacks[s].pop() for s, k in need.items() for _ in range(k)]
                for s, k in need.items():
                    counts[s] -= k


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Pieces of documents, each placed in a sequence of at most `capacity` tokens.

    A document's ids are those of its text (null: none) and end_id. It is cut at multiples of capacity; full pieces are sequences of
    their own, the remainders of a partition are packed together by minimum bin slack. There is no shuffle: a partition
    keeps some 100 bytes for each remainder, never ids, and leaves at most a few windows open. A sequence id is the
    partition's number in the upper bits and a count in the lower 32, so it is unique and the same when a task is run again.
    Extra columns are ignored; repeated rows are packed as often as they come; a null doc_id stays null.
    """
    path = vocabulary or default_vocabulary()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, tail = word_tokenizer(path), end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 32
        left = array("q")  # five numbers for each remainder
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    piece = (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)
                    if length == capacity:
                        rows.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        left.extend((NO_DOC if doc is None else doc, *piece[1:]))
            yield from batch_of(rows)
        words.forget()
        rows, pieces = [], np.frombuffer(left, np.int64).reshape(-1, 5)
        for window in minimum_bin_slack(pieces[:, 2], capacity):
            offset = 0
            for doc, *piece in pieces[window].tolist():
                rows.append((None if doc == NO_DOC else doc, *piece, sequence, offset))
                offset += piece[1]
            sequence += 1
            if len(rows) >= 10_000:
                yield from batch_of(rows)
                rows = []
        yield from batch_of(rows)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_batches(rows).mapInArrow(given_back(place), PIECES)


def batch_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)
