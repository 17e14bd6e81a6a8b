"""Repeated passages by a depth-limited radix sort of suffixes, most significant digit first.

A suffix is ordered only through its first DEPTH bytes. Texts stay in compressed blocks; what moves is small:

1. Presence. Neighbouring suffixes whose DEPTH bytes have the same anchor (the MARK bytes in them with the smallest hash, which those bytes determine) form a
   stretch. A block sends the hashes of its different anchors and gets back which of them another document has too. A stretch whose anchor is in one
   document only holds no repeated window and goes no further; a false hit costs work, never a result.
2. Order. The bytes of the remaining stretches, each different one once, are dealt out by anchor, so equal suffixes meet. There their suffixes are sorted by
   passes over digits of DIGIT bytes of their own, the leading ones first; a pass goes on only with groups that still span two documents.
   Groups left after DEPTH bytes are exactly the repeated windows: bytes are compared, not hashes.

An anchor with very many stretches is not dealt out whole: each of its suffixes is dealt by all its bytes instead, so that copies count once for each block.

A block sends at most FAN packed rows a pass, however large the input. Where FAN ranges are not enough, relays in between do for the rows of some
blocks what a block does for its documents (drop what is repeated, send FAN rows on, hand the answers back), so the rows grow in proportion to the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, given_back, in_batches, text_or_empty
from .exchange import FAN, PACKED, Packed, answered, arrow_table, by_source, dealt, flags_of, levels_of, runs_of, steps, unstepped

DEPTH = 50
MARK = 20
DIGIT = 8
#: Suffixes that can share an anchor side by side, and the bytes of such a stretch, rounded up to whole digits.
WIDTH = DEPTH - MARK + 1
ROW = -(-(DEPTH + WIDTH - 1) // DIGIT) * DIGIT
#: Bytes of text in a block (a longer text is a block of its own), and suffixes hashed at a time.
BLOCK_BYTES = 4 << 20
SEGMENT = 1 << 17
#: Bytes of text for each range: one range is ordered in one task, so many suffixes of it at a time.
RANGE_BYTES = 8 << 20
SUFFIXES = 1 << 18
#: Bytes of text for each relay: where every stretch is repeated, its rows take six times as much.
RELAY_BYTES = 8 << 20
#: Stretches of an anchor from which its suffixes are dealt out one by one.
HOT = 20_000
NO_DOC = np.iinfo(np.int64).max
#: What is said about an anchor: one document has it, several have it, very many stretches have it.
ALONE, SHARED, CROWDED = 0, 1, 2
#: A note about an anchor: stretches up to MANY, and TWO if two documents have it.
MANY, TWO = 0x7FFF, 0x8000

_U = np.uint64
_ODD = np.random.default_rng(50).integers(0, 1 << 64, ROW // DIGIT + 4, dtype=np.uint64) | _U(1)
_POWER = np.cumprod(np.r_[_U(1), np.full(SEGMENT + 2 * DEPTH, _ODD[0])], dtype=_U)
_INVERSE = np.cumprod(np.r_[_U(1), np.full(SEGMENT + 2 * DEPTH, pow(int(_ODD[0]), -1, 1 << 64), dtype=_U)], dtype=_U)
_LOW = _U((1 << 18) - 1)
#: The bits of a hash that are sent.
_SENT = ~_U(0xFFFF)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _ODD[k]
    x ^= x >> _U(29)
    x *= _ODD[k + 1]
    x ^= x >> _U(32)
    return x


def _row_sums(words: np.ndarray) -> np.ndarray:
    """A hash of each row, column by column, without a product of the whole table."""
    sums = np.zeros(len(words), dtype=_U)
    for k in range(words.shape[1]):
        sums += words[:, k] * _ODD[k]
    return sums


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each suffix's anchor, and the hashes of all MARK-byte strings; data has at least DEPTH bytes."""
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data + _U(1)) * _POWER[: len(data)], out=sums[1:])
    marks = _mixed((sums[MARK:] - sums[:-MARK]) * _INVERSE[: len(data) - MARK + 1], 1)
    key, step = marks & ~_LOW | np.arange(len(marks), dtype=_U), 1
    while 2 * step <= WIDTH:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    n = len(data) - DEPTH + 1
    return (np.minimum(key[:n], key[WIDTH - step : WIDTH - step + n]) & _LOW).astype(np.int64), marks


class Block:
    """One block: documents in any order, their texts concatenated."""

    def __init__(self, doc: np.ndarray, sizes: np.ndarray, packed: bytes):
        self.doc, self.sizes = doc, sizes
        raw = zstandard.decompress(packed, max_output_size=max(1, int(sizes.sum()))) if len(packed) else b""
        self.padded = np.frombuffer(raw + bytes(ROW), dtype=np.uint8)
        self.data = self.padded[: len(raw)]
        self.ends = np.cumsum(sizes)

    def stretches(self) -> tuple[np.ndarray, ...]:
        """start, count, lead (from the start to the anchor), anchor hash and document of every stretch."""
        valid = np.ones(max(0, len(self.data) - DEPTH + 1), dtype=bool)
        for begin, end in zip((self.ends - self.sizes).tolist(), self.ends.tolist(), strict=True):
            valid[max(begin, end - DEPTH + 1) : end] = False
        parts = []
        for at in range(0, len(valid), SEGMENT):
            ok = valid[at : at + SEGMENT]
            place, marks = _anchors(self.data[at : at + len(ok) + DEPTH - 1])
            change = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])])
            count = np.diff(np.r_[change, len(ok)])
            keep = ok[change]
            start, count = change[keep], count[keep]
            there = place[start]
            # an anchor's hash is the smallest of many, so its leading bits are nearly all zero: mixed once more it deals evenly
            parts.append((start + at, count.astype(np.uint8), (there - start).astype(np.uint8), _mixed(marks[there], 12) & _SENT))
        if not parts:
            parts = [(np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, _U))]
        start, count, lead, mark = (np.concatenate(c) for c in zip(*parts, strict=True))
        return start, count, lead, mark, self.doc[np.searchsorted(self.ends, start, side="right")]


# Presence: tables of (anchor hash, stretches and whether two documents have it), sorted by the hash


class Presence:
    """Different anchors with a note: the number of stretches, up to MANY, and TWO if two documents have the anchor."""

    answer_type = np.uint8

    def __init__(self, mark: np.ndarray, note: np.ndarray):
        self.mark, self.note = mark, note

    @classmethod
    def of(cls, mark: np.ndarray, doc: np.ndarray) -> tuple[Presence, np.ndarray]:
        """The table of all stretches, and each stretch's row in it."""
        order = np.argsort(mark)
        begins, key = runs_of(mark[order], order)
        if not len(begins):
            return cls(mark, np.empty(0, np.uint16)), key
        d = doc[order]
        two = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
        n = np.minimum(np.diff(np.r_[begins, len(order)]), MANY)
        return cls(mark[order][begins], (n + two * TWO).astype(np.uint16)), key

    @classmethod
    def joined(cls, tables: Iterable[Presence]) -> tuple[Presence, Presence, np.ndarray]:
        """All rows of several tables, the table of the different ones, and each row's place in it."""
        marks, notes = zip(*((t.mark, t.note) for t in tables), strict=True)
        whole = cls(np.concatenate(marks), np.concatenate(notes))
        order = np.argsort(whole.mark)
        begins, place = runs_of(whole.mark[order], order)
        note = whole.note[order].astype(np.int64)
        n = np.minimum(np.add.reduceat(note & MANY, begins), MANY)
        two = (np.bitwise_or.reduceat(note, begins) >= TWO) | (np.diff(np.r_[begins, len(order)]) > 1)
        return whole, cls(whole.mark[order][begins], (n + two * TWO).astype(np.uint16)), place

    def settled(self) -> np.ndarray:
        """What is said about each anchor if there are no other tables."""
        return (np.where(self.note & MANY >= HOT, CROWDED, SHARED) * (self.note >= TWO)).astype(np.uint8)

    def told(self, table: Presence, place: np.ndarray, answer: np.ndarray) -> np.ndarray:
        """The answers to these rows from those to the different ones."""
        return answer[place]

    def part(self, b: int, e: int) -> bytes:
        return steps(self.mark[b:e]) + self.note[b:e].tobytes()

    @classmethod
    def read(cls, raw: bytes, n: int) -> Presence:
        return cls(unstepped(raw, n), np.frombuffer(raw, np.uint16, n, 8 * n))


class Contexts:
    """Different stretches, sorted by anchor: its hash, count and lead, the smallest document that has the stretch, and its bytes in a row of ROW."""

    answer_type = np.uint32

    def __init__(self, mark: np.ndarray, count: np.ndarray, lead: np.ndarray, doc: np.ndarray, text: np.ndarray):
        self.mark, self.count, self.lead, self.doc, self.text = mark, count, lead, doc, text

    def different(self) -> tuple[Contexts, np.ndarray]:
        """The table without rows that repeat count, lead and bytes of another, with the smallest document; and each row's place in it.

        Neighbours are found by a hash and compared by their bytes: a collision leaves a row too many, never one too few.
        """
        words = self.text.view(_U)
        key = _mixed(_row_sums(words) + (self.count.astype(_U) << _U(8) | self.lead) * _ODD[-3], 2)
        order = np.lexsort((self.doc, key, self.mark))
        mark, count, lead = self.mark[order], self.count[order], self.lead[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (mark[1:] != mark[:-1]) | (count[1:] != count[:-1]) | (lead[1:] != lead[:-1])
        same = np.flatnonzero(~new)
        for at in range(0, len(same), SEGMENT):  # a segment at a time: the rows are held once, not sorted copies of all
            some = same[at : at + SEGMENT]
            new[some] = (words[order[some]] != words[order[some - 1]]).any(axis=1)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        kept = order[new]
        return Contexts(mark[new], count[new], lead[new], self.doc[kept], words[kept].view(np.uint8)), place

    @classmethod
    def together(cls, tables: Iterable[Contexts], n: int) -> Contexts:
        """The n rows of several tables, which may be made as they are taken: one is held at a time, beside the whole."""
        whole, at = cls(np.empty(n, _U), np.empty(n, np.uint8), np.empty(n, np.uint8), np.empty(n, np.int64), np.empty((n, ROW), np.uint8)), 0
        for t in tables:
            for c in ("mark", "count", "lead", "doc", "text"):
                getattr(whole, c)[at : at + len(t.mark)] = getattr(t, c)
            at += len(t.mark)
        return whole

    @classmethod
    def joined(cls, tables: Packed | list[Contexts]) -> tuple[Contexts, Contexts, np.ndarray]:
        """All rows of several tables, without their bytes, the table of the different ones, and each row's place in it."""
        whole = cls.together(tables, tables.n_rows if isinstance(tables, Packed) else sum(len(t.mark) for t in tables))
        table, place = whole.different()
        whole.text = whole.text[:0].copy()  # told() needs none
        return whole, table, place

    def settled(self) -> np.ndarray:
        """For each of these different stretches a bit for each of its suffixes that a smaller document has among them.

        Anchors with rows of one document are skipped; the others are taken up to about SUFFIXES suffixes at a time.
        """
        out = np.zeros(len(self.mark), dtype=np.uint32)
        begins = np.flatnonzero(np.r_[True, self.mark[1:] != self.mark[:-1]])
        group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(out)]))
        several = np.minimum.reduceat(self.doc, begins) != np.maximum.reduceat(self.doc, begins)
        rows = np.flatnonzero(several[group])
        group, taken = group[rows], np.cumsum(self.count[rows].astype(np.int64))
        at = 0
        while at < len(rows):
            stop = int(np.searchsorted(taken, (taken[at - 1] if at else 0) + SUFFIXES, side="right"))
            stop = max(stop, at + 1)
            if stop < len(rows):  # whole anchors: back to the last border, or on to the next
                border = int(np.searchsorted(group, group[stop], side="left"))
                stop = border if border > at else int(np.searchsorted(group, group[stop], side="right"))
            _sort_suffixes(self, rows[at:stop], group[at:stop], out)
            at = stop
        return out

    def told(self, table: Contexts, place: np.ndarray, answer: np.ndarray) -> np.ndarray:
        """The answers to these rows from those to the different ones: all suffixes of a stretch that a smaller document has are repeated."""
        every = (_U(1) << self.count.astype(_U)) - _U(1)
        return np.where(self.doc > table.doc[place], every.astype(np.uint32), answer[place])

    def part(self, b: int, e: int) -> bytes:
        return b"".join([steps(self.mark[b:e]), *(a[b:e].tobytes() for a in (self.doc, self.count, self.lead, self.text))])

    @classmethod
    def read(cls, raw: bytes, n: int) -> Contexts:
        doc, count, lead = np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n), np.frombuffer(raw, np.uint8, n, 17 * n)
        return cls(unstepped(raw, n), count, lead, doc, np.frombuffer(raw, np.uint8, ROW * n, 18 * n).reshape(n, ROW))


def _sort_suffixes(table: Contexts, rows: np.ndarray, anchor: np.ndarray, out: np.ndarray) -> None:
    """Most-significant-digit passes over the suffixes of some rows."""
    count, lead, doc = table.count[rows].astype(np.int64), table.lead[rows].astype(np.int64), table.doc[rows]
    words = np.zeros((len(rows), ROW // DIGIT + 2), dtype=_U)
    words[:, : ROW // DIGIT] = table.text[rows].view(">u8")
    words = words.ravel()
    row = np.repeat(np.arange(len(rows), dtype=np.int32), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    # equal suffixes have their anchor at the same place: that splits the groups before the first digit
    key = (anchor - anchor[0])[row] * 64 + lead[row] - nth
    nth = nth.astype(np.uint8)
    for depth in range(0, DEPTH + DIGIT, DIGIT):
        order = np.argsort(key)
        key, row, nth = key[order], row[order], nth[order]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        d = doc[row]
        least, sizes = np.minimum.reduceat(d, begins), np.diff(np.r_[begins, len(key)])
        several = least != np.maximum.reduceat(d, begins)
        live = np.repeat(several, sizes)
        if not live.any():
            return
        row, nth = row[live], nth[live]
        if depth >= DEPTH:
            later = np.repeat(least[several], sizes[several]) < doc[row]
            bits = np.bincount(row[later], weights=np.exp2(nth[later].astype(np.float64)), minlength=len(rows))
            out[rows] = bits.astype(np.uint32)
            return
        place = nth.astype(np.int64) + depth
        word, shift = row.astype(np.int64) * (ROW // DIGIT + 2) + (place >> 3), ((place & 7) << 3).astype(_U)
        digit = words[word] << shift | words[word + 1] >> _U(1) >> (_U(63) - shift)
        if depth + DIGIT > DEPTH:
            digit >>= _U(8 * (depth + DIGIT - DEPTH))
        order = np.argsort(digit)
        _, rank = runs_of(digit[order], order)
        key = np.repeat(np.arange(int(several.sum())), sizes[several]) << 32 | rank


def contexts_of(block: Block, said: np.ndarray) -> tuple[Contexts, tuple[np.ndarray, ...]]:
    """Different stretches of a block still to be ordered, and (start, count, doc, row of that table) of all of them.

    said: the answer for each different anchor. The suffixes of crowded anchors are stretches of one, dealt by a hash of all their bytes.
    """
    start, count, lead, mark, doc = block.stretches()
    answer = said[Presence.of(mark, doc)[1]] if len(mark) else np.empty(0, np.uint8)
    cold, hot = np.flatnonzero(answer == SHARED), np.flatnonzero(answer == CROWDED)
    tables, owner, rows = [_rows_at(block, start[cold], count[cold], lead[cold], mark[cold], doc[cold])], [np.arange(len(cold))], len(cold)
    n = count[hot].astype(np.int64)
    each, one = np.repeat(start[hot] - np.cumsum(n) + n, n) + np.arange(int(n.sum())), np.repeat(doc[hot], n)
    for at in range(0, len(each), SEGMENT):
        some = each[at : at + SEGMENT]
        table = _rows_at(block, some, np.ones(len(some), np.uint8), np.zeros(len(some), np.uint8), np.zeros(len(some), _U), one[at : at + SEGMENT])
        table.mark = _mixed(_row_sums(table.text.view(_U)), 2) & _SENT
        table, place = table.different()
        tables.append(table)
        owner.append(place + rows)
        rows += len(table.mark)
    found, place = (tables[0] if len(tables) == 1 else Contexts.together(tables, rows)).different()
    return found, (np.r_[start[cold], each], np.r_[count[cold].astype(np.int64), np.ones(len(each), np.int64)], np.r_[doc[cold], one], place[np.concatenate(owner)])


def _rows_at(block: Block, start: np.ndarray, count: np.ndarray, lead: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> Contexts:
    text = np.zeros((len(start), ROW), dtype=np.uint8)
    for at in range(0, len(start), SEGMENT):  # a segment at a time: no second copy of all rows
        some = text[at : at + SEGMENT]
        some[:] = np.lib.stride_tricks.sliding_window_view(block.padded, ROW)[start[at : at + SEGMENT]]
        some[np.arange(ROW)[None, :] >= count[at : at + SEGMENT, None].astype(np.int64) + DEPTH - 1] = 0
    return Contexts(mark, count, lead, doc, text)


def _stream(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(parts).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _store(docs: DataFrame, block_bytes: int, carry: list[str], total: int) -> DataFrame:
    """(block, docs, sizes, packed, extra): texts in compressed blocks, written bucketed by block so that later joins move flags only.

    extra: the columns to carry of the block's rows, as an Arrow stream.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, texts, size, extra = [], [], 0, []

        def row() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            data = [
                [block], [np.array(ids, np.int64).tobytes()], [sizes.tobytes()], [int(sizes.sum())], [zstandard.compress(b"".join(texts), 1)],
                [_stream(extra) if carry else None]
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(data, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                ["block", "docs", "sizes", "n_bytes", "packed", "extra"]
            )

        for batch in batches:
            for at, (doc, text) in enumerate(zip(batch.column("~doc"), batch.column("~text"), strict=True)):
                raw = text.as_buffer().to_pybytes()
                if ids and size + len(raw) > block_bytes:
                    yield row()
                    block += 1
                    ids, texts, size, extra = [], [], 0, []
                if carry:
                    extra.append(batch.slice(at, 1).select(carry))
                ids.append(NO_DOC if doc.as_py() is None else doc.as_py())
                texts.append(raw)
                size += len(raw)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("~doc"), text_or_empty().alias("~text"), *carry)
    rows = in_batches(rows).mapInArrow(given_back(run), "block long, docs binary, sizes binary, n_bytes long, packed binary, extra binary")
    return bucketed(rows, "block", "blocks", total)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for block, doc, sizes, packed in zip(*(batch.column(c) for c in ("block", "docs", "sizes", "packed")), strict=True):
        yield block.as_py(), Block(np.frombuffer(doc.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int64), packed.as_buffer().to_pybytes())


def _decided(docs: DataFrame, output, schema, block_bytes: int, range_bytes: int, carry: list[str] = (), fan: int = FAN, relay_bytes: int = RELAY_BYTES) -> DataFrame:
    """Both exchanges; output(block, bytes removed as a mask, carried columns) gives the rows of a block."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    store = _store(docs, block_bytes, list(carry), total)
    levels = levels_of(total, range_bytes, fan)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, block in _blocks(batch):
                _, _, _, mark, doc = block.stretches()
                yield from arrow_table(dealt(Presence.of(mark, doc)[0], ident, 0, 0, levels[0]), PACKED).to_batches()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ident, block), said in zip(_blocks(batch), batch.column("said"), strict=True):
                yield from arrow_table(dealt(contexts_of(block, flags_of(said.as_py(), Presence))[0], ident, 0, 0, levels[0]), PACKED).to_batches()

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, block), said, more, extra in zip(_blocks(batch), batch.column("said"), batch.column("repeated"), batch.column("extra"), strict=True):
                yield from output(block, _removed(block, flags_of(said.as_py(), Presence), flags_of(more.as_py(), Contexts)), extra)

    said = by_source(answered(in_batches(store).mapInArrow(given_back(presence), PACKED), Presence, levels, total, relay_bytes), "said")
    joined = store.join(said, F.col("block") == F.col("of_said"), "left")
    repeated = by_source(answered(in_batches(joined).mapInArrow(given_back(contexts), PACKED), Contexts, levels, total, relay_bytes), "repeated")
    return joined.join(repeated, F.col("block") == F.col("of_repeated"), "left").mapInArrow(given_back(masks), schema)


def _removed(block: Block, said: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which bytes of a block lie in a repeated window."""
    table, (start, count, doc, row) = contexts_of(block, said)
    if not len(row):
        return np.zeros(len(block.data), dtype=bool)
    least = table.doc
    del table  # and its bytes
    every = (np.int64(1) << count) - 1
    bits = np.where(doc > least[row], every, repeated[row])
    whole = bits == every
    some = np.flatnonzero((bits != 0) & ~whole)
    which, nth = np.nonzero(np.unpackbits(bits[some].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))
    depth = np.zeros(len(block.data) + 1, np.int32)
    begin = np.r_[start[whole], start[some][which] + nth]
    np.add.at(depth, begin, 1)
    np.add.at(depth, np.r_[start[whole] + count[whole] - 1, start[some][which] + nth] + DEPTH, -1)
    return np.cumsum(depth[:-1], dtype=np.int32) > 0


def _each(block: Block, gone: np.ndarray) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """(doc_id, bytes, mask) of each document."""
    for doc, end, size in zip(block.doc.tolist(), block.ends.tolist(), block.sizes.tolist(), strict=True):
        yield None if doc == NO_DOC else doc, block.data[end - size : end], gone[end - size : end]


def repeated_passages(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN, relay_bytes: int = RELAY_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of the bytes that remain.

    docs: doc_id, text; other columns are ignored. A byte goes if a string of DEPTH bytes over it also starts in a document with a smaller doc_id; all is judged on the
    input. A null text counts as empty; texts shorter than DEPTH stay; rows with the same doc_id don't remove each other; a row with a null doc_id loses what any
    other document has and removes nothing.
    """

    def output(block: Block, gone: np.ndarray, _) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, data, mask in _each(block, gone):
            n = int(mask.sum())
            spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
            rows.append((doc, len(data), n, spans, hashlib.sha256(data[~mask] if n else data).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )

    return _decided(docs, output, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block_bytes, range_bytes, (), fan, relay_bytes)


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with what remains of each text; every row and all other columns stay, without a shuffle of texts.

    Bytes of characters that were cut through are dropped. A null text becomes empty; a column n_chars, if there is one, counts the new text.
    """
    schema, names = docs.schema, docs.columns

    def output(block: Block, gone: np.ndarray, extra: pa.Scalar) -> Iterator[pa.RecordBatch]:
        texts = pa.array([data[~mask].tobytes().decode("utf-8", "ignore") for _, data, mask in _each(block, gone)], pa.string())
        rest = pa.ipc.open_stream(extra.as_buffer()).read_all() if extra.is_valid else None
        columns = {n: texts if n == "text" else rest.column(n) for n in names}
        if "n_chars" in columns:
            columns["n_chars"] = pa.compute.utf8_length(texts).cast(columns["n_chars"].type)
        yield from pa.table(columns).combine_chunks().to_batches()

    return _decided(docs, output, schema, block_bytes, range_bytes, [c for c in names if c != "text"])
