"""An exchange between blocks of data by ranges of a hash, in packed rows whose number grows in proportion to the input.

A block sends at most FAN rows a pass. Where FAN ranges are not enough, relays in between do for the rows of some blocks what a block does for its own: drop what is repeated, send FAN rows
on, hand the answers back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

#: Ranges to which a block or a relay sends, and the data for each relay, where there are relays.
FAN = 256
RELAY_BYTES = 64 << 20
#: The source of a range's summary: no block has this number.
NOBODY = -1

_U = np.uint64


def steps(mark: np.ndarray) -> bytes:
    return np.diff(mark, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unstepped(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T.copy().view(_U).ravel(), dtype=_U)


def runs_of(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal sorted values begin, and for each unsorted row the number of its run."""
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.empty(0, bool)
    key = np.empty(len(order), dtype=np.int64)
    key[order] = np.cumsum(new) - 1
    return np.flatnonzero(new), key


PACKED = "part long, source long, n long, packed binary"
ANSWER = "part long, source long, flags binary"


def arrow_table(found: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = [pa.int64() if k == "long" else pa.binary() for k in kinds]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[] for _ in names], kinds, strict=True)], list(names))


def dealt(table, source: int, above: int, skip: int, bits: int) -> list[tuple]:
    """A packed row for each range that has some: the `bits` of the hash after the leading `skip`; above: the number those stand for."""
    if not len(table.mark):
        return []
    part = (table.mark << _U(skip) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(table.mark), np.int64)
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
    return [((above << bits) + int(part[b]), source, e - b, zstandard.compress(table.part(b, e), 1)) for b, e in zip(begins, [*begins[1:], len(part)], strict=True)]


class Packed:
    """The tables of packed rows, in the order of the sources, each read as it is taken; heads: (part, source, n) of each, n_rows: the rows of all."""

    def __init__(self, kind: type, rows: pa.Table):
        found = sorted(zip(*(rows.column(c).to_pylist() for c in ("part", "source", "n")), range(rows.num_rows), strict=True), key=lambda x: (x[1], x[0]))
        self.kind, self.packed, self.order = kind, rows.column("packed"), [f[3] for f in found]
        self.heads = [f[:3] for f in found]
        self.n_rows = sum(n for _, _, n in self.heads)

    def __iter__(self) -> Iterator:
        for (_, _, n), at in zip(self.heads, self.order, strict=True):
            yield self.kind.read(zstandard.decompress(self.packed[at].as_buffer()), n)


def _split(heads: list[tuple[int, int, int]], answer: np.ndarray) -> pa.Table:
    ends = np.cumsum([n for _, _, n in heads]).tolist()
    return arrow_table([(part, source, zstandard.compress(answer[e - n : e].tobytes(), 1)) for (part, source, n), e in zip(heads, ends, strict=True)], ANSWER)


def _range(kind: type, settings: tuple) -> Callable[[pa.Table], pa.Table]:
    """One range: the answers to all sources, and its summary for the driver, if the kind has one, as the answer to NOBODY."""

    def run(rows: pa.Table) -> pa.Table:
        tables = Packed(kind, rows)
        whole, table, place = kind.joined(tables)
        answer = table.settled(*settings)
        out = _split(tables.heads, whole.told(table, place, answer))
        if hasattr(table, "summary"):
            out = pa.concat_tables([out, arrow_table([(tables.heads[0][0], NOBODY, zstandard.compress(table.summary(answer), 1))], ANSWER)])
        del tables, whole, table, place
        give_back()
        return out

    return run


def _up(kind: type, skip: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """One relay on the way up: the rows of some sources of a range as those of one source, for the ranges below it."""

    def run(rows: pa.Table) -> pa.Table:
        table = kind.joined(Packed(kind, rows))[1]
        out = arrow_table(dealt(table, rows.column("relay")[0].as_py(), rows.column("part")[0].as_py(), skip, bits), PACKED)
        del table
        give_back()
        return out

    return run


def _down(kind: type) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same relay on the way back: what its own rows were told goes to the sources that had them."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        tables = Packed(kind, rows)
        whole, table, place = kind.joined(tables)
        out = _split(tables.heads, whole.told(table, place, flags_of(answers.select(["part", "flags"]).to_pylist(), kind)))
        del tables, whole, table, place
        give_back()
        return out

    return run


def answered(rows: DataFrame, kind: type, bits: list[int], total: int, relay_bytes: int = RELAY_BYTES, settings: tuple = (), skip: int = 0) -> DataFrame:
    """(part, source, flags) for each packed row; `bits` has the bits of the range number that each level adds, the first is in the rows.

    A kind is a table sorted by a 64-bit hash, `mark`: joined() puts several together, settled(*settings) answers its rows if there are no others, told() hands answers on to the rows that
    went into it, part() and read() are its bytes. Summaries of ranges have the source NOBODY.
    """
    if len(bits) == 1:
        return rows.groupBy("part").applyInArrow(_range(kind, settings), ANSWER)
    skip += bits[0]
    slots = max(1, -(-(total >> skip) // relay_bytes))
    rows = written(rows.withColumn("relay", F.col("part") * slots + F.pmod(F.xxhash64("source"), F.lit(slots))), "relays")
    above = rows.groupBy("relay").applyInArrow(_up(kind, skip, bits[1]), PACKED)
    said = written(answered(above, kind, bits[1:], total, relay_bytes, settings, skip), "said")
    back = said.where(F.col("source") != NOBODY).withColumnRenamed("source", "relay")
    return rows.groupBy("relay").cogroup(back.groupBy("relay")).applyInArrow(_down(kind), ANSWER).unionByName(said.where(F.col("source") == NOBODY))


def flags_of(parts: list[dict] | None, kind: type) -> np.ndarray:
    found = [np.frombuffer(zstandard.decompress(p["flags"]), kind.answer_type) for p in sorted(parts or [], key=lambda p: p["part"])]
    return np.concatenate(found) if found else np.empty(0, kind.answer_type)


def by_source(answers: DataFrame, name: str) -> DataFrame:
    """(block, parts): a block's answers in one row, FAN parts at most."""
    rows = answers.groupBy("source").agg(F.collect_list(F.struct("part", "flags")).alias(name))
    return written(rows.withColumnRenamed("source", f"of_{name}"), name)


def levels_of(total: int, range_bytes: int, fan: int) -> list[int]:
    """Bits of the range number by levels of at most `fan` ranges each; where one level is enough, ranges down to a sixteenth keep more tasks busy."""
    most = fan.bit_length() - 1
    bits = max((total // range_bytes).bit_length(), min(most, (16 * total // range_bytes).bit_length()))
    return [min(most, bits - b) for b in range(0, bits, most)] or [0]
