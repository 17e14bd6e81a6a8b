"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by scaled forward recursion.

States emit word classes: a frequent word is a class of its own, other known words share classes by frequency and shape, unknown
words are one class. A class emits its words in proportion to their smoothed training counts. So the model's tables are
bounded by STATES and FREQUENT, while the counts of all words stay in the data, dealt out by ranges of a word hash. Words are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, crc_fold, given_back, in_batches, slices, text_or_empty, written
from .exchange import FAN, NOBODY, RELAY_BYTES, answered, by_source, dealt, flags_of, levels_of, steps, unstepped

STATES = 6
ROUNDS = 4
#: A word with at least one in so many training tokens is a class of its own, so there are at most so many.
FREQUENT = 10_000
#: Bytes of text in a block, and for each range of the word hash.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 32 << 20
#: Tokens of a text that are passed over one after the other in training; its pieces are side by side and joined exactly.
PIECE = 512
END = b""
SHAPES = 64 * 4 * 2 * 8
UNKNOWN = SHAPES  # class numbers: shapes, the unknown word, then frequent words

_BLOCK = "block long, docs binary, held binary, sizes binary, tokens binary, n_train long, part long, n long, packed binary"


def _zip(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unzip(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() + [END]


def form(word: bytes) -> int:
    """Of 64 forms: a word's length, whether it has other than ASCII bytes, its last letters."""
    return (min(len(word) // 4, 3) * 2 + (not word.isascii())) * 8 + zlib.crc32(word.rstrip(b".,;:!?|")[-2:]) % 8


def shapes_of(forms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes of known words that are not frequent: their form and the power of two of their count."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], 63).astype(np.int64) * 64 + forms


def names_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the words' 128-bit names; words are dealt out by the first."""
    return tuple(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)) for seed in (1, 2))


class Words:
    """Different words, sorted by name: its halves, the word's form and its training count."""

    answer_type = np.dtype([("count", "<i8"), ("kind", "<i8")])

    def __init__(self, mark: np.ndarray, low: np.ndarray, form: np.ndarray, count: np.ndarray):
        self.mark, self.low, self.form, self.count = mark, low, form, count

    @classmethod
    def joined(cls, tables: Iterable[Words]) -> tuple[Words, Words, np.ndarray]:
        """All rows of several tables, the table of the different words with their counts added up, and each row's place in it."""
        whole = cls(*map(np.concatenate, zip(*((t.mark, t.low, t.form, t.count) for t in tables), strict=True)))
        order = np.lexsort((whole.low, whole.mark))
        mark, low = whole.mark[order], whole.low[order]
        new = np.r_[True, (mark[1:] != mark[:-1]) | (low[1:] != low[:-1])]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return whole, cls(mark[new], low[new], whole.form[order][new], np.add.reduceat(whole.count[order], np.flatnonzero(new))), place

    def settled(self, n_train: int, frequent: int) -> np.ndarray:
        """Each word's training count over all blocks, and its class: a shape, the unknown word, or for a frequent word a negative number of its own."""
        answer = np.empty(len(self.mark), self.answer_type)
        answer["count"] = self.count
        own = -1 - (self.mark >> np.uint64(2)).astype(np.int64)
        answer["kind"] = np.where(self.count == 0, UNKNOWN, np.where(self.count * frequent >= n_train, own, shapes_of(self.form.astype(np.int64), self.count)))
        return answer

    def told(self, table: Words, place: np.ndarray, answer: np.ndarray) -> np.ndarray:
        return answer[place]

    def summary(self, answer: np.ndarray) -> bytes:
        """(class, training tokens, words) of the classes with training tokens."""
        known = answer[answer["count"] > 0]
        kinds, at = np.unique(known["kind"], return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, at, known["count"])
        return np.concatenate([kinds, total, np.bincount(at, minlength=len(kinds))]).astype("<i8").tobytes()

    def part(self, b: int, e: int) -> bytes:
        return b"".join([steps(self.mark[b:e]), self.low[b:e].tobytes(), self.form[b:e].tobytes(), self.count[b:e].tobytes()])

    @classmethod
    def read(cls, raw: bytes, n: int) -> Words:
        return cls(unstepped(raw, n), np.frombuffer(raw, np.uint64, n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n), np.frombuffer(raw, "<i8", n, 17 * n))


def _blocks(docs: DataFrame, bits: int, block_bytes: int, n_bytes: int) -> DataFrame:
    """Texts as numbers into their block's list of words, sorted by name, and that list with its training counts as packed rows for the exchange; bucketed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        number: dict[bytes, int] = {}
        ids, held, sizes, tokens, size = [], [], [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(number)
            mark, low = names_of(words)
            order = np.lexsort((low, mark))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            token = place[np.concatenate(tokens)]
            train = np.repeat(~np.array(held, bool), sizes)
            forms = np.fromiter(map(form, words), np.uint8, len(words))
            table = Words(mark[order], low[order], forms[order], np.bincount(token[train], minlength=len(words)).astype(np.int64))
            found = [(
                block, np.array(ids, np.int64).tobytes(), np.array(held, np.int8).tobytes(), np.array(sizes, np.int64).tobytes(), _zip(token),
                int(train.sum()), None, None, None
            )]
            found += [(block, None, None, None, None, None, part, n, packed) for part, _, n, packed in dealt(table, block, 0, 0, bits)]
            kinds = [pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in (part for whole in batches for part in slices(whole)):
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = tokens_of(text)
                tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws)))
                ids.append(doc if doc is not None else np.iinfo(np.int64).min)
                held.append(out)
                sizes.append(len(ws))
                size += len(text) + 1
                if size >= block_bytes:
                    yield from rows()
                    block += 1
                    number = {}
                    ids, held, sizes, tokens, size = [], [], [], [], 0
        if ids:
            yield from rows()

    return bucketed(in_batches(docs.select("doc_id", "held_out", "text")).mapInArrow(given_back(run), _BLOCK), "block", "blocks", n_bytes)


def _class_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, total, n) from the summaries of ranges."""
    for batch in batches:
        for raw in batch.column("flags"):
            kinds, total, n = np.frombuffer(zstandard.decompress(raw.as_buffer()), "<i8").reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(total), pa.array(n)], ["class", "total", "n"])


@dataclass
class Model:
    """Start, transitions and emissions of classes; for each class the log10 of its words' total weight; training tokens and different ones."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    weight: np.ndarray
    n: int
    v: int


def initial(weight: np.ndarray, n: int, v: int, states: int) -> Model:
    """Every state near the class frequencies, told apart by a fixed pseudo-random factor."""
    rng = np.random.default_rng(7)
    emit = weight[None, :] * rng.uniform(0.3, 1.7, (states, len(weight)))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True), weight, n, v)


def _joints(model: Model, likely: list[np.ndarray], live: np.ndarray, nth: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the pieces before and after a piece say: the forward vector ahead of it (of pieces that are not their text's first), and the backward vector at its end.

    A piece is the product of its tokens' matrices (moves times emissions), so the vectors go from piece to piece, not from token to token.
    nth: a piece's number in its text; follows: the row of the piece after it, or -1.
    """
    k, n = len(model.start), len(nth)
    ahead, behind = np.zeros((n, k)), np.ones((n, k))
    mine = np.flatnonzero((nth > 0) | (follows >= 0))
    if not len(mine):
        return ahead, behind
    product = np.broadcast_to(np.eye(k), (len(mine), k, k)).copy()
    for t, emit in enumerate(likely):
        m = int(np.searchsorted(mine, live[t]))
        if not m:
            break
        now = product[:m]
        step = (now.reshape(-1, k) @ model.move).reshape(m, k, k)
        if t == 0:  # the first token of a text has a start in place of a move
            step[nth[mine[:m]] == 0] = model.start
        step *= emit[mine[:m]][:, None, :]
        product[:m] = step / step.max(axis=(1, 2), keepdims=True)
    row = np.full(n, -1)
    row[mine] = np.arange(len(mine))
    last = int(nth.max())
    at = [mine[nth[mine] == j] for j in range(last + 1)]
    first = at[0]
    vector = product[row[first], 0]  # all rows of a first piece are the same
    for j in range(last):
        there = follows[at[j]] >= 0
        to = follows[at[j]][there]
        a = vector[there] / vector[there].sum(axis=1, keepdims=True)
        ahead[to] = a
        vector = np.empty((len(at[j + 1]), k))
        vector[np.searchsorted(at[j + 1], to)] = np.einsum("ni,nij->nj", a, product[row[to]])
    for j in range(last, 0, -1):
        to = at[j]
        back = np.einsum("nij,nj->ni", product[row[to]], behind[to])
        before = np.full(n, -1)
        before[follows[at[j - 1]][follows[at[j - 1]] >= 0]] = at[j - 1][follows[at[j - 1]] >= 0]
        behind[before[to]] = back / back.max(axis=1, keepdims=True)
    return ahead, behind


def expected(model: Model, cls: np.ndarray, sizes: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of whole sequences of classes, by the scaled forward and backward recursions, and the natural log-likelihood.

    Long sequences are worked on in pieces side by side; a piece begins with the forward vector of what is before it and ends with the backward vector of what
    is after it, so the counts are those of the uncut sequence.
    """
    pieces = -(-sizes // piece)
    cut = np.full(int(pieces.sum()), piece)
    cut[np.cumsum(pieces) - 1] = sizes - (pieces - 1) * piece
    number = np.arange(len(cut)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    order = np.argsort(-cut, kind="stable")
    begin, size, nth = (np.cumsum(cut) - cut)[order], cut[order], number[order]
    place = np.empty(len(cut), dtype=np.int64)
    place[order] = np.arange(len(cut))
    more = np.r_[number[1:] > 0, False]
    follows = np.where(more, np.r_[place[1:], -1], -1)[order]
    longest, k = int(size[0]), len(model.start)
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # pieces longer than t
    at = [begin[: live[t]] + t for t in range(longest)]
    emit = np.ascontiguousarray(model.emit.T)
    likely = [emit[cls[a]] for a in at]
    ahead, behind = _joints(model, likely, live, nth, follows)
    first = nth == 0
    alpha, scale, log = [], [], 0.0
    for t in range(longest):
        a = (np.where(first[:, None], model.start, ahead @ model.move) if t == 0 else alpha[-1][: live[t]] @ model.move) * likely[t]
        s = a.sum(axis=1, keepdims=True)
        alpha.append(a / s)
        scale.append(s)
        log += float(np.log(s).sum())
    moves, emits = np.zeros((k, k)), np.empty((len(cls), k))
    beta = np.ones((0, k))
    for t in range(longest - 1, -1, -1):
        done = len(beta)
        now = np.empty((live[t], k))
        if done:
            next_ = likely[t + 1] * beta / scale[t + 1]
            moves += alpha[t][:done].T @ next_
            now[:done] = next_ @ model.move.T
        ends = behind[done : live[t]]
        now[done:] = ends / (alpha[t][done:] * ends).sum(axis=1, keepdims=True)
        emits[at[t]] = alpha[t] * now
        beta = now
    moves += ahead.T @ (likely[0] * beta / scale[0])  # over the cuts; zero ahead of first pieces
    starts = emits[begin[first]].sum(axis=0)
    return starts, moves * model.move, np.stack([np.bincount(cls, weights=emits[:, j], minlength=model.emit.shape[1]) for j in range(k)]), log


def log_likelihood(model: Model, cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each whole sequence of classes by the scaled forward recursion; the longest first, all at once."""
    order = np.argsort(-sizes, kind="stable")
    begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    emit, total = np.ascontiguousarray(model.emit.T), np.zeros(len(sizes))
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    a = np.broadcast_to(model.start, (len(size), len(model.start)))
    for t in range(int(size[0])):
        n = live[t]
        a = (a if t == 0 else a[:n] @ model.move) * emit[cls[begin[:n] + t]]
        s = a.sum(axis=1)
        a = a / s[:, None]
        total[:n] += np.log10(s)
    out = np.empty(len(sizes))
    out[order] = total
    return out


def with_unknown(emit: np.ndarray) -> np.ndarray:
    """A state meets an unknown word as often as words seen once (Good and Turing's estimate), half of the time at most."""
    once = np.minimum(emit[:, SHAPES // 64 : 2 * SHAPES // 64].sum(axis=1), 0.5)
    emit = emit * (1 - once)[:, None]
    emit[:, UNKNOWN] += once
    return emit / emit.sum(axis=1, keepdims=True)


def _learned(coded: DataFrame, model: Model, rounds: int) -> Model:
    """Baum-Welch: a round adds up the expected counts of all training texts over partitions; only the model's own tables reach the driver."""
    states, classes = model.emit.shape
    for _ in range(rounds):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            starts, moves, emits, seen = 0, 0, np.zeros(now.emit.shape), False
            for batch in batches:
                for held, sizes, cls in zip(batch.column("held").to_pylist(), batch.column("sizes").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                    held, sizes, cls = np.frombuffer(held, np.int8) == 1, np.frombuffer(sizes, np.int64), _unzip(cls, np.uint16).astype(np.int64)
                    cls, sizes = cls[np.repeat(~held, sizes)], sizes[~held]
                    if not len(sizes):
                        continue
                    s, m, e, _ = expected(now, cls, sizes)
                    starts, moves, emits, seen = starts + s, moves + m, emits + e, True
            if seen:
                flat = np.concatenate([starts, moves.ravel(), emits.ravel()])
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["cell", "value"])

        cells = coded.select("held", "sizes", "classes").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(states + states * states + states * classes)
        flat[cells["cell"].to_numpy()] = cells["value"].to_numpy()
        starts, moves, emits = flat[:states] + 0.1, flat[states : states * (states + 1)].reshape(states, states) + 0.1, flat[states * (states + 1) :].reshape(states, classes)
        emits = emits + model.weight / model.weight.sum()  # one token of the class frequencies, so nothing is impossible
        model = Model(
            starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), with_unknown(emits / emits.sum(axis=1, keepdims=True)), model.weight,
            model.n, model.v
        )
    return model


def scored(
    docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN,
    relay_bytes: int = RELAY_BYTES
) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability under the model).

    docs: doc_id, text; other columns are ignored. Rows whose crc32(doc_id as text) mod 5 is 1 are held out and teach nothing. A null text counts as empty (its end is a token);
    repeated rows stay and count as often; a null doc_id is not held out. With no training text every known count is 0 and the model gives every text
    the base score's form over the unknown word alone.

    The text is read once for its size and once for its tokens; later passes read numbers. Words are counted by block and hash range, so a word sends one row part for each
    block that has it; blocks themselves are never shuffled.
    """
    held = F.coalesce(crc_fold() == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, text_or_empty().alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = levels_of(size, range_bytes, fan)
    store = _blocks(rows, levels[0], block_bytes, size)
    n = store.agg(F.sum("n_train")).first()[0] or 0
    words = store.where("part is not null").select("part", F.col("block").alias("source"), "n", "packed")
    counted = written(answered(words, Words, levels, size, relay_bytes, (n, FREQUENT)), "counts")

    classes = in_batches(counted.where(F.col("source") == NOBODY)).mapInArrow(_class_totals, "class long, total long, n long")
    classes = classes.groupBy("class").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # at most SHAPES and FREQUENT rows
    own = sorted((r["class"], r.total) for r in classes if r["class"] < 0)[::-1]
    weight = np.zeros(SHAPES + 1 + len(own))
    for r in classes:
        if r["class"] >= 0:
            weight[r["class"]] = r.total + 0.5 * r.n
    weight[UNKNOWN] = 0.5
    weight[UNKNOWN + 1 :] = [t + 0.5 for _, t in own]
    v = sum(r.n for r in classes)
    of_own = np.array([-1 - k for k, _ in own], np.int64)  # rising
    log_weight = np.log10(np.where(weight > 0, weight, 1.0))
    floor = np.log10(n + 0.5 * (v + 1))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, token = np.frombuffer(row["sizes"], np.int64), _unzip(row["tokens"], np.int32)
                told = flags_of(row["counts"], Words)
                count, kind = told["count"], np.where(told["kind"] < 0, UNKNOWN + 1 + np.searchsorted(of_own, -1 - told["kind"]), told["kind"])
                value = np.log10(count + 0.5)
                inner = value - log_weight[kind]
                begins = np.cumsum(sizes) - sizes
                base = np.add.reduceat(value[token], begins) - sizes * floor
                known = np.add.reduceat((count > 0)[token].astype(np.int64), begins)
                data = [
                    row["block"], row["docs"], row["held"], row["sizes"], _zip(kind[token].astype(np.uint16)), known.tobytes(), base.tobytes(),
                    np.add.reduceat(inner[token], begins).tobytes()
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(data)],
                    ["block", "docs", "held", "sizes", "classes", "known", "base", "inner"]
                )

    answers = by_source(counted.where(F.col("source") != NOBODY), "counts")
    joined = store.where("part is null").select("block", "docs", "held", "sizes", "tokens").join(answers, F.col("block") == F.col("of_counts")).drop("of_counts")
    coded = written(
        joined.mapInArrow(given_back(code), "block long, docs binary, held binary, sizes binary, classes binary, known binary, base binary, inner binary"),
        "coded"
    )
    model = _learned(coded, initial(weight, n, v, states), rounds if n else 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, sizes = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["sizes"], np.int64)
                value = log_likelihood(model, _unzip(row["classes"], np.uint16).astype(np.int64), sizes) + np.frombuffer(row["inner"], float)
                ids = pa.array(doc, mask=doc == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.frombuffer(row["held"], np.int8) == 1), pa.array(sizes), pa.array(np.frombuffer(row["known"], np.int64)),
                        pa.array(np.full(len(doc), model.n)), pa.array(np.frombuffer(row["base"], float)), pa.array(value)
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    return coded.drop("block").mapInArrow(
        given_back(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
