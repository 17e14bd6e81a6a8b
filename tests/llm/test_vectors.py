"""Exact search and whitening against numpy over all pairs and rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import topk, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, copies int, norm double, n int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 2, 0.5, 7) for i, v in rows], SCHEMA).repartition(parts)


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def brute(rows, k, every, scale):
    """(query_id, rank, vec_id, score), as often as each comes."""
    rows = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in usable(rows) if i is not None]
    length, out = max((len(v) for _, v in rows), default=0), Counter()
    rows = [(i, v + [0] * (length - len(v))) for i, v in rows]
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for r, (j, w) in enumerate(rows) if r != q)[:k]
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(found, 1))
    return out


def varied(n=900, length=12, seed=3, spread=1.0):
    """Lengths over two orders of magnitude, a third of the rows equal, repeated rows and ids, and every kind of unusable row."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, length)) * np.exp(spread * rng.normal(size=(n, 1))) * np.geomspace(3, 0.05, length)
    v[rng.random(n) < 0.33] = v[0]
    rows = [(int(i), list(map(float, x))) for i, x in enumerate(v)]
    rows += [rows[5], rows[20], rows[20], (20, rows[7][1]), (40, rows[1][1]), (None, rows[3][1]), (60, None), (80, [float("nan")] * length), (100, [None] * length)]
    rows += [(2001, [float("inf")] + [0.0] * (length - 1)), (2020, []), (2040, [1.0, 2.0]), (2060, [-0.0] * length)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("spread, block_bytes, first_rows", [(1.0, 8 << 20, 4096), (2.0, 8 * 12 * 9, 40), (0.0, 8 * 12 * 30, 100)])
def test_search_is_that_of_all_pairs(spark, spread, block_bytes, first_rows):
    rows = varied(spread=spread)
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame(spark, rows), 7, 20, block_bytes=block_bytes, first_rows=first_rows).collect())
    assert got == brute(rows, 7, 20, 64)


def test_search_of_few_large_and_no_rows(spark):
    few = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [2.0, -1.0])]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame(spark, few)).collect()}
    assert got == set(brute(few, 20, 20, 64)) and len(got) == 4
    large = [(k * 10, [float(k) * 3e6 + 0.1, -float(k) * 2e6]) for k in range(9)]  # beyond 2**53, within a long
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame(spark, large)).collect())
    assert got == brute(large, 20, 20, 64)
    with pytest.raises(ArithmeticError):
        topk.top_k(frame(spark, [(0, [1e300]), (1, [1e300])]))
    assert topk.top_k(frame(spark, few).where(F.lit(False))).collect() == []
    assert topk.top_k(frame(spark, [(1, [1.0]), (2, [2.0])])).collect() == []  # no query
    assert topk.top_k(frame(spark, [(20, [1.0])])).collect() == []  # no candidate


def test_bounds_save_work_and_nothing_else():
    """Pairs out of reach are not multiplied out, and what is found stays the same."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 16)) * np.geomspace(400, 1, 16)).astype(np.int64)
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    axes = np.linalg.svd(x.astype(float), full_matrices=False)[2].T
    q, full = x[::50], 0
    block = topk.Block(np.arange(0, 4000, 50), q, np.ones(len(q), np.int64), axes, [2, 4, 8], True, 5, np.full(len(q), topk.LEAST), np.full(len(q), topk.NO_ID))
    multiplied = []
    block._exact = lambda product: (multiplied.append(product.size), product.astype(np.int64))[1]
    for k in range(0, 4000, 250):
        block.see(np.arange(k, k + 250), x[k : k + 250], np.ones(250, np.int64))
        full += 250 * len(q)
    assert sum(multiplied) < 0.3 * full
    for i in range(len(q)):
        want = sorted((-int(s), j) for j, s in enumerate(x @ q[i]) if j != 50 * i)[:5]
        assert list(zip((-block.score[i]).tolist(), block.found[i].tolist(), strict=True)) == want


def white(rows, components=4, scale=256):
    rows = usable(rows)
    length = max((len(v) for _, v in rows), default=0)
    x = np.array([[int(np.floor(scale * c)) for c in v] + [0] * (length - len(v)) for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    y = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(y.T @ y / len(fit))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return [i for i, _ in rows], x, fit, values, axes, float((y * y).sum() / len(fit))


def test_whitening_is_that_of_numpy(spark):
    rows = varied()
    ids, x, fit, values, axes, trace = white(rows)
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == 4 * len(ids) and Counter(r.vec_id for r in got) == Counter(4 * ids)
    n, sums = len(fit), fit.sum(axis=0)
    of: dict = {}
    for i, row in zip(ids, x, strict=True):
        of.setdefault(i, []).append(row)
    sign = {}
    for c in range(1, 5):
        mine = sorted(((r.vec_id is None, r.vec_id or 0), r.deviation, r.whitened) for r in got if r.component == c)
        want = sorted(((i is None, i or 0), int(((n * row - sums) ** 2).sum()), float((row - sums / n) @ axes[:, c - 1] / np.sqrt(values[c - 1]))) for i, row in zip(ids, x, strict=True))
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        a, b = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        sign[c] = np.sign(a @ b)
        assert np.allclose(a, sign[c] * b, atol=1e-9)
    assert {r.n for r in got} == {n}
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), values / trace, rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)


def test_whitening_of_few_directions_and_no_rows(spark):
    flat = [(k, [float(k), 2.0 * k, 3.0]) for k in range(10)]
    got = whitening.whitened(frame(spark, flat)).collect()
    assert len(got) == 30  # three entries, three components
    assert all((r.whitened is None) == (r.component > 1) and (r.explained == 0) == (r.component > 1) for r in got)
    alone = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone} == {(i, c, 1, 0, None, 0.0, None) for i in (1, None) for c in (1, 2)}
    huge = whitening.whitened(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id in (1, 2)} == {None}
    assert whitening.whitened(frame(spark, flat).where(F.lit(False))).collect() == []
