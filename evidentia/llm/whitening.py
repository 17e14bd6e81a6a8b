"""Whitening of embeddings: principal components by MLlib's computeSVD, scaled to variance one."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written
from .vectors import matrix, padded, singular, whole

COMPONENTS = 4
SCALE = 256
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LONG = 1 << 63
#: Sums of squares are added in two parts, so that decimals of 38 digits hold them.
LIMB = 10**18


def off_centre(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: in whole numbers of 64 bits where they suffice for it and its squares' sum, else in Python's."""
    reach = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if reach * reach * max(1, len(sums)) < LONG / 2:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squares(d: np.ndarray) -> list[int]:
    return [int(v) for v in (d * d).sum(axis=1)]


def whitened(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per usable row of vectors and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    vectors: vec_id and an array of numbers; other columns are ignored. Rows whose vector is null or has null or non-finite entries are left out; repeated rows and rows without
    a vec_id stay. Entries become whole numbers x = floor(scale * c); vectors shorter than the longest count as ending in zeros. Mean and covariance V (divisor n) are those of the n
    different x: equal vectors meet by partial aggregation, so a vector with very many copies is one row for each task. computeSVD runs over the centred rows; a singular value s
    gives the eigenvalue s * s / n. deviation is exact, the sum of (n * x - S)**2 with S the sums, and null where no long holds it. The total variance is the sum of the exact
    deviations, not of eigenvalues. There are as many components as the vectors have entries, at most `components`; where V has fewer
    directions (a single vector, equal entries), the others have whitened null and explained 0. identity_error is one figure for all: the largest entry of the
    whitened vectors' covariance minus the identity. An empty table has no rows.
    """
    spark = vectors.sparkSession
    rows = written(whole(vectors, vector, scale), "rows")
    length = rows.agg(F.max(F.size("x"))).first()[0]
    if not length:
        return rows.where(F.lit(False)).select("vec_id", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in SCHEMA.split(", ")[1:]])
    rows = padded(rows, length)
    fit = written(rows.select("x").distinct(), "fit")
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()  # a row for each dimension
    sums = np.array([int(r.s) for r in sums], dtype=object)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = off_centre(matrix(batch.column("x"), length), n, sums)
            y = np.asarray(d / n, dtype=np.float64)
            high, low = divmod(sum(squares(d)), LIMB)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * length), pa.array(y.ravel()))
            first = [pa.array([str(v)] + ["0"] * (len(y) - 1)) for v in (high, low)]
            yield pa.RecordBatch.from_arrays([lists, *first], ["y", "high", "low"])

    moved = written(in_batches(fit).mapInArrow(centred, "y array<double>, high string, low string"), "centred")
    high, low = moved.agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("high", "low")]).first()
    trace = float(Fraction(int(high) * LIMB + int(low), n**3))
    axes, values = singular(moved, "y", length)
    values = values * values / n
    kept = min(components, length, int((values > 0).sum()) if trace > 0 else 0)
    axes, values, scales = axes[:, :kept], values[:kept], np.sqrt(values[:kept])

    def identity_error() -> float | None:
        """Over the fit list: the whitened rows' means, then the products of what is left of them."""
        if not kept:
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = matrix(batch.column("y"), length) @ axes / scales
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(kept)], [f"w{k}" for k in range(kept)])

        w = written(in_batches(moved.select("y")).mapInArrow(run, ", ".join(f"w{k} double" for k in range(kept))), "fit_whitened")
        mean = w.agg(*[F.avg(c).alias(c) for c in w.columns]).first()
        pairs = [(a, b) for a in w.columns for b in w.columns if a <= b]
        cov = w.agg(*[(F.sum((F.col(a) - mean[a]) * (F.col(b) - mean[b])) / n) for a, b in pairs]).first()
        return float(max(abs(c - (a == b)) for c, (a, b) in zip(cov, pairs, strict=True)))

    error, shown = identity_error(), min(components, length)
    explained = [float(v / trace) for v in values] + [0.0] * (shown - kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = off_centre(matrix(batch.column("x"), length), n, sums)
            w = np.asarray(d / n, dtype=np.float64) @ axes / scales if kept else np.empty((len(d), 0))
            w = np.c_[w, np.full((len(d), shown - kept), np.nan)]
            deviation = np.repeat(np.array([v if v < LONG else None for v in squares(d)], dtype=object), shown)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(d)), shown)))
            number = np.tile(np.arange(1, shown + 1, dtype=np.int32), len(d))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(number), pa.array(np.full(len(number), n, np.int64)), pa.array(deviation, pa.int64()), pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.array(explained)[number - 1]), pa.array([error] * len(number), pa.float64())
                ],
                [k.split()[0] for k in SCHEMA.split(", ")]
            )

    return in_batches(rows).mapInArrow(run, SCHEMA)
