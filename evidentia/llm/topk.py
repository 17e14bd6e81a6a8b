"""Exact search for the largest inner products: rows by falling length, partial sums in rotated coordinates, Cauchy-Schwarz bounds for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import placed
from .common import fresh_path, in_batches, written
from .vectors import matrix, padded, singular, whole

K, EVERY, SCALE = 20, 20, 64
#: Bytes of the queries of a block as they are broadcast, twice over (as they are, and rotated).
BLOCK_BYTES = 8 << 20
#: Rows of the first slab by length, and how much larger each further slab is.
FIRST_ROWS, GROWTH = 4096, 4
#: Bytes of rows for a task at least, if there are tasks enough for all cores.
TASK_BYTES = 8 << 20
#: Queries and rows compared at a time.
TILE = (512, 2048)
#: Share of pairs that are still possible from which all of a tile are multiplied out.
DENSE = 1 / 16
#: What a bound may be short of by rounding, relative to the product of lengths.
SLACK = 1e-9
EXACT = 1 << 53
LEAST, NO_ID = -(1 << 63), (1 << 63) - 1
FOUND = "query long, score long, vec_id long, copies long"


class Block:
    """The queries of a block, their rotated coordinates and residual lengths, and the best rows seen."""

    def __init__(self, ids, x, copies, axes, levels, exact, k, floor, floor_id):
        self.ids, self.copies, self.k, self.exact, self.levels, self.axes = ids, copies, k, exact, levels, axes
        self.x = x.astype(np.float64) if exact else x
        self.length, self.y, self.rest = self.turned(x)
        self.floor, self.floor_id = floor.copy(), floor_id.copy()
        self.score, self.found, self.many = np.full((len(ids), k), LEAST), np.full((len(ids), k), NO_ID), np.zeros((len(ids), k), np.int64)

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Lengths, coordinates along the axes, and the lengths of what is left after each level."""
        x = x.astype(np.float64)
        whole, y = np.einsum("ij,ij->i", x, x), x @ self.axes
        rest = [np.sqrt(np.maximum(0.0, whole - np.einsum("ij,ij->i", y[:, :b], y[:, :b])) + SLACK * whole) for b in self.levels]
        return np.sqrt(whole), y, rest

    def see(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray) -> None:
        length, y, rest = self.turned(x)
        x = x.astype(np.float64) if self.exact else x
        for q in range(0, len(self.ids), TILE[0]):
            for c in range(0, len(ids), TILE[1]):
                s = slice(c, c + TILE[1])
                self._tile(np.arange(q, min(q + TILE[0], len(self.ids))), ids[s], x[s], copies[s], length[s], y[s], [r[s] for r in rest])

    def _tile(self, q, ids, x, copies, length, y, rest) -> None:
        # by length alone: rows come by falling length, so soon whole tiles are out of reach
        q = q[self.length[q] * length.max() * (1 + SLACK) >= self.floor[q]]
        if not len(q):
            return
        bound = self.floor[q].astype(np.float64)[:, None] - SLACK * self.length[q][:, None] * length[None, :]
        alive, share = None, 1.0
        if (self.floor[q] > LEAST).all():
            part, a = np.zeros((len(q), len(ids))), 0
            for level, b in enumerate(self.levels):
                part += self.y[q, a:b] @ y[:, a:b].T
                alive = part + self.rest[level][q][:, None] * rest[level][None, :] >= bound
                share, a = np.count_nonzero(alive) / alive.size, b
                if share < DENSE:
                    break
        if share == 0:
            return
        if share < DENSE:
            at, row = np.nonzero(alive)
            score = self._exact(np.einsum("ij,ij->i", self.x[q[at]], x[row]))
        else:
            product = self._exact(self.x[q] @ x.T)
            for i, j in zip(*np.nonzero(self.ids[q][:, None] == ids[None, :]), strict=True):  # a query's own row is none of its answers
                if copies[j] == 1 and np.array_equal(self.x[q[i]], x[j]):
                    product[i, j] = LEAST
            least = self.floor[q]
            if product.shape[1] > self.k and np.count_nonzero(product >= least[:, None]) > 4 * self.k * len(q):
                least = np.maximum(least, np.partition(product, -self.k, axis=1)[:, -self.k])
            at, row = np.nonzero((product >= least[:, None]) & (product > LEAST))
            score = product[at, row]
        self._keep(q[at], score, ids[row], copies[row], x[row])

    def _exact(self, product: np.ndarray) -> np.ndarray:
        return product.astype(np.int64)

    def _keep(self, q, score, ids, copies, x) -> None:
        fine = (score > self.floor[q]) | ((score == self.floor[q]) & (ids <= self.floor_id[q]))
        q, score, ids, copies, x = q[fine], score[fine], ids[fine], copies[fine], x[fine]
        own = np.flatnonzero(ids == self.ids[q])
        own = own[(self.x[q[own]] == x[own]).all(axis=1)] if len(own) else own
        copies = copies.copy()
        copies[own] -= 1
        fine = copies > 0
        q, score, ids, copies = q[fine], score[fine], ids[fine], copies[fine]
        if not len(q):
            return
        touched = np.unique(q)
        old = self.many[touched] > 0
        q = np.r_[np.repeat(touched, self.k)[old.ravel()], q]
        score, ids, copies = (np.r_[mine[touched][old], new] for mine, new in ((self.score, score), (self.found, ids), (self.many, copies)))
        order = np.lexsort((ids, -score, q))
        q, score, ids, copies = q[order], score[order], ids[order], copies[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        fine = place < self.k
        q, place = q[fine], place[fine]
        self.score[touched], self.found[touched], self.many[touched] = LEAST, NO_ID, 0
        self.score[q, place], self.found[q, place], self.many[q, place] = score[fine], ids[fine], copies[fine]
        last, last_id = self.score[touched, -1], self.found[touched, -1]
        better = (self.many[touched, -1] > 0) & ((last > self.floor[touched]) | ((last == self.floor[touched]) & (last_id < self.floor_id[touched])))
        self.floor[touched[better]], self.floor_id[touched[better]] = last[better], last_id[better]

    def batch(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.many > 0)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (q, self.score[q, place], self.found[q, place], self.many[q, place])], ["query", "score", "vec_id", "copies"])


def _search(block, length: int):
    """block: a broadcast of what Block is made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Block(*block.value)
        for batch in batches:
            if batch.num_rows:
                ids, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "copies"))
                seen.see(ids, matrix(batch.column("x"), length), copies)
        yield seen.batch()

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each query by falling score, then vec_id."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).drop("rank")


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, vector: str = "embedding", scale: int = SCALE, block_bytes: int = BLOCK_BYTES, first_rows: int = FIRST_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k largest inner products with all other rows; ties go to the smaller vec_id.

    vectors: vec_id and an array of numbers; other columns are ignored. Components become whole numbers floor(scale * c). Vectors that are null or hold null or non-finite components
    take no part, nor do rows without a vec_id, which could not be named; vectors of another length count as ending in zeros. Every row is a candidate for itself, so a repeated row is found
    as often as it is there, and a query that is repeated finds its copies and is answered as often. Fewer rows than k are all returned. Scores must fit a
    long, else an ArithmeticError is raised. An empty table has no rows.

    Rows are written by falling length, in ranges. A block of queries of a bounded size is broadcast and meets the rows in slabs that grow fourfold: what the longest rows
    give is the threshold for the rest, so few rows leave a task. A scan reads only the row groups whose length can reach some threshold of the
    block. Within a task, rows are bounded by partial sums along the leading singular vectors and the lengths of what is left (Cauchy-Schwarz); pairs that may still reach
    the threshold are multiplied out in whole numbers, so every bound only saves work.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = written(whole(vectors, vector, scale).where("vec_id is not null"), "rows")
    length, n_rows = rows.agg(F.max(F.size("x")), F.count("*")).first()
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length = max(1, length or 0)
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    one = padded(rows, length).groupBy("vec_id", "x").agg(F.count("*").alias("copies")).withColumn("norm", F.sqrt(square))
    one = one.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    one = written(one, "by_length")
    n, longest = one.agg(F.count("*"), F.max("norm")).first()
    if longest * longest * 1.0001 >= NO_ID:
        raise ArithmeticError("inner products exceed a long")
    exact = longest * longest * 1.0001 < EXACT
    axes, _ = singular(one.select(F.transform("x", lambda c: c.cast("double")).alias("y")), "y", length)
    levels = sorted({max(1, axes.shape[1] * p // 8) for p in (1, 2, 4)}) if axes.shape[1] else []

    # cuts by length: whatever they are, the slabs are all rows
    sizes = [first_rows * GROWTH**i for i in range(64) if first_rows * GROWTH**i < n]
    cuts = one.approxQuantile("norm", [1 - s / n for s in sizes], 0.0005) if sizes else []
    cuts = sorted(set(cuts) - {longest}, reverse=True)
    slabs = list(zip([None, *cuts], [*cuts, None], strict=True))
    tasks = max(sc.defaultParallelism, n * length * 8 // TASK_BYTES)

    per_block = max(1, block_bytes // (8 * length))
    queries = one.where(F.col("vec_id") % every == 0)
    # by falling length, per_block queries a block, however the ranges of the table are cut
    asked = placed(queries, [F.desc("norm"), "vec_id"]).withColumn("block", F.floor(F.col("place") / per_block)).drop("place")
    asked = written(asked, "queries")
    names = [r.block for r in asked.select("block").distinct().orderBy("block").collect()]  # one for each block_bytes of queries
    out = fresh_path(spark, "answers")
    for name in names:
        mine = asked.where(F.col("block") == name).orderBy(F.desc("norm"), "vec_id").select("vec_id", "x", "copies", "norm").toPandas()  # per_block rows at most
        ids, x = mine.vec_id.to_numpy(), np.array(mine.x.tolist(), dtype=np.int64).reshape(len(mine), length)
        copies, norms = mine["copies"].to_numpy(), mine.norm.to_numpy()
        floor, floor_id, found = np.full(len(ids), LEAST), np.full(len(ids), NO_ID), None
        for high, low in slabs:
            reach = float(np.min(floor.astype(np.float64) / np.maximum(norms, 1e-300))) * (1 - SLACK) if (floor > 0).all() else 0.0
            slab = one
            slab = slab.where(F.col("norm") < high) if high is not None else slab
            slab = slab.where(F.col("norm") >= low) if low is not None else slab
            if high is not None and high < reach:
                break  # no shorter row reaches any threshold
            slab = slab.where(F.col("norm") >= reach) if reach > 0 else slab
            block = sc.broadcast((ids, x, copies, axes, levels, exact, k, floor, floor_id))
            new = in_batches(slab.select("vec_id", "x", "copies").coalesce(tasks)).mapInArrow(_search(block, length), FOUND)
            found = written(best(new if found is None else new.unionByName(found), k), "found")
            last = found.groupBy("query").agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("last")).where(F.col("n") >= k)
            for r in last.select("query", "last.s", "last.vec_id").collect():  # a row for each query of the block
                floor[r.query], floor_id[r.query] = -r.s, r.vec_id
        answered = spark.createDataFrame([(i, int(v), int(c)) for i, (v, c) in enumerate(zip(ids, copies, strict=True))], "query long, query_id long, times long")
        found.join(answered, "query").withColumn("block", F.lit(name)).write.mode("append").parquet(out)
    schema = "query long, score long, vec_id long, copies long, query_id long, times long, block long"
    answers = spark.read.schema(schema).parquet(out) if names else spark.createDataFrame([], schema)
    # a row and a query that are repeated: each copy is an answer, and each query is answered
    each = answers.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("block", "query", "times").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    fine = "embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0"
    return f"""
    with v as (select vec_id, list_transform(embedding, lambda c: floor({scale} * c::double)) as x from embeddings where {fine}),
    s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0)
    select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
    qualify rank <= {k}"""
