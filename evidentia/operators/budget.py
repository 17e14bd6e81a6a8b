"""Reverse impact under shared budgets: states and examined edges are spent in one total order, and what is cut short says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .durable import counted, cut

#: Fixed values of the traversal: states and edge examinations of a request, over all its origins.
STATES, EXAMINATIONS = 2_000, 16_000
DEPTH_LIMIT, WORK_LIMIT = "depth_limit", "traversal_work_limit"


def _trace(nodes: DataFrame, edges: DataFrame, origins: DataFrame, depth: int, states: int, examinations: int) -> tuple[DataFrame, DataFrame]:
    """What each origin would do with the whole budget to itself: its seeds (origin, id, pos) and the edges it examines (origin, step, pos, dst, src, src_file, distance).

    A step expands the unexpanded nodes of the least distance; within it edges go by dst, src and relation. Hops within a file cost nothing. No step keeps more than
    `examinations` edges of an origin, nor are more than `states` nodes ever admitted, so a hub costs a bounded number of rows (the limit is taken in each task before the shuffle).
    """
    of = nodes.select("id", "file")
    ends = edges.select("src", "dst", "relation").distinct().join(of.toDF("src", "src_file"), "src").join(of.toDF("dst", "dst_file"), "dst")
    ends = cut(ends.withColumn("cost", (F.col("src_file") != F.col("dst_file")).cast("int")))
    seeds = origins.select("origin", "file").distinct().join(of, "file").select("origin", "id")
    seeds = cut(seeds.withColumn("pos", F.row_number().over(W.partitionBy("origin").orderBy("id"))).where(F.col("pos") <= states + 1))
    frontier, n = counted(seeds.where(F.col("pos") <= states).select("origin", "id"))
    known = frontier.withColumns({"distance": F.lit(0), "seq": F.lit(0).cast("long"), "expanded": F.lit(False)})
    level, step, trace = 0, 1, None
    while level <= depth:
        if n:
            rank = F.row_number().over(W.partitionBy("origin").orderBy("dst", "src", "relation"))
            seen = ends.join(frontier.withColumnRenamed("id", "dst"), "dst").withColumn("pos", rank).where(F.col("pos") <= examinations)
            seen = cut(seen.select("origin", F.lit(step).alias("step"), "pos", "dst", "src", "src_file", (F.col("cost") + level).alias("distance")))
            trace = seen if trace is None else trace.unionByName(seen)
            met = seen.where(F.col("distance") <= depth).groupBy("origin", F.col("src").alias("id")).agg(
                F.min("distance").alias("distance"), (F.min("pos") + step * (1 << 40)).alias("seq")
            )
            done = known.join(frontier.withColumn("now", F.lit(True)), ["origin", "id"], "left").withColumn("expanded", F.col("expanded") | F.coalesce("now", F.lit(False))).drop("now")
            both = done.unionByName(met.withColumn("expanded", F.lit(False)))
            # a node that is found again nearer is expanded at that distance; it was admitted when it was found first
            merged = both.groupBy("origin", "id").agg(F.min("distance").alias("distance"), F.min("seq").alias("seq"), F.max("expanded").alias("expanded"))
            place = F.row_number().over(W.partitionBy("origin").orderBy("seq", "id"))
            known = cut(merged.withColumn("place", place).where(F.col("place") <= states).drop("place"))
            step += 1
        frontier, n = counted(known.where(~F.col("expanded") & (F.col("distance") == level)).select("origin", "id"))
        if not n:
            level += 1
            frontier, n = counted(known.where(~F.col("expanded") & (F.col("distance") == level)).select("origin", "id")) if level <= depth else (frontier, 0)
    empty = seeds.sparkSession.createDataFrame([], "origin string, step int, pos int, dst long, src long, src_file string, distance int")
    return seeds, trace if trace is not None else empty


def budgeted(nodes: DataFrame, edges: DataFrame, origins: DataFrame, depth: int = 2, states: int = STATES, examinations: int = EXAMINATIONS) -> tuple[DataFrame, DataFrame]:
    """(origin, states, edges, files, status, finding, reasons) of each origin, and (origin, file, distance) of what it affects. origins: origin, file; a request's bounded list.

    Origins spend the budgets one after the other, in order of name. An origin admits states (nodes, its own first) while there are any left and examines the edges of what it
    admitted, step by step; edges that are left unexamined or nodes that are not admitted make it traversal_work_limit. A consumer beyond the depth that was seen nowhere within it makes
    it depth_limit; reaching the depth alone does not. An origin that could not begin is not_evaluated. An origin without a node is source_unavailable.
    """
    seeds, trace = _trace(nodes, edges, origins, depth, states, examinations)
    trace = cut(trace)
    first = F.struct("step", "pos")
    rows, kept_parts = [], []
    left_states, left_edges = states, examinations
    names = [r.origin for r in origins.select("origin").distinct().orderBy("origin").collect()]  # a request's
    for name in names:
        own, steps = seeds.where(F.col("origin") == name), trace.where(F.col("origin") == name)
        total = own.count()
        if not total:
            rows.append((name, 0, 0, 0, "partial", "not_evaluated", "source_unavailable"))
            continue
        admitted_seeds = own.where(F.col("pos") <= left_states).select("id", F.struct(F.lit(0).alias("step"), F.col("pos").cast("int").alias("pos")).alias("first"))
        inner = steps.where(F.col("distance") <= depth).groupBy(F.col("src").alias("id")).agg(F.min(first).alias("first"))
        # in order of discovery: its own nodes, then consumers as their first edge comes up
        found = admitted_seeds.unionByName(inner.join(own.select("id"), "id", "left_anti"))
        admitted = found.orderBy("first", "id").limit(left_states)
        mine = steps.join(F.broadcast(admitted.select(F.col("id").alias("dst"))), "dst", "left_semi")  # `states` at most
        examined, n_edges = counted(mine.orderBy("step", "pos").limit(left_edges))
        more = n_edges == left_edges and mine.count() > n_edges
        reached = examined.where(F.col("distance") <= depth).select(F.col("src").alias("id"), F.struct("step", "pos").alias("first"))
        reached = cut(reached.groupBy("id").agg(F.min("first").alias("first")).join(own.select("id"), "id", "left_anti"))
        n_seeds, n_reached = min(total, left_states), reached.count()
        n_states = min(left_states, n_seeds + n_reached)
        observed = reached.select("id").unionByName(own.where(F.col("pos") <= left_states).select("id"))
        beyond = bool(examined.where(F.col("distance") > depth).join(observed.withColumnRenamed("id", "src"), "src", "left_anti").head(1))
        files = examined.where((F.col("distance") <= depth) & ((F.col("src_file") != name) | (F.col("distance") == 0)))
        files = cut(files.groupBy(F.lit(name).alias("origin"), F.col("src_file").alias("file")).agg(F.min("distance").alias("distance")))
        n_files = files.count()
        short = more or total > left_states or n_seeds + n_reached > left_states
        unstarted = not n_seeds or (not n_edges and not left_edges and bool(mine.head(1)))
        reasons = [r for r, on in ((DEPTH_LIMIT, beyond), (WORK_LIMIT, short)) if on]
        finding = "evidence_found" if n_files else "not_evaluated" if unstarted else "no_evidence_found"
        rows.append((name, n_states, n_edges, n_files, "partial" if reasons else "available", finding, ";".join(reasons)))
        kept_parts.append(files)
        left_states, left_edges = left_states - n_states, left_edges - n_edges
    spark = seeds.sparkSession
    answers = spark.createDataFrame(rows, "origin string, states long, edges long, files long, status string, finding string, reasons string")
    kept = spark.createDataFrame([], "origin string, file string, distance int")
    for part in kept_parts:
        kept = kept.unionByName(part)
    return answers, kept
