"""Bounded views of a graph: the explorer's admission of edges and nodes, contexts, isolated neighbourhoods, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

# Fixed values of the explorer: the rank of a node's category; others come last.
CATEGORY_RANK = {
    "controller": 0, "api": 0, "service": 1, "handler": 1, "application": 1, "interface": 2, "domain": 3, "repository": 4, "database": 4, "infrastructure": 4,
    "contract": 5, "enum": 5, "middleware": 6, "extension": 6, "unknown": 7,
}
_OTHERS = 99


def category_rank(category: Column) -> Column:
    out = F.lit(_OTHERS)
    for name, rank in CATEGORY_RANK.items():
        out = F.when(category == name, rank).otherwise(out)
    return out


def by_priority(nodes: DataFrame, limit: int) -> DataFrame:
    """The first nodes by category rank, file, label, kind and id."""
    return nodes.withColumn("rank", category_rank(F.col("category"))).orderBy("rank", "file", "label", "kind", "id").limit(limit)


def admitted(nodes: DataFrame, edges: DataFrame, node_limit: int = 500, edge_limit: int = 1200) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, relation, score) admitted in the order of their score while their ends fit into node_limit, up to edge_limit; and the ids of nodes: the ends, then
    nodes by priority.

    The admission is sequential, but its state is bounded by the limits: the driver takes the first edges, at most edge_limit + 1 at a time, that can still be admitted: any
    edge while two nodes fit, then edges with an end among those admitted, then edges with both.
    """
    spark = nodes.sparkSession
    known = nodes.select("id", "label")
    order = ["score", "src", "dst", "relation"]
    rows = edges.join(known.toDF("src", "src_label"), "src").join(known.toDF("dst", "dst_label"), "dst")
    rows = rows.select("src", "dst", "relation", graph.edge_score(F.col("relation"), F.col("src_label"), F.col("dst_label")).alias("score"))
    inside: dict = {}
    chosen: list[tuple] = []
    last: tuple | None = None
    while len(chosen) < edge_limit:
        room = node_limit - len(inside)
        todo = rows
        if last is not None:
            todo = todo.where(F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True)]))
        if room < 2:
            ids = F.broadcast(spark.createDataFrame([(k,) for k in inside], "id long"))  # node_limit rows
            src, dst = ids.select(F.col("id").alias("src"), F.lit(1).alias("a")), ids.select(F.col("id").alias("dst"), F.lit(1).alias("b"))
            todo = todo.join(src, "src", "left").join(dst, "dst", "left").where("a = 1 or b = 1" if room == 1 else "a = 1 and b = 1")
        head = todo.orderBy(*order).limit(edge_limit + 1).select(*order).collect()
        for r in head:
            new = {r.src, r.dst} - inside.keys()
            last = tuple(r)
            if len(inside) + len(new) <= node_limit:
                inside |= dict.fromkeys(sorted(new))
                chosen.append((r.src, r.dst, r.relation, r.score))
                if len(chosen) == edge_limit or node_limit - len(inside) < min(room, 2):
                    break
        else:
            if len(head) <= edge_limit:
                break
    for r in by_priority(nodes, node_limit).select("id").collect():  # node_limit rows
        if len(inside) >= node_limit:
            break
        inside.setdefault(r.id)
    return spark.createDataFrame([(k,) for k in inside], "id long"), spark.createDataFrame(chosen, "src long, dst long, relation string, score int")


def resolve_target(nodes: DataFrame, text: str) -> DataFrame:
    """The node that a text means: the first by id whose label is or contains it, in lower case, or whose id is it."""
    low = F.lower("label")
    return nodes.where((low == text.lower()) | low.contains(text.lower()) | (F.col("id").cast("string") == text)).orderBy("id").limit(1)


def context(nodes: DataFrame, edges: DataFrame, origin: int, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, role) and edges of a compact context: the target, the other ends of at most `limit` edges each way, and nodes of its file up to the limit."""
    out = edges.where(F.col("src") == origin).orderBy("dst", "relation").limit(limit).select(
        F.col("dst").alias("id"), F.lit("dependency").alias("role"), F.lit(1).alias("r")
    )
    into = edges.where(F.col("dst") == origin).orderBy("src", "relation").limit(limit).select(
        F.col("src").alias("id"), F.lit("dependent").alias("role"), F.lit(2).alias("r")
    )
    one = nodes.where(F.col("id") == origin)
    near = one.select("id", F.lit("target").alias("role"), F.lit(0).alias("r")).unionByName(out).unionByName(into)
    near = near.groupBy("id").agg(F.min_by("role", "r").alias("role"), F.min("r").alias("r"))
    same = nodes.join(F.broadcast(one.select("file")), "file", "left_semi").join(near.select("id"), "id", "left_anti").orderBy("id").limit(limit)
    rows = near.unionByName(same.select("id", F.lit("same_file").alias("role"), F.lit(3).alias("r"))).orderBy("r", "id").limit(limit)
    shown = nodes.join(F.broadcast(rows), "id").select("id", "label", "role")
    return shown, graph.induced(edges, shown.select("id")).distinct().orderBy("src", "dst", "relation").limit(limit)


def isolated(nodes: DataFrame, edges: DataFrame, origin: int) -> tuple[DataFrame, DataFrame]:
    """The closed neighbourhood of a node: itself, its neighbours, and the edges at it."""
    touching = edges.where((F.col("src") == origin) | (F.col("dst") == origin)).select("src", "dst", "relation")
    ids = touching.select(F.explode(F.array("src", "dst")).alias("id")).union(nodes.where(F.col("id") == origin).select("id")).distinct()
    return nodes.join(F.broadcast(ids), "id", "left_semi"), touching


def visible(
    nodes: DataFrame, edges: DataFrame, categories: list[str], layers: list[str], features: list[str], hide_isolated: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Nodes of the ticked categories, layers and features (an empty list ticks none) and edges with both ends among them; nodes without such an edge may be hidden."""
    kept = nodes.where(F.col("category").isin(categories) & F.col("layer").isin(layers) & F.col("feature").isin(features))
    inside = graph.induced(edges, kept.select("id"))
    if hide_isolated:
        kept = kept.join(inside.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    return kept, inside
