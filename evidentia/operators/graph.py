"""Aggregates and traversals over nodes (id, label, kind, file, feature, layer) and edges (src, dst, relation).

An edge src -> dst says that src depends on dst; reverse traversals go from dst to src. Traversals are loops over levels: the driver holds only row
counts, a level is a join of the edges with the frontier (broadcast while small), de-duplicated before the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .durable import counted, cut


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, total): both ends in one aggregation with partial sums, without a join."""
    ends = edges.select(F.inline(
        F.array(
            F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
        )
    ))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("total", F.col("in_degree") + F.col("out_degree"))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """The `limit` nodes of the largest total degree, ties by id."""
    top = degrees(edges).orderBy(F.desc("total"), "id").limit(limit)
    return nodes.join(F.broadcast(top), "id").select("id", "label", "in_degree", "out_degree", "total")


def modules(nodes: DataFrame) -> DataFrame:
    """(module, nodes): counts by feature, else layer, else file, else 'unknown'."""
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("feature", "layer", "file")], F.lit("unknown"))
    return nodes.groupBy(key.alias("module")).agg(F.count("*").alias("nodes"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_anti").select("id", "label")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, distinct files and features (empty ones don't count)."""
    a = nodes.agg(
        F.count("*").alias("nodes"), F.countDistinct(F.nullif("file", F.lit(""))).alias("files"),
        F.countDistinct(F.nullif("feature", F.lit(""))).alias("features")
    )
    return a.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def reciprocal(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs with edges both ways. One aggregation over unordered pairs, no self-join."""
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.agg(F.max(F.col("src") < F.col("dst")).alias("up"), F.max(F.col("src") > F.col("dst")).alias("down")).where("up and down").select("a", "b")


def filtered(nodes: DataFrame, edges: DataFrame, layers: list[str] = (), features: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes of the layers and features (an empty list admits all, the sentinel '__none__' nothing) and edges with both ends among them."""
    kept = nodes
    for name, wanted in (("layer", layers), ("feature", features)):
        if "__none__" in wanted:
            kept = kept.where(F.lit(False))
        elif wanted:
            kept = kept.where(F.col(name).isin(list(wanted)))
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside.select("src", "dst", "relation")


def edge_score(relation: Column, src: Column, dst: Column) -> Column:
    """Lower comes first: used types, then references, known suffixes of the source; tests last."""
    bonus = F.when(relation == "uses", -10).when(relation == "references", -3).otherwise(0)
    for part, points in (("Controller", -6), ("Service", -5), ("Handler", -4), ("Repository", -3), (".Tests", 20)):
        bonus = bonus + F.when(src.contains(part), points).otherwise(0)
    return bonus + F.when(dst.contains(".Tests"), 20).otherwise(0)


def prioritized(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """The first `limit` edges by score, with the ends' labels; ties by ids and relation."""
    n = nodes.select("id", "label")
    rows = edges.join(n.toDF("src", "src_label"), "src").join(n.toDF("dst", "dst_label"), "dst")
    rows = rows.withColumn("score", edge_score(F.col("relation"), F.col("src_label"), F.col("dst_label")))
    return rows.orderBy("score", "src", "dst", "relation").limit(limit).select("src", "dst", "relation", "score")


def expand(nodes: DataFrame, edges: DataFrame, origin: int, out_cap: int = 14, in_cap: int = 22) -> DataFrame:
    """Neighbours of a node: (direction, neighbour, label, relation), capped for each direction by relation and id."""
    out = edges.where(F.col("src") == origin).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "relation")
    into = edges.where(F.col("dst") == origin).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "relation")
    near = out.orderBy("relation", "id").limit(out_cap).unionByName(into.orderBy("relation", "id").limit(in_cap))
    return nodes.join(F.broadcast(near), "id").select("direction", "id", "label", "relation")


def reverse_reach(edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """(origin, id, depth): nodes that depend on an origin over 1 to `depth` edges, at their least depth; origins: origin, id."""
    steps = cut(edges.select("src", "dst").where("src <> dst").distinct())
    frontier, n = counted(origins.select("origin", "id").distinct())
    seen = frontier.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        step = steps.join(frontier.withColumnRenamed("id", "dst"), "dst").select("origin", F.col("src").alias("id")).distinct()
        frontier, n = counted(step.join(seen, ["origin", "id"], "left_anti"))
        if not n:
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
        if level % 3 == 0:
            seen = cut(seen)
    return seen.where("depth > 0")


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, src_file, cost): different edges between nodes, written once; cost 1 between files."""
    of = nodes.select("id", "file")
    once = edges.select("src", "dst").where("src <> dst").distinct()
    ends = once.join(of.toDF("src", "src_file"), "src").join(of.toDF("dst", "dst_file"), "dst")
    return cut(ends.select("src", "dst", "src_file", (F.col("src_file") != F.col("dst_file")).cast("int").alias("cost")))


def distances(nodes: DataFrame, edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """(origin, id, file, distance): least numbers of file changes on reverse paths from an origin file, up to `depth`.

    origins: origin, file; every node of that file starts at 0. A hop within a file costs 0, between files 1. A level first closes
    over hops of cost 0, then takes one of cost 1.
    """
    return _distances(nodes, _ends(nodes, edges), origins, depth).join(nodes.select("id", "file"), "id").select("origin", "id", "file", "distance")


class _Parts:
    """Rows kept as the files of a few steps: a step adds its own without writing the others again, and every `most` steps they are made one."""

    def __init__(self, df: DataFrame, most: int = 6) -> None:
        self.rows, self._n, self._most = df, 1, most

    def add(self, df: DataFrame) -> None:
        self.rows, self._n = self.rows.unionByName(df), self._n + 1
        if self._n >= self._most:
            self.rows, self._n = cut(self.rows), 1


def _distances(nodes: DataFrame, ends: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """(origin, id, distance) of what is reached, as the files of at most a few steps."""
    frontier, n = counted(origins.join(nodes.select("id", "file"), "file").select("origin", "id").distinct())
    seen = _Parts(frontier.withColumn("distance", F.lit(0)))
    inner = bool(ends.where("cost = 0").head(1))
    level = 0
    while n:
        fresh, reached = frontier, _Parts(frontier)
        while inner:  # hops within files
            near = ends.where("cost = 0").join(fresh.withColumnRenamed("id", "dst"), "dst").select("origin", F.col("src").alias("id")).distinct()
            fresh, n = counted(near.join(seen.rows, ["origin", "id"], "left_anti"))
            if not n:
                break
            reached.add(fresh)
            seen.add(fresh.withColumn("distance", F.lit(level)))
        level += 1
        if level > depth:
            break
        far = ends.where("cost = 1").join(reached.rows.withColumnRenamed("id", "dst"), "dst").select("origin", F.col("src").alias("id")).distinct()
        frontier, n = counted(far.join(seen.rows, ["origin", "id"], "left_anti"))
        seen.add(frontier.withColumn("distance", F.lit(level)))
    return seen.rows


def file_impact(nodes: DataFrame, edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """(origin, file, distance, witness_src, witness_dst): affected files at their least distance with the least edge that shows it.

    A witness is an edge whose consumer is at the file's distance and whose dependency is as far as the edge's cost before it. The origin's own file is left
    out; files are those of other nodes reached.
    """
    ends = _ends(nodes, edges)
    seen = _distances(nodes, ends, origins, depth)
    left = seen.select("origin", F.col("id").alias("src"), F.col("distance").alias("at"))
    right = seen.select("origin", F.col("id").alias("dst"), F.col("distance").alias("before"))
    shown = ends.join(left, "src").join(right, ["origin", "dst"]).where("at = before + cost and src_file <> origin")
    # every node that is reached over an edge has such a witness, so a file's least distance is that of its witnesses
    best = shown.groupBy("origin", F.col("src_file").alias("file")).agg(F.min(F.struct(F.col("at").alias("distance"), "src", "dst")).alias("w"))
    return best.select("origin", "file", "w.distance", F.col("w.src").alias("witness_src"), F.col("w.dst").alias("witness_dst"))


def merge_origins(impact: DataFrame, keep: int = 8) -> DataFrame:
    """One row per file: its least distance, how many origins reach it, and the nearest `keep` of them by distance and name."""
    ranked = impact.withColumn("rank", F.row_number().over(W.partitionBy("file").orderBy("distance", "origin")))
    agg = ranked.groupBy("file").agg(
        F.min("distance").alias("distance"), F.count("*").alias("origins"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= keep, F.struct("distance", "origin")))).alias("near")
    )
    return agg.select("file", "distance", "origins", F.array_join(F.transform("near", lambda x: x["origin"]), ";").alias("nearest"))


def impact_score(nodes: DataFrame, edges: DataFrame, origin: int, depth: int = 2, limit: int = 80) -> DataFrame:
    """One row: dependents, transitive ones, affected files, and the score with its level.

    Dependents are counted by edge, the first `limit` by id and relation; transitive ones by node, the first `limit` by depth and id. Affected are the files of the target
    and of both; a node without a file counts as one of its own.
    """
    one = edges.sparkSession.createDataFrame([(origin, origin)], T.StructType().add("origin", "long").add("id", "long"))
    known = nodes.select("id", F.coalesce(F.nullif("file", F.lit("")), F.col("id").cast("string")).alias("file"))
    direct = edges.where(F.col("dst") == origin).select(F.col("src").alias("id"), "relation").orderBy("id", "relation").limit(limit)
    far = reverse_reach(edges, one, depth).orderBy("depth", "id").limit(limit)
    role = lambda df, name: known.join(F.broadcast(df.select("id")), "id").withColumn("role", F.lit(name))  # noqa: E731  limit rows
    seen = role(direct, "direct").unionByName(role(far, "far")).unionByName(known.where(F.col("id") == origin).withColumn("role", F.lit("target")))
    of = lambda name: F.sum((F.col("role") == name).cast("long"))
    row = seen.agg(of("direct").alias("direct"), of("far").alias("transitive"), F.countDistinct("file").alias("affected_files"))
    score = F.col("direct") + F.col("transitive") + F.least("affected_files", F.lit(20))
    return row.withColumn("score", score).withColumn("level", impact_level(F.col("score")))


def impact_level(score: Column) -> Column:
    return F.when(score >= 30, "high").when(score >= 10, "medium").when(score > 0, "low").otherwise("isolated")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst", "relation")


def context(nodes: DataFrame, edges: DataFrame, origin: int) -> DataFrame:
    """Edges of the subgraph of a node, its neighbours and the other nodes of its file."""
    file = nodes.where(F.col("id") == origin).select("file")
    same = nodes.join(F.broadcast(file), "file", "left_semi").select("id")
    near = edges.where((F.col("src") == origin) | (F.col("dst") == origin)).select(F.explode(F.array("src", "dst")).alias("id"))
    return induced(edges, same.union(near).distinct())


def closure_of_references(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that touch a seed, once each by ends and relation."""
    a = edges.join(seeds.toDF("src"), "src", "left_semi").select("src", "dst", "relation")
    return a.unionByName(edges.join(seeds.toDF("dst"), "dst", "left_semi").select("src", "dst", "relation")).distinct()


def normalized(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges once each, and those that name a node that isn't there (empty in a sound graph)."""
    once = edges.dropDuplicates(["src", "dst", "relation"])
    ids = nodes.select("id")
    bad = once.join(ids.toDF("src"), "src", "left_anti").unionByName(once.join(ids.toDF("dst"), "dst", "left_anti"), allowMissingColumns=True)
    return once, bad.select("src", "dst", "relation").distinct()


def _jumped(only: DataFrame) -> DataFrame:
    """(id, end): where chains of nodes with one dependency each lead: the first node that is none of them. Chains of any length by path doubling, in a logarithmic number of rounds.

    only: id, next. Nodes on a circle of such nodes lead nowhere and are left out.
    """
    now, n = counted(only.select("id", F.col("next").alias("end")))
    bits = max(1, n).bit_length() + 1  # after that many doublings only circles are left
    for _ in range(bits):
        ahead = now.select(F.col("id").alias("end"), F.col("end").alias("further"))
        moved = now.join(ahead, "end", "left").select("id", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("open"))
        now = cut(moved)
        if not now.where("open").head(1):
            break
        now = now.drop("open")
    return now.join(only.select(F.col("id").alias("end")), "end", "left_anti").select("id", "end")


def reachable_importers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id): everything that depends on a target over any number of edges; targets: target, id. Circles end, a target is no importer of itself.

    Nodes that nothing leads on from and that are no target are of no use to a path, nodes with a single dependency lie on a chain: chains are condensed to one edge by path doubling, so their
    length costs a logarithmic number of rounds, and only the branching rest is searched level by level, each level from what the last one found. At the end chain nodes take the answer of the node
    that their chain leads to, and those before a target on a chain are found by the doubling itself, as a target always ends a chain.
    """
    steps = edges.select("src", "dst").where("src <> dst").distinct()
    steps = cut(steps)
    aims = cut(targets.select("target", "id").distinct())
    out = steps.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("next")).where("n = 1")
    only = cut(out.join(aims.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select(F.col("src").alias("id"), "next"))
    ends = cut(_jumped(only))
    # edges of the branching nodes, each on to where a chain leads
    rest = steps.join(only.select(F.col("id").alias("src")), "src", "left_anti")
    direct = rest.join(only.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    over = rest.join(ends.withColumnRenamed("id", "dst"), "dst").select("src", F.col("end").alias("dst"))
    short = cut(direct.unionByName(over).where("src <> dst").distinct())
    frontier, n = counted(aims)
    seen, level = frontier, 0
    while n:
        step = short.join(frontier.withColumnRenamed("id", "dst"), "dst").select("target", F.col("src").alias("id")).distinct()
        frontier, n = counted(step.join(seen, ["target", "id"], "left_anti"))
        seen, level = seen.unionByName(frontier), level + 1
        if level % 3 == 0:
            seen = cut(seen)
    seen = cut(seen)
    chained = ends.join(seen.withColumnRenamed("id", "end"), "end").select("target", "id")
    return seen.unionByName(chained).distinct().join(aims, ["target", "id"], "left_anti")
