"""Impact of changed files: witnesses, budgets, affected tests, coverage and the composed answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import graph, scope


_LOCATION = "struct<path:string,line:bigint,column:bigint>"


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def witness_id(snapshot: Column, provider: Column, version: Column, edge: Column) -> Column:
    """Name of an edge witness: sha256 over the canonical JSON of snapshot, provider, version and edge (from, to, relation, location)."""
    head = F.concat_ws(",", *map(_quoted, (snapshot, provider, version)))
    return F.concat(F.lit("impact_edge_"), F.sha2(F.concat(F.lit("["), head, F.lit(","), F.to_json(edge, {"ignoreNullFields": "false"}), F.lit("]")), 256))


def with_witnesses(impact: DataFrame, nodes: DataFrame, edges: DataFrame, snapshot: str, provider: str = "native", version: str = "1", kind: str = "native") -> DataFrame:
    """impact (origin, file, distance, witness_src, witness_dst) with the witness's relation, location, id, source (the file it is seen in), capability, basis and trust.

    edges may have a location (path, line, column) of where they are written; without one the witness is seen in the affected file. Of several edges between a witness's ends the one with
    the least relation counts, then the least location. Imports are structural dependencies, other relations semantic references. What a provider of kind external says is untrusted.
    """
    there = F.col("location").cast(_LOCATION) if "location" in edges.columns else F.lit(None).cast(_LOCATION)
    least = edges.select("src", "dst", "relation", there.alias("location")).groupBy(F.col("src").alias("witness_src"), F.col("dst").alias("witness_dst")).agg(
        F.min(F.struct("relation", "location")).alias("edge")
    )
    shown = impact.join(least, ["witness_src", "witness_dst"]).select(*impact.columns, "edge.relation", "edge.location")
    edge = F.struct(F.col("witness_src").cast("string").alias("from"), F.col("witness_dst").cast("string").alias("to"), "relation", "location")
    imports = F.col("relation") == "imports"
    return shown.withColumns({
        "witness": witness_id(F.lit(snapshot), F.lit(provider), F.lit(version), edge), "source": F.coalesce("location.path", "file"),
        "capability": F.when(imports, "dependencies").otherwise("references"), "basis": F.when(imports, "structural").otherwise("semantic"),
        "trust": F.lit("untrusted_external_analysis" if kind == "external" else "derived_analysis")
    })


def unsound_locations(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The edges whose location is no place in the text of a file (path, text): an unknown file, a line beyond its last one, or a column more than one beyond the line's end.

    Lines end at a line feed, with or without a carriage return; columns count UTF-16 code units. Only the lines' lengths meet the edges, never the texts.
    """
    at = edges.where("location is not null")
    wanted = files.join(at.select(F.col("location.path").alias("path")).distinct(), "path", "left_semi")
    width = lambda line: (F.octet_length(F.encode(line, "UTF-16BE")) / 2).cast("long")
    lines = wanted.select(F.col("path").alias("_path"), F.posexplode(F.split("text", "\r?\n", -1)).alias("_n", "_text"))
    lines = lines.select("_path", (F.col("_n") + 1).cast("long").alias("_line"), width(F.col("_text")).alias("_width"))
    place = (F.col("location.path") == F.col("_path")) & (F.col("location.line") == F.col("_line")) & F.col("location.column").between(1, F.col("_width") + 1)
    return at.join(lines, place, "left_anti")


def affected(witnessed: DataFrame, keep: int = 8) -> DataFrame:
    """(file, distance, origins, near, cut): one row for each affected file: least distance, how many origins reach it, the nearest `keep` of them by distance, name and
    witness, and whether some were left out.
    """
    rank = F.row_number().over(W.partitionBy("file").orderBy("distance", "origin", "witness"))
    rows = witnessed.withColumn("rank", rank)
    near = F.array_sort(F.collect_list(F.when(F.col("rank") <= keep, F.struct("distance", "origin", "witness"))))  # keep at most
    return rows.groupBy("file").agg(F.min("distance").alias("distance"), F.count("*").alias("origins"), near.alias("near"), (F.count("*") > keep).alias("cut"))


def ordered(items: DataFrame) -> DataFrame:
    """Affected items with their place by distance, path and first witness."""
    first = F.get("near", F.lit(0))["witness"]
    return items.withColumn("place", F.row_number().over(W.orderBy("distance", "file", first)))


def within_witnesses(items: DataFrame, budget: int, limit: int = 1 << 30, most: int = 4096) -> DataFrame:
    """The longest head of the order in which the retained witnesses stay within the budget, at most `limit` items.

    A budget bounds the head's length (each item keeps a witness at least), so only that many items meet in one task.
    """
    first = F.get("near", F.lit(0))["witness"]
    head = items.orderBy("distance", "file", first).limit(min(budget + 1, limit, most))
    total = F.sum(F.size("near")).over(W.orderBy("distance", "file", first).rowsBetween(W.unboundedPreceding, 0))
    return ordered(head.withColumn("running", total).where(F.col("running") <= budget))


def affected_tests(items: DataFrame, budget: int, limit: int = 80) -> DataFrame:
    """Affected files that are tests by their path, in order, within the witnesses that the files left over."""
    return within_witnesses(items.where(scope.is_test(F.col("file"))), budget, limit)


def origin_status(origins: DataFrame, nodes: DataFrame, witnessed: DataFrame, kept: DataFrame, traversal: DataFrame | None = None) -> DataFrame:
    """(origin, status, finding, reasons) of each origin: unavailable where it has no node, partial where a retained list left some of its items out or its traversal was cut short.

    traversal: (origin, reasons) as budget.budgeted() gives them: depth_limit, traversal_work_limit.
    """
    known = origins.join(nodes.select("file").distinct(), "file", "left_semi").select("origin").withColumn("known", F.lit(True))
    found = witnessed.groupBy("origin").agg(F.count("*").alias("found"))
    shown = kept.select(F.explode("near").alias("w")).groupBy(F.col("w.origin").alias("origin")).agg(F.count("*").alias("shown"))
    rows = origins.select("origin").join(known, "origin", "left").join(found, "origin", "left").join(shown, "origin", "left")
    left = F.coalesce("found", F.lit(0)) > F.coalesce("shown", F.lit(0))
    rows = rows.join(traversal.select("origin", F.col("reasons").alias("cut_short")), "origin", "left") if traversal is not None else rows.withColumn("cut_short", F.lit(""))
    both = F.array_sort(F.filter(F.array_append(F.split(F.coalesce("cut_short", F.lit("")), ";"), F.when(left, "output_limit").otherwise("")), lambda r: r != ""))
    reasons = F.when(F.col("known").isNull(), "source_unavailable").otherwise(F.array_join(both, ";"))
    status = F.when(F.col("known").isNull(), "unavailable").when(F.size(both) > 0, "partial").otherwise("available")
    finding = F.when(F.col("known").isNull(), "not_evaluated").when(F.col("found") > 0, "evidence_found").otherwise("no_evidence_found")
    return rows.select("origin", status.alias("status"), finding.alias("finding"), reasons.alias("reasons"))


def project_impact(
    nodes: DataFrame, edges: DataFrame, origins: DataFrame, depth: int = 2, snapshot: str = "", witnesses: int = 256, limit: int = 100, keep: int = 8, traversal: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The parts of an impact answer: files (place, file, distance, origins, cut), tests likewise, and the status of each origin, with the reasons of a budgeted traversal if one is given."""
    witnessed = with_witnesses(graph.file_impact(nodes, edges, origins, depth), nodes, edges, snapshot)
    items = affected(witnessed, keep)
    files = within_witnesses(items, witnesses, limit)
    spent = files.agg(F.coalesce(F.sum(F.size("near")), F.lit(0))).first()[0]
    tests = affected_tests(files.drop("place", "running"), witnesses - spent, limit)
    return {"files": files, "tests": tests, "origins": origin_status(origins, nodes, witnessed, files, traversal)}


def coverage(observed: DataFrame, provider_languages: DataFrame) -> DataFrame:
    """(language, state): observed languages as covered or uncovered by a provider; each is in exactly one part."""
    known = provider_languages.select("language").distinct().withColumn("k", F.lit(True))
    return observed.select("language").distinct().join(known, "language", "left").select("language", F.when(F.col("k"), "covered").otherwise("uncovered").alias("state"))
