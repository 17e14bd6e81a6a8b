"""Excerpts and declared constraints of a context pack, within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import texts
from .durable import cut
from .ordered import placed

#: Fixed values of an excerpt: lines of a window and bytes of its text.
LINES, BYTES = 12, 512
# Fixed values of the constraints: the permissions that a workspace may declare, the form of a precondition, how many are shown, how many are allowed.
PERMISSIONS = ("read", "write", "executeCommands", "createAgents")
PRECONDITION = r"^[a-z0-9][a-z0-9._:-]{0,99}$"
SHOWN, ALLOWED = 8, 100


def excerpt(text: Column) -> Column:
    """A text's first window: struct (text, start_line, end_line, truncated): at most LINES lines and BYTES bytes, secrets taken out, whole characters. Lines end at \\n or \\r\\n."""
    lines = F.split(text, "\r?\n", -1)
    value = texts.bounded(F.array_join(F.slice(lines, 1, LINES), "\n"), BYTES)
    shown = F.least(F.lit(LINES), F.size(F.split(value, "\n", -1)))
    cut_off = (F.size(lines) > LINES) | (F.octet_length(value) < F.octet_length(text))
    return F.struct(value.alias("text"), F.lit(1).alias("start_line"), shown.alias("end_line"), cut_off.alias("truncated"))


def windows(files: DataFrame) -> DataFrame:
    """(path, part, start_line, end_line, text, bytes): whole files (path, text) in windows of whole lines, at most LINES lines and, but for a single longer line, BYTES bytes each.

    A window ends at its LINES-th line; within it a line that does not fit begins the next part. The running byte sums are of one file's lines, up to LINES at a time.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "line"))
    lines = lines.withColumns({"block": F.floor(F.col("n") / LINES), "size": F.octet_length("line") + 1})
    item = F.struct(F.col("n").alias("n"), F.col("line").alias("line"), F.col("size").alias("size"))
    blocks = lines.groupBy("path", "block").agg(F.array_sort(F.collect_list(item)).alias("l"))  # LINES at most
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("parts"))
    # the part of each line: a new one where the sum, without the last line break, passes the budget
    over = lambda a, x: (a["sum"] > 0) & (a["sum"] + x["size"] - 1 > BYTES)
    parts = F.aggregate("l", start, lambda a, x: F.struct(
        F.when(over(a, x), x["size"]).otherwise(a["sum"] + x["size"]).alias("sum"), (a["part"] + over(a, x).cast("int")).alias("part"),
        F.array_append(a["parts"], a["part"] + over(a, x).cast("int")).alias("parts")
    ))["parts"]
    rows = blocks.withColumn("p", parts).select("path", "block", F.explode(F.arrays_zip("l", "p")).alias("x"))
    cutting = rows.groupBy("path", "block", F.col("x.p").alias("p")).agg(F.array_sort(F.collect_list("x.l")).alias("l"))
    made = cutting.select(
        "path", (F.col("l")[0]["n"] + 1).alias("start_line"), (F.element_at("l", -1)["n"] + 1).alias("end_line"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")
    )
    part = F.row_number().over(W.partitionBy("path").orderBy("start_line"))
    return made.select("path", part.cast("int").alias("part"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "text", F.octet_length("text").cast("long").alias("bytes"))


def within_bytes(rows: DataFrame, order: list[str], most: int, text: str = "text") -> DataFrame:
    """rows in order as long as their texts' bytes, added up over all of them, stay within the budget; with place (from 0) and running (the sum so far). The first that does not fit ends it."""
    return placed(rows, order, amount=F.octet_length(text)).where(F.col("running") <= most)


def sectioned(sections: dict[str, DataFrame], most: int) -> DataFrame:
    """(section, path, text, start_line, end_line, truncated, place, running): excerpts of the files (path, text) of each section, in the sections' order and by path, within one budget of bytes."""
    every = None
    for rank, (name, files) in enumerate(sections.items()):
        mine = files.select(F.lit(rank).alias("rank"), F.lit(name).alias("section"), "path", excerpt(F.col("text")).alias("e")).select("rank", "section", "path", "e.*")
        every = mine if every is None else every.unionByName(mine)
    return within_bytes(cut(every), ["rank", "path"], most).drop("rank")


def constraints(workspaces: DataFrame) -> DataFrame:
    """(id, permissions, preconditions, truncated, refused): what workspaces (id, permissions map<string,boolean>, preconditions array<string>) declare; only declared, nothing is inferred.

    Permissions are those known by name that are set. Preconditions are the sound ones, once each, in order, the first SHOWN; a workspace with more than ALLOWED is refused.
    """
    known = F.map_filter(F.coalesce("permissions", F.create_map().cast("map<string,boolean>")), lambda k, v: k.isin(*PERMISSIONS) & v.isNotNull())
    sound = F.array_sort(F.array_distinct(F.filter(F.coalesce("preconditions", F.array().cast("array<string>")), lambda p: F.coalesce(p.rlike(PRECONDITION), F.lit(False)))))
    refused = F.coalesce(F.size("preconditions") > ALLOWED, F.lit(False))
    return workspaces.select("id", known.alias("permissions"), F.slice(sound, 1, SHOWN).alias("preconditions"), (F.size(sound) > SHOWN).alias("truncated"), refused.alias("refused"))
