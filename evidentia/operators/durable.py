"""Cutting lineage so that lost executors cost one step at most."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows up to which a counted frontier is broadcast, some 10 MB.
FRONTIER_ROWS = 100_000


def shared_dir(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is set, as in tests."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again: later steps scan files, prune columns, and know their size."""
    path = f"{shared_dir(df)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df cut, with its row count (from the files' footers), and with a broadcast hint where the count is small."""
    df = cut(df)
    n = df.count()
    return (F.broadcast(df) if n <= FRONTIER_ROWS else df), n
