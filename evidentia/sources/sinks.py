"""Sinks: versioned registries, capture logs and manifests."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LOG


def publish(df: DataFrame, folder: str) -> str:
    """Write a new version of a table and return its path; readers of older versions are not disturbed."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def replace_json(path: str, value: object) -> None:
    """Write a small JSON file on the driver's side by a rename, so readers see the old or the new one, whole."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "x", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def append_capture(records: DataFrame, folder: str) -> DataFrame:
    """Append capture records as JSON lines, with exactly the six keys, and return counts."""
    rows = records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG])
    rows.write.mode("append").option("ignoreNullFields", False).json(folder)
    return rows.agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.size("writePaths")), F.lit(0)).alias("write_entries"),
        F.coalesce(F.sum(F.size("watchPaths")), F.lit(0)).alias("watch_entries")
    )


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, byte_size) of binary files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_size"))
