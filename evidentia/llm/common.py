"""What the operators of this subpackage share: tables, durable intermediates, checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of data up to which a table is broadcast; Spark's hashed form takes some three times as much.
BROADCAST_BYTES = 16 << 20
#: Bytes of text that a Python worker turns into Python objects at a time.
SLICE_BYTES = 1 << 20
#: Bytes of a batch on its way between the JVM and Python, of which either side holds several.
BATCH_BYTES = 4 << 20
#: Bytes of text in a bucket, and buckets that Spark allows.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000
#: Rows of a single long column up to which it is broadcast: some 40 MB in memory.
MANY_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    Executors may be lost afterwards; the files stay. Cheaper than checkpoint(): columnar, compressed, prunable.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most `most` bytes, else df as it is (a shuffled join, which AQE splits where skewed).

    Rows and the lengths of their strings are added up, so df should be cheap to read: a written table or a short aggregate.
    """
    size = F.lit(16)
    for f in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if f.dataType.typeName() in ("string", "binary") else 8)
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def bucketed(df: DataFrame, key: str, name: str, n_bytes: int) -> DataFrame:
    """df written into the shared folder in buckets of key, so that joins on key don't shuffle it; its files are not compressed again.

    A bucket is one task, so there are as many as give about BUCKET_BYTES of the n_bytes that df stands for to each, and no fewer than shuffle partitions, as Spark
    would shuffle the table again to have that many.
    Spark keeps buckets of catalog tables only; the entry goes at once, the files and the plan that reads them stay.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    entry = f"evidentia_{path.rpartition('-')[2]}"
    buckets = min(MOST_BUCKETS, max(n_bytes // BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    df.write.option("path", path).option("compression", "uncompressed").bucketBy(buckets, key).format("parquet").saveAsTable(entry)
    found = spark.table(entry)
    found.schema  # analyzed now
    spark.sql(f"drop table {entry}")
    return found


def crc_fold(doc_id="doc_id"):
    """crc32 of the decimal doc_id modulo 5: the fold that splits documents into training and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `most` bytes in a column, or of one row that has more; nothing is copied."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def in_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """df, for a Python function: batches that go to and from Python hold at most `most` bytes, or one row (a setting of the session, lowered where it is larger)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", df.sparkSession.conf.get(key)) or 0)
    if not 0 < now <= most:
        df.sparkSession.conf.set(key, str(most))
    return df


def give_back() -> None:
    """Return freed memory to the system: a Python worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def given_back(work):
    """A generator for mapInArrow that gives freed memory back at its task's end."""

    @functools.wraps(work)
    def rows(batches):
        yield from work(batches)
        give_back()

    return rows
