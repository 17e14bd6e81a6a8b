"""A keyed store of task heads in buckets: a micro-batch rewrites the buckets that it changes, and no other."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .usage import advance

HEADS = "task long, watermark long, rows_hash string"
PENDING = "task long, watermark long, reason string"
BUCKETS = 64


class Store:
    """heads and pending (quarantined tasks) under a folder that all machines share.

    A version is a small file that names, for each bucket of tasks, the folder with its rows; rows are never changed in place. A batch reads the buckets of its tasks, writes those with a
    change under its number and then the version file, so that a batch that is repeated writes the same again and a batch that failed leaves no trace. One writer.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, task: str = "task"):
        return F.pmod(F.xxhash64(task), F.lit(self.buckets)).cast("int")

    def version(self, below: int | None = None) -> tuple[int, dict]:
        """The last version's number and what it names; -1 before the first. below: the last one before that number."""
        found = self._fs.globStatus(self._path(f"{self.folder}/versions/*/_SUCCESS")) or []
        numbers = [n for f in found if (n := int(f.getPath().getParent().getName())) < (1 << 62 if below is None else below)]
        if not numbers:
            return -1, {"heads": {}, "pending": {}, "publication": ""}
        rows = self.spark.read.text(f"{self.folder}/versions/{max(numbers)}").collect()  # one line
        return max(numbers), json.loads(rows[0].value)

    def read(self, name: str, named: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = HEADS if name == "heads" else PENDING
        paths = sorted({p for b, p in named[name].items() if buckets is None or int(b) in buckets})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def heads(self) -> DataFrame:
        """Heads of the tasks that are not quarantined."""
        named = self.version()[1]
        return self.read("heads", named).join(self.read("pending", named).select("task").distinct(), "task", "left_anti")

    def pending(self) -> DataFrame:
        return self.read("pending", self.version()[1])

    def _publish(self, number: int, named: dict, changed: dict[str, DataFrame], touched: list[int], publication: str) -> None:
        new = {k: dict(named[k]) for k in ("heads", "pending")}
        for name, rows in changed.items():
            at = f"{self.folder}/{name}/{number}"
            rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
            written = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.globStatus(self._path(f"{at}/bucket=*")) or []}
            for b in map(str, touched):
                new[name].pop(b, None)
                if b in written:
                    new[name][b] = f"{at}/bucket={b}"
        line = json.dumps(new | {"publication": publication}, sort_keys=True)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/versions/{number}")

    def advance(self, arrived: DataFrame, number: int, publication: str = "") -> list[int]:
        """Apply a batch of heads (task, watermark, rows_hash) as version `number`; the buckets that were rewritten.

        A batch whose rows change nothing, and one with the fingerprint of the last whole publication, write nothing but the version. A quarantined task stays so until repair().
        """
        last, named = self.version(number)
        if publication and publication == named["publication"]:
            self._publish(number, named, {}, [], publication)
            return []
        arrived = arrived.select("task", "watermark", "rows_hash").distinct().persist()
        buckets = sorted(r[0] for r in arrived.select(self.bucket()).distinct().collect())  # BUCKETS at most
        old, held = self.read("heads", named, buckets), self.read("pending", named, buckets)
        kept, bad = advance(old, arrived)
        kept, marks = kept.persist(), arrived.groupBy("task").agg(F.max("watermark").alias("watermark"))
        bad = bad.join(marks, "task").select("task", "watermark", "reason")
        # of two reasons the one with the larger mark counts, the newer of equal marks
        both = held.withColumn("age", F.lit(0)).unionByName(bad.withColumn("age", F.lit(1)))
        pending = both.groupBy("task").agg(F.max_by(F.struct("watermark", "reason"), F.struct("watermark", "age")).alias("p")).select("task", "p.watermark", "p.reason").persist()
        fresh = kept.exceptAll(old).select("task").unionByName(pending.exceptAll(held).select("task"))
        touched = sorted(r[0] for r in fresh.select(self.bucket()).distinct().collect())
        inside = self.bucket().isin(touched)
        parts = {"heads": kept.where(inside), "pending": pending.where(inside)} if touched else {}
        failed = bool(bad.head(1))
        self._publish(number, named, parts, touched, "" if failed else publication)
        for df in (arrived, kept, pending):
            df.unpersist()
        return touched

    def repair(self, settled: DataFrame) -> list[int]:
        """Take tasks out of quarantine with the heads (task, watermark, rows_hash) that are known to be right, as a version of its own; the buckets that were rewritten.

        A head older than the mark at which its task was quarantined settles nothing and is left out.
        """
        last, named = self.version()
        buckets = sorted(r[0] for r in settled.select(self.bucket()).distinct().collect())
        old, held = self.read("heads", named, buckets), self.read("pending", named, buckets)
        good = settled.groupBy("task").agg(F.max_by("rows_hash", "watermark").alias("rows_hash"), F.max("watermark").alias("watermark")).select("task", "watermark", "rows_hash")
        good = good.join(held.select("task", F.col("watermark").alias("w")), "task").where("watermark >= w").select("task", "watermark", "rows_hash").persist()
        touched = sorted(r[0] for r in good.select(self.bucket()).distinct().collect())
        inside = self.bucket().isin(touched)
        heads = old.join(good.select("task"), "task", "left_anti").unionByName(good).where(inside)
        pending = held.join(good.select("task"), "task", "left_anti").where(inside)
        if touched:
            self._publish(last + 1, named, {"heads": heads, "pending": pending}, touched, "")
        good.unpersist()
        return touched

    def drain(self, stream: DataFrame, checkpoint: str) -> None:
        """Apply a stream of heads up to its present end, a version for each micro-batch; an idle run changes nothing."""
        first = self.version()[0] + 1

        def write(batch: DataFrame, n: int) -> None:
            # numbers go on after repairs, which are versions, too; a repeated micro-batch is told by its mark
            done = f"{self.folder}/batches/{n}"
            found = self._fs.globStatus(self._path(f"{done}/*/_SUCCESS")) or []
            number = int(found[0].getPath().getParent().getName()) if found else max(self.version()[0] + 1, first)
            if not found:
                self.spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{done}/{number}")
            self.advance(batch, number)

        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
