"""Vectors of whole numbers: cleaned and scaled rows, their batches in numpy, singular vectors by MLlib."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Singular values below this part of the largest count as zero.
RANK = 1e-6


def whole(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """(vec_id, x array<long>): each component c as floor(scale * c), c as double. Rows whose vector is null or has null or non-finite components are left out.

    Products beyond a long become the nearest long. Other columns are ignored.
    """
    value = F.col(vector)
    fine = value.isNotNull() & F.forall(value, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(value, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def padded(rows: DataFrame, length: int) -> DataFrame:
    """rows with x filled up with zeros to a common length."""
    missing = F.greatest(F.lit(length) - F.size("x"), F.lit(0))
    return rows.withColumn("x", F.when(missing > 0, F.concat("x", F.array_repeat(F.lit(0).cast("long"), missing))).otherwise(F.col("x")))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def singular(rows: DataFrame, column: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and values of the rows of an array<double> column, the largest first, down to RANK.

    MLlib sums up the Gram matrix over the partitions (length squared numbers for each, in a tree) and decomposes it on the driver. All values are asked for, as fewer
    would be found by iteration only.
    """
    frame = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    found = RowMatrix(frame, numCols=length).computeSVD(length, computeU=False, rCond=RANK)
    return found.V.toArray(), np.asarray(found.s.toArray())
