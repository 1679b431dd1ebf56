"""Integer vectors from floating ones, and tables that replace one another round by round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.operators.staging import fresh_path

LARGEST = 1 << 26  # squared distances of integers up to this stay far below 2^63


def finite(vector: Column) -> Column:
    """True where the vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vector.isNotNull() & good


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs. A component beyond LARGEST is an error: its square would not fit."""
    def one(x):
        scaled = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LARGEST, scaled).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).cast("bigint")

    return F.transform(vector, one)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column whose lists all have `width` numbers, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def sums_by(df: DataFrame, keys: list[str], vector: str, width: int, *more: Column) -> list:
    """Rows of the keys, `n`, `total` (componentwise sums) and more aggregates; summed in the tasks before they meet."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(vector)[i]) for i in range(width)]).alias("total"), *more).collect()


class Generations:
    """A table that each round writes anew. The one before is deleted as soon as its successor is written, so that the
    shared folder holds two of them at most. A lost executor costs the running round only."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.path = spark, label, None

    def replace(self, df: DataFrame) -> DataFrame:
        path, before = fresh_path(self.spark, self.label), self.path
        df.write.parquet(path)
        self.path = path
        if before:
            context = self.spark.sparkContext
            old = context._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]
