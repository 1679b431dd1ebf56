"""Writers for tables and models."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# CSV times keep their microseconds; readers of such files need the same option.
CSV_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class Written:
    """What was counted while a table was written."""

    path: str
    rows: int
    missing: dict[str, int]

    def missing_summary(self, spark: SparkSession) -> DataFrame:
        """`column_name`, `missing`, `percent`, like the summary that scans the table."""
        rows = [(c, n, round(100.0 * n / self.rows, 3) if self.rows else None) for c, n in self.missing.items()]
        return spark.createDataFrame(rows, "column_name string, missing bigint, percent double")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "overwrite",
                rebalance: bool = True, dynamic: bool = False) -> None:
    """Write a table. Trips are best partitioned by year, so that later year filters prune folders.

    Rows of a partition are brought together first, so a folder gets about as many files as its bytes need (the advisory
    size of adaptive execution) instead of one from every task; a large folder is split, so none is one task. With
    `dynamic`, only folders that get rows are replaced.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(fmt)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.options(header=True, timestampFormat=CSV_TIME)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_counted(df: DataFrame, path: str, columns=None, **settings) -> Written:
    """Write a table and count its rows and the nulls (and NaNs) of the columns in the same pass, without reading it back."""
    columns = list(df.columns if columns is None else columns)
    real = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    absent = {c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if c in real else F.lit(False)) for c in columns}
    seen = Observation()
    counts = [F.count_if(absent[c]).alias(f"missing_{i}") for i, c in enumerate(columns)]
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), path, **settings)
    found = seen.get
    return Written(path, found["rows"], {c: found[f"missing_{i}"] for i, c in enumerate(columns)})


def write_trips_by_year(trips: DataFrame, path: str, time: str = "departure", fmt: str = "parquet") -> None:
    write_table(trips.withColumn("year", F.year(time)), path, fmt, partition_by=("year",))


def write_grid(grid: DataFrame, table: str, path: str, buckets: int, key: str = "station_id", time: str = "time") -> DataFrame:
    """Write an hourly grid as a table bucketed by station and sorted by time, and read it back: windows and joins by station
    need no shuffle. One shuffle makes one file a bucket; the catalog of the session keeps the table's name."""
    spark = grid.sparkSession
    dealt = grid.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, time).option("path", path).saveAsTable(table)
    return spark.table(table)


def write_train_test(features: DataFrame, path: str, test_year: int = 2024, fmt: str = "parquet") -> None:
    """One pass over the features writes both sides: folders split=train and split=test."""
    split = F.when(F.col("year") < test_year, "train").when(F.col("year") == test_year, "test")
    tagged = features.withColumn("split", split).filter(F.col("split").isNotNull())
    write_table(tagged, path, fmt, partition_by=("split",))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """The stored model, or None with a warning when the path holds no model's metadata; a damaged model is an error."""
    spark = SparkSession.getActiveSession()
    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no model found at {path}", stacklevel=2)
        return None
    return PipelineModel.load(path)
