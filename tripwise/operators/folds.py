"""Row positions in time: samples per station, expanding folds, week slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_per_station(df: DataFrame, n: int = 50, key: str = "station_id", time: str = "time") -> DataFrame:
    """n rows per station, or all if fewer. The order is a hash of the row key: repeatable on every cluster,
    and the rank limit prunes before the shuffle, so a large station sends n rows per task at most."""
    order = F.md5(F.concat_ws("|", F.col(key), F.date_format(time, "yyyy-MM-dd HH:mm:ss")))
    w = Window.partitionBy(key).orderBy(order, time)
    return df.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= n)


def time_ordinal(df: DataFrame, time: str = "time", key: str = "station_id") -> DataFrame:
    """0-based `ordinal` of each row in the order (time, station).

    Rows without a time come first, as in the order of Spark. Rows before this hour come from hourly counts, summed inside months and then over the month totals,
    so the running sums see one row per hour and per month, never the table itself.
    """
    hours = df.groupBy(time).agg(F.count(F.lit(1)).alias("_n")).withColumn("_month", F.date_trunc("month", F.col(time)))
    months = hours.groupBy("_month").agg(F.sum("_n").alias("_m"))
    earlier = Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(F.col("_month").alias("_of"), F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_month").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    starts = hours.join(months, F.col("_month").eqNullSafe(F.col("_of"))).select(
        time, (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_start")
    ).withColumnRenamed(time, "_hour")
    place = F.row_number().over(Window.partitionBy(time).orderBy(key))
    joined = df.join(starts, F.col(time).eqNullSafe(F.col("_hour")))
    return joined.withColumn("ordinal", F.col("_start") + place - 1).select(
        *df.columns, "ordinal"
    )


def time_series_folds(df: DataFrame, splits: int = 7, time: str = "time", key: str = "station_id") -> DataFrame:
    """Add `fold`: 0 for rows that only ever train, k for the validation rows of split k.

    Split k trains on every row with fold < k. Folds have n div (splits + 1) rows each.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = time_ordinal(df, time, key).withColumn("_n", total)
    size = F.floor(F.col("_n") / (splits + 1))
    start = F.col("_n") - splits * size
    fold = F.when(F.col("ordinal") < start, 0).otherwise(F.floor((F.col("ordinal") - start) / size) + 1)
    return out.withColumn("fold", fold.cast("int")).drop("_n")


def week_slice(test: DataFrame, stations=None, start_day: int = 105, per_day: int = 24, days: int = 7,
               key: str = "station_id", time: str = "time") -> DataFrame:
    """Rows start_day * per_day .. + days * per_day of each (chosen) station, by position in its series."""
    chosen = test if stations is None else test.filter(F.col(key).isin(*stations))
    first = start_day * per_day
    place = F.row_number().over(Window.partitionBy(key).orderBy(time))
    return (
        chosen.withColumn("position", place)
        .filter(F.col("position").between(first + 1, first + days * per_day))
        .withColumn("position", F.col("position") - first)
    )
