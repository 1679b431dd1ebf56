"""Regular time grids: counts per hour and station with the empty hours filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.functions.timeparts import SEASON_MONTHS, floor_hour, in_months
from tripwise.operators.staging import as_lookup, lookup_join

HOUR = "interval 1 hour"


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first; equal counts in the order of the value."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).filter(F.col(column).isNotNull())
    return counted.orderBy(F.desc(name), F.asc(column))


def top_n_stations(trips: DataFrame, n: int = 100, column: str = "departure_id") -> DataFrame:
    """The n busiest stations. Sort and limit become a distributed top-k of at most n rows."""
    return value_counts(trips, column, "trips").limit(n).withColumnRenamed(column, "station_id")


def semi_join_top(trips: DataFrame, top: DataFrame, column: str = "departure_id") -> DataFrame:
    """Trips of the chosen stations, whose table is measured before it is broadcast."""
    keep = as_lookup(top.select(F.col("station_id").alias(column)), stage="chosen-stations")
    return lookup_join(trips, keep, column, "left_semi")


def hourly_departures(trips: DataFrame, time: str = "departure", station: str = "departure_id") -> DataFrame:
    """Trips per (station, hour), combined on the map side before the shuffle."""
    return trips.groupBy(F.col(station).alias("station_id"), floor_hour(F.col(time)).alias("time")).agg(
        F.count(F.lit(1)).alias("departures")
    )


def time_bounds(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def hour_bounds(trips: DataFrame, time: str = "departure") -> Column:
    """First and last hour of all trips as a scalar struct (lo, hi)."""
    t = floor_hour(F.col(time))
    return trips.agg(F.struct(F.min(t).alias("lo"), F.max(t).alias("hi")).alias("bounds")).scalar()


def cross_join_spine(stations: DataFrame, bounds: Column, months=SEASON_MONTHS, step: str = HOUR) -> DataFrame:
    """Every station at every step of the season. Each station row expands where it lies; no join is needed."""
    spread = stations.select("station_id").distinct().withColumn("_b", bounds)
    grid = spread.select(
        "station_id", F.explode(F.sequence(F.col("_b.lo"), F.col("_b.hi"), F.expr(step))).alias("time")
    )
    return grid.filter(in_months(F.col("time"), months)) if months else grid


def spine_fill_zero(counts: DataFrame, bounds: Column, months=SEASON_MONTHS, step: str = HOUR,
                    value: str = "departures", key: str = "station_id") -> DataFrame:
    """Complete grid of every key that has counts, missing steps set to zero.

    Each row writes out itself and the empty steps up to the next row of its key, and the first row also
    the steps before it. So the grid is never shuffled: only the counts are, once, by key, and windows by
    the same key that follow reuse that placement.
    """
    ordered = Window.partitionBy(key).orderBy("time")
    stride = F.expr(step)
    placed = counts.select(key, "time", value).withColumn("_b", bounds)
    edges = placed.withColumn("_next", F.lead("time").over(ordered)).withColumn("_rank", F.row_number().over(ordered))
    start = F.when(F.col("_rank") == 1, F.col("_b.lo")).otherwise(F.col("time"))
    stop = F.coalesce(F.col("_next") - stride, F.col("_b.hi"))
    filled = edges.withColumn("_step", F.explode(F.sequence(start, stop, stride))).select(
        key,
        F.col("_step").alias("time"),
        F.when(F.col("_step") == F.col("time"), F.col(value)).otherwise(F.lit(0)).cast("bigint").alias(value),
    )
    return filled.filter(in_months(F.col("time"), months)) if months else filled


def hourly_total(trips: DataFrame, months=SEASON_MONTHS, time: str = "departure") -> DataFrame:
    """Departures of all stations per hour, zero-filled over the season."""
    counts = trips.groupBy(floor_hour(F.col(time)).alias("time")).agg(F.count(F.lit(1)).alias("departures"))
    return fill_series(counts, hour_bounds(trips, time), months)


def fill_series(counts: DataFrame, bounds: Column, months=SEASON_MONTHS, value: str = "departures") -> DataFrame:
    """Zero-fill one hourly series without a key: the hours are generated day by day and matched by time."""
    lo_hi = counts.sparkSession.range(1).select(bounds.alias("_b"))
    days = lo_hi.select("_b", F.explode(F.expr("sequence(date_trunc('day', _b.lo), _b.hi, interval 1 day)")).alias("_d"))
    hours = (
        days.repartition("_d")
        .select("_b", F.explode(F.expr("sequence(_d, _d + interval 23 hours, interval 1 hour)")).alias("time"))
        .filter((F.col("time") >= F.col("_b.lo")) & (F.col("time") <= F.col("_b.hi")))
        .select("time")
    )
    if months:
        hours = hours.filter(in_months(F.col("time"), months))
    return hours.join(counts.select("time", value), "time", "left").select(
        "time", F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias(value)
    )


def dedupe_keys(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in the given order, ties by the other columns. Each task keeps one row of a key before
    the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def join_weather_exact(hourly: DataFrame, weather: DataFrame, order=()) -> DataFrame:
    """Weather of the same hour. A repeated local hour gives its first observation (by `order`).

    No hint: one row per hour is small enough for Spark's own size check to broadcast it, and a larger
    multi-site table falls back to a sort-merge join with skew handling.
    """
    once = dedupe_keys(weather, ["time"], list(order))
    return hourly.join(once, "time", "left")
