"""A feature table that grows by months: new trips rewrite their own months only."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.functions.columns import drop_any_null, rain_flag
from tripwise.functions.timeparts import SEASON_MONTHS, calendar_parts, floor_hour
from tripwise.operators.features import LAGS, ROLLING_WINDOWS, SAME_HOUR_WINDOWS, demand_features
from tripwise.operators.grid import dedupe_keys, spine_fill_zero
from tripwise.operators.locations import DETAILS
from tripwise.operators.staging import as_lookup, lookup_join, materialize
from tripwise.plans.feature_table import station_summary
from tripwise.sources.writers import write_table

PARTS = ("year", "month")
HOUR = timedelta(hours=1)


def look_back(start: datetime, hours: int, months=SEASON_MONTHS) -> datetime:
    """The moment that has `hours` hours of the season between itself and `start`. Windows count rows of the season, so they
    reach across a winter."""
    at = start
    while hours:
        at -= HOUR
        hours -= not months or at.month in months
    return at


def choose_stations(trips: DataFrame, path: str, num_stations: int | None = 100) -> DataFrame:
    """Write the busiest stations with their locations and the first hour of all trips. They stay fixed while months are
    added, so that old months need no change."""
    summary = materialize(station_summary(trips), "station-summary")
    first = summary.agg(F.min("first_hour").alias("since")).scalar()
    named = summary.filter(F.col("station_id").isNotNull())
    if num_stations is not None:
        named = named.orderBy(F.desc("trips"), "station_id").limit(num_stations)
    write_table(named.select("station_id", *DETAILS).withColumn("since", first), path)
    return trips.sparkSession.read.parquet(path)


def features_since(trips: DataFrame, weather: DataFrame, stations: DataFrame, start: datetime | None = None, months=SEASON_MONTHS,
                   lags=LAGS, rolling_windows=ROLLING_WINDOWS, same_hour_windows=SAME_HOUR_WINDOWS, weather_order=()) -> DataFrame:
    """Feature rows of the chosen stations from `start` on (all without one), equal to those of the whole table.

    Only trips from as far back as the longest window reaches are read; on a table by years a filter on the year prunes the
    folders. A station without trips in that stretch has hours of zero like any other.
    """
    reach = max(*lags, *rolling_windows, *(24 * d for d in same_hour_windows))
    since = F.col("since").cast("timestamp")
    lo: Column = stations.agg(F.min(since)).scalar()
    if start is not None:
        earliest = look_back(start, reach, months)
        lo = F.greatest(lo, F.lit(earliest))
        trips = trips.filter(F.col("departure") >= F.lit(earliest))
        if "year" in trips.columns:
            trips = trips.filter(F.col("year") >= earliest.year)
    chosen = as_lookup(stations.select("station_id", *DETAILS))
    kept = lookup_join(trips, chosen.derive(lambda s: s.select(F.col("station_id").alias("departure_id"))), "departure_id", "left_semi")
    hours = kept.select(F.col("departure_id").alias("station_id"), floor_hour(F.col("departure")).alias("time"), F.lit(1).alias("n"))
    opening = chosen.frame.select("station_id", lo.alias("time"), F.lit(0).alias("n"))
    counts = hours.unionByName(opening).groupBy("station_id", "time").agg(F.sum("n").alias("departures"))
    bounds = F.struct(lo.alias("lo"), trips.agg(F.max(floor_hour(F.col("departure")))).scalar().alias("hi"))
    demand = demand_features(spine_fill_zero(counts, bounds, months), "departures", lags, rolling_windows, same_hour_windows)
    demand = drop_any_null(demand)
    if start is not None:
        demand = demand.filter(F.col("time") >= F.lit(start))
    late = dedupe_keys(weather, ["time"], list(weather_order)).withColumn("time", F.col("time") + F.expr("interval 1 hour"))
    out = lookup_join(demand, chosen, "station_id").join(late, "time", "left")
    return drop_any_null(calendar_parts(out).withColumn("rain", rain_flag(F.col("precipitation"))))


def build_months(trips: DataFrame, weather: DataFrame, root: str, num_stations: int | None = 100, **settings) -> None:
    """Choose the stations and write the whole feature table, one folder for each month."""
    stations = choose_stations(trips, f"{root}/stations", num_stations)
    write_table(features_since(trips, weather, stations, **settings), f"{root}/features", partition_by=PARTS)


def rebuild_months(trips: DataFrame, weather: DataFrame, root: str, since: datetime, **settings) -> None:
    """Write the months from that of `since` on anew; folders of earlier months are not touched. A month that yields no row
    any more keeps its folder."""
    spark: SparkSession = trips.sparkSession
    stations = spark.read.parquet(f"{root}/stations")
    fresh = features_since(trips, weather, stations, datetime(since.year, since.month, 1), **settings)
    write_table(fresh, f"{root}/features", partition_by=PARTS, dynamic=True)


def read_months(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/features")
