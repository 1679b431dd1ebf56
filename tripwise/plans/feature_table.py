"""Cleaned trips and weather to the feature table of the forecast models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.functions.columns import drop_any_null, rain_flag
from tripwise.functions.timeparts import SEASON_MONTHS, calendar_parts, floor_hour
from tripwise.operators.features import (
    LAGS,
    ROLLING_WINDOWS,
    SAME_HOUR_WINDOWS,
    add_features,
    demand_features,
)
from tripwise.operators.grid import (
    dedupe_keys,
    hourly_departures,
    join_weather_exact,
    spine_fill_zero,
)
from tripwise.operators.locations import DETAILS
from tripwise.operators.staging import Lookup, as_lookup, lookup_join, materialize


def station_summary(trips: DataFrame) -> DataFrame:
    """One row per departure station: trips, location at its first trip, first and last hour.

    Trips are reduced to (station, location) by a hash aggregate; the rest works on that small result.
    """
    places = trips.groupBy(
        F.col("departure_id").alias("station_id"), *[F.col(f"departure_{c}").alias(c) for c in DETAILS]
    ).agg(F.count(F.lit(1)).alias("n"), F.min("departure").alias("first"), F.max("departure").alias("last"))
    at = F.struct(*DETAILS)
    return (
        places.groupBy("station_id")
        .agg(
            F.sum("n").alias("trips"),
            F.min_by(at, F.struct("first", at)).alias("at"),
            floor_hour(F.min("first")).alias("first_hour"),
            floor_hour(F.max("last")).alias("last_hour"),
        )
        .select("station_id", "trips", "at.*", "first_hour", "last_hour")
    )


def _grid(trips: DataFrame, num_stations: int | None, months) -> tuple[DataFrame, Lookup]:
    """Zero-filled hourly departures of the busiest stations, and their locations.

    Trips are read twice: for the station summary, which gives usage, locations and time bounds at once
    and is written out, and for the hourly counts.
    """
    summary = materialize(station_summary(trips), "station-summary")
    bounds = summary.agg(F.struct(F.min("first_hour").alias("lo"), F.max("last_hour").alias("hi")).alias("b")).scalar()
    named = summary.filter(F.col("station_id").isNotNull())
    if num_stations is None:
        stations = as_lookup(named)
        kept = trips.filter(F.col("departure_id").isNotNull())
    else:
        busiest = named.orderBy(F.desc("trips"), "station_id").limit(num_stations)
        stations = as_lookup(busiest, stage="busiest-stations")
        kept = lookup_join(trips, stations.derive(lambda s: s.select(F.col("station_id").alias("departure_id"))), "departure_id", "left_semi")
    counts = hourly_departures(kept)
    locations = stations.derive(lambda s: s.select("station_id", *DETAILS))
    return spine_fill_zero(counts, bounds, months), locations


def aggregate_hourly_departures(trips: DataFrame, num_stations: int | None = 100, months=SEASON_MONTHS) -> DataFrame:
    """Zero-filled hourly departures with station location."""
    grid, locations = _grid(trips, num_stations, months)
    return lookup_join(grid, locations, "station_id")


def build_feature_table(trips: DataFrame, weather: DataFrame, num_stations: int | None = 100, months=SEASON_MONTHS,
                        lags=LAGS, rolling_windows=ROLLING_WINDOWS, same_hour_windows=SAME_HOUR_WINDOWS,
                        weather_order=()) -> DataFrame:
    """The flagship plan. Windows run on three narrow columns; locations and weather are attached after them.

    Weather is joined one hour late (the value of the hour before) instead of being shifted in a window. That
    is the same thing, because a row is kept only when its previous hour exists.
    """
    grid, locations = _grid(trips, num_stations, months)
    demand = demand_features(grid, "departures", lags, rolling_windows, same_hour_windows)
    demand = drop_any_null(demand)
    late = dedupe_keys(weather, ["time"], list(weather_order)).withColumn("time", F.col("time") + F.expr("interval 1 hour"))
    out = lookup_join(demand, locations, "station_id").join(late, "time", "left")
    out = calendar_parts(out).withColumn("rain", rain_flag(F.col("precipitation")))
    return drop_any_null(out)


def build_feature_table_stepwise(trips: DataFrame, weather: DataFrame, num_stations: int | None = 100,
                                 months=SEASON_MONTHS, **settings) -> DataFrame:
    """The same table step by step (locations, weather, then all features); used to cross-check the plan above."""
    hourly = join_weather_exact(aggregate_hourly_departures(trips, num_stations, months), weather)
    weather_columns = tuple(c for c in weather.columns if c != "time")
    return add_features(hourly, "departures", weather_columns=weather_columns, **settings)
