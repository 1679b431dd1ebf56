"""Raw trips to unified, cleaned trips with station locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.functions.columns import (
    coerce_timestamp,
    drop_any_null,
    duration_from_timestamps,
    fill_from,
    is_plausible_ride,
    lowercase_columns,
    seconds_to_minutes,
    strip_names,
)
from tripwise.functions.timeparts import exclude_month
from tripwise.operators.locations import merge_station_info, prepare_stations


def normalize_trips(raw: DataFrame) -> DataFrame:
    """Lower-case column names, parse times, strip station names."""
    return strip_names(coerce_timestamp(lowercase_columns(raw)))


def clean_trips(trips: DataFrame, skip_month: int | None = 3) -> DataFrame:
    """Cleaning before the station join: month, duration, nulls, units, outliers."""
    out = exclude_month(trips, "departure", skip_month) if skip_month else trips
    computed = duration_from_timestamps(F.col("departure"), F.col("return"))
    out = out.withColumn("duration", fill_from(F.col("duration"), computed))
    out = drop_any_null(out).withColumn("duration", seconds_to_minutes(F.col("duration")))
    return out.filter(is_plausible_ride(F.col("duration"), F.col("distance")))


def clean_rides(trips: DataFrame, stations: DataFrame, skip_month: int | None = 3, dedupe: bool = False) -> DataFrame:
    """Cleaned trips with locations of both ends. Nulls are dropped before the station join, so a trip
    whose station has no known location stays, with null coordinates."""
    lookup = prepare_stations(stations)
    out = clean_trips(trips, skip_month)
    for side in ("departure", "return"):
        out = merge_station_info(out, lookup, side, dedupe)
    return out
