"""All exploratory tables of one set of cleaned trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.functions.columns import ride_speed, sentinel_to_null
from tripwise.functions.timeparts import SEASON_MONTHS
from tripwise.operators import spatial, stats, usage
from tripwise.operators.asof import asof_join_backward
from tripwise.operators.grid import hourly_total
from tripwise.operators.staging import materialize


def hourly_with_weather(trips: DataFrame, weather: DataFrame, months=SEASON_MONTHS,
                        tolerance_seconds: float = 60.0) -> DataFrame:
    """Hourly totals with the weather observed at most one minute before the hour."""
    return asof_join_backward(hourly_total(trips, months), weather, "time", tolerance_seconds, hot_rows=None)


def distribution_tables(trips: DataFrame, cutoff_year: int = 2024, bins: int = 60) -> dict[str, DataFrame]:
    fast = trips.withColumn("speed", ride_speed(F.col("distance"), F.col("duration")))
    tables = {f"histogram_{c}": stats.histogram(fast, c, bins) for c in ("duration", "distance", "speed")}
    tables["duration_by_cutoff"] = stats.histogram_by_cutoff(trips, "duration", "departure", cutoff_year)
    tables["speed_counts"] = stats.count_over_thresholds(fast)
    return tables


def spatial_tables(trips: DataFrame) -> dict[str, DataFrame]:
    totals = spatial.station_total_trips(trips, sort=False)
    return {
        "station_map": spatial.station_map(totals),
        "top_stations": spatial.top_stations(totals),
        "top_station_pairs": spatial.top_station_pairs(trips),
        "top_routes": spatial.top_routes(trips),
    }


def weather_tables(trips: DataFrame, weather: DataFrame, months=SEASON_MONTHS) -> dict[str, DataFrame]:
    joined = hourly_with_weather(trips, weather, months)
    known = sentinel_to_null(joined, ("wind_speed", "precipitation"))
    columns = ("departures", "temperature", "wind_speed", "precipitation")
    return {
        "correlation": stats.correlation_matrix(known, columns),
        "temperature_points": stats.scatter_density(joined, "temperature", "departures"),
        "wind_points": stats.scatter_density(joined.filter("ws_missing = 0"), "wind_speed", "departures"),
        "rain_points": stats.scatter_density(joined.filter("precip_missing = 0"), "precipitation", "departures"),
    }


def temporal_tables(trips: DataFrame, months=SEASON_MONTHS) -> dict[str, DataFrame]:
    """The six means come from two written tables, each one scan and one shuffle for three groupings."""
    hourly = hourly_total(trips, months)
    by_hour = materialize(usage.hourly_profiles(hourly), "hourly-profiles")
    by_day = materialize(usage.daily_profiles(usage.daily_total(hourly)), "daily-profiles")

    def of(profiles: DataFrame, name: str, *parts: str) -> DataFrame:
        return profiles.filter(F.col("profile") == name).select(*parts, "mean_departures")

    return {
        "yearly": usage.yearly_usage(trips),
        "monthly": of(by_day, "monthly", "month"),
        "monthly_by_year": of(by_day, "monthly_by_year", "year", "month"),
        "weekday": of(by_day, "weekday", "weekday"),
        "hourly": of(by_hour, "hourly", "hour"),
        "hourly_by_year": of(by_hour, "hourly_by_year", "year", "hour"),
        "hourly_by_daytype": of(by_hour, "hourly_by_daytype", "is_weekend", "hour"),
    }


def eda_report(trips: DataFrame, weather: DataFrame, months=SEASON_MONTHS, cutoff_year: int = 2024) -> dict[str, DataFrame]:
    """Every distribution, spatial, weather and temporal table. Pass written or cached trips: each table reads them. All
    are lazy but the temporal means, which share two written tables."""
    return {
        **distribution_tables(trips, cutoff_year),
        **spatial_tables(trips),
        **weather_tables(trips, weather, months),
        **temporal_tables(trips, months),
    }
