"""Usage over time: totals, averages by calendar part, station coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Station counts examined for coverage.
COVERAGE_THRESHOLDS = (20, 50, 100, 150, 200, 250, 300, 350, 400, 450)


def daily_total(hourly: DataFrame, time: str = "time", value: str = "departures") -> DataFrame:
    """Sum per day of a zero-filled hourly series, so that days without a trip count."""
    return hourly.groupBy(F.to_date(time).alias("date")).agg(F.sum(value).cast("bigint").alias(value))


def yearly_usage(trips: DataFrame, time: str = "departure") -> DataFrame:
    return trips.groupBy(F.year(time).alias("year")).agg(F.count(F.lit(1)).alias("trips"))


def _mean_by(df: DataFrame, value: str, **parts) -> DataFrame:
    return df.groupBy(*[part.alias(name) for name, part in parts.items()]).agg(
        F.avg(value).alias(f"mean_{value}")
    )


def monthly_usage(daily: DataFrame, value: str = "departures") -> DataFrame:
    """Mean daily departures by month."""
    return _mean_by(daily, value, month=F.month("date"))


def monthly_usage_by_year(daily: DataFrame, value: str = "departures") -> DataFrame:
    return _mean_by(daily, value, year=F.year("date"), month=F.month("date"))


def weekday_usage(daily: DataFrame, value: str = "departures") -> DataFrame:
    return _mean_by(daily, value, weekday=F.weekday("date"))


def hourly_usage(hourly: DataFrame, value: str = "departures") -> DataFrame:
    """Mean hourly departures by hour of the day."""
    return _mean_by(hourly, value, hour=F.hour("time"))


def hourly_usage_by_year(hourly: DataFrame, value: str = "departures") -> DataFrame:
    return _mean_by(hourly, value, year=F.year("time"), hour=F.hour("time"))


def hourly_usage_by_daytype(hourly: DataFrame, value: str = "departures") -> DataFrame:
    return _mean_by(hourly, value, is_weekend=F.weekday("time") >= 5, hour=F.hour("time"))


def _profiles(df: DataFrame, value: str, parts: dict, sets: dict) -> DataFrame:
    """Means over several groupings in one scan and one shuffle: rows (profile, the parts, mean). Parts that a profile does
    not group by are null."""
    named = df.select(*[part.alias(name) for name, part in parts.items()], F.col(value))
    grouped = named.groupingSets([[F.col(c) for c in columns] for columns in sets.values()], *[F.col(c) for c in parts]).agg(
        F.avg(value).alias(f"mean_{value}"), F.grouping_id(*parts).alias("_set"))
    profile = F.lit(None).cast("string")
    for name, columns in sets.items():
        absent = "".join("0" if c in columns else "1" for c in parts)
        profile = F.when(F.col("_set") == int(absent, 2), name).otherwise(profile)
    return grouped.select(profile.alias("profile"), *parts, f"mean_{value}")


def daily_profiles(daily: DataFrame, value: str = "departures") -> DataFrame:
    """Mean daily departures by month, by year and month, and by weekday, taken together."""
    return _profiles(
        daily, value, {"year": F.year("date"), "month": F.month("date"), "weekday": F.weekday("date")},
        {"monthly": ("month",), "monthly_by_year": ("year", "month"), "weekday": ("weekday",)})


def hourly_profiles(hourly: DataFrame, value: str = "departures") -> DataFrame:
    """Mean hourly departures by hour, by year and hour, and by kind of day and hour, taken together."""
    return _profiles(
        hourly, value, {"year": F.year("time"), "is_weekend": F.weekday("time") >= 5, "hour": F.hour("time")},
        {"hourly": ("hour",), "hourly_by_year": ("year", "hour"), "hourly_by_daytype": ("is_weekend", "hour")})


def station_coverage(trips: DataFrame, thresholds=COVERAGE_THRESHOLDS, station: str = "departure_id",
                     weight: str | None = None) -> DataFrame:
    """For each N: stations kept, trips kept and their share when the N busiest stations are kept.

    Only the busiest max(thresholds) stations are ranked, so the ranking window has that many rows at most.
    `weight` names a count column when the input is already aggregated.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    usage = trips.filter(F.col(station).isNotNull()).groupBy(station).agg(size.alias("n"))
    total = trips.agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("total")).scalar()
    busiest = usage.orderBy(F.desc("n"), F.asc(station)).limit(max(thresholds))
    ranked = busiest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(station))))
    steps = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t >= F.col("rank")))
    return (
        ranked.withColumn("threshold", steps)
        .groupBy("threshold")
        .agg(F.count(F.lit(1)).alias("stations_kept"), F.sum("n").cast("bigint").alias("rides_kept"))
        .withColumn("rides_percent", F.round(F.col("rides_kept") / total * 100, 2))
    )


def station_demand_rank(*features: DataFrame, target: str = "departures", stage: bool = True) -> DataFrame:
    """Stations of all given tables ordered by total demand, with their rank."""
    from tripwise.operators.quantiles import rank_rows
    from tripwise.operators.staging import materialize

    stacked = union_all(*[f.select("station_id", target) for f in features])
    sums = stacked.groupBy("station_id").agg(F.sum(target).cast("bigint").alias("total"))
    return rank_rows(materialize(sums, "station-demand") if stage else sums, "total", "station_id")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def pick_ranks(ranked: DataFrame, ranks=(0, 24, 79)) -> DataFrame:
    """Rows at the given 0-based ranks."""
    return ranked.filter((F.col("rank") - 1).isin(*ranks))
