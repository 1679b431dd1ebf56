"""Hour buckets, calendar parts, seasons and the local clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Local clock and riding season of the modelled city.
LOCAL_ZONE = "Europe/Helsinki"
SEASON_MONTHS = (4, 5, 6, 7, 8, 9, 10)


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def calendar_parts(df: DataFrame, time: str = "time") -> DataFrame:
    """hour, weekday (Monday = 0), month, is_weekend and year of a timestamp column."""
    t = F.col(time)
    return df.withColumns(
        {
            "hour": F.hour(t),
            "weekday": F.weekday(t),
            "month": F.month(t),
            "is_weekend": (F.weekday(t) >= 5).cast("int"),
            "year": F.year(t),
        }
    )


def in_months(ts: Column, months=SEASON_MONTHS) -> Column:
    return F.month(ts).isin(*months)


def season_filter(df: DataFrame, time: str = "time", months=SEASON_MONTHS) -> DataFrame:
    return df.filter(in_months(F.col(time), months))


def exclude_month(df: DataFrame, time: str = "departure", month: int = 3) -> DataFrame:
    return df.filter(F.month(time) != month)


def filter_period(df: DataFrame, time: str, month: int | None = None, year: int | None = None,
                  other_years: bool = False, not_null: str | None = None) -> DataFrame:
    """Rows of one month and of one year (or of every other year), optionally with a value present."""
    out = df
    if month is not None:
        out = out.filter(F.month(time) == month)
    if year is not None:
        out = out.filter(F.year(time) != year if other_years else F.year(time) == year)
    return out.filter(F.col(not_null).isNotNull()) if not_null else out


def year_split(df: DataFrame, test_year: int = 2024, year: str = "year") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(year) < test_year), df.filter(F.col(year) == test_year)


def utc_to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_to_utc(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_utc_timestamp(ts, zone)


def local_season_filter(df: DataFrame, utc_time: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Rows from 1 April 00:00 to 31 October 23:59 local time of their own year, tested on the UTC column."""
    t = F.col(utc_time)
    year = F.year(utc_to_local(t, zone))
    start = local_to_utc(F.make_timestamp(year, F.lit(4), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), zone)
    end = local_to_utc(F.make_timestamp(year, F.lit(10), F.lit(31), F.lit(23), F.lit(59), F.lit(0)), zone)
    return df.filter((t >= start) & (t <= end))
