"""Scalar rules on columns and small whole-frame projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats and codes below have to equal the published ones.
STATION_ID_PREFIX = "smoove:"
DIRECTED_ARROW = " → "
UNDIRECTED_ARROW = " ↔ "
QUARTILE_COLORS = {0: "#ffffb2", 1: "#fecc5c", 2: "#fd8d3c", 3: "#e31a1c"}
MISSING = -1.0


def lowercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def strip_text(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_names(df: DataFrame, columns=("departure_name", "return_name")) -> DataFrame:
    return df.withColumns({c: strip_text(F.col(c)) for c in columns})


def coerce_timestamp(df: DataFrame, columns=("departure", "return")) -> DataFrame:
    """Text to timestamp; text that is no timestamp becomes null instead of failing the job."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in columns})


def filter_id_prefix(df: DataFrame, column: str = "id", prefix: str = STATION_ID_PREFIX) -> DataFrame:
    """Keep ids of one operator and cut the prefix off (literal text, no pattern)."""
    return df.filter(F.col(column).startswith(prefix)).withColumn(
        column, F.replace(F.col(column), F.lit(prefix), F.lit(""))
    )


def tag_source(df: DataFrame, source: str, blank_id: bool = False) -> DataFrame:
    tagged = df.withColumn("source", F.lit(source))
    return tagged.withColumn("id", F.lit("")) if blank_id else tagged


def zero_pad_id(value: Column, width: int = 3) -> Column:
    """Station number as zero-padded text. Ids longer than the width stay whole; blank or null is -01."""
    number = F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")).cast("bigint"), F.lit(-1))
    return F.format_string(f"%0{width}d", number)


def duration_from_timestamps(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def duration_diff(computed: Column, reported: Column) -> Column:
    return F.abs(computed - reported)


def fill_from(value: Column, fallback: Column) -> Column:
    return F.coalesce(value, fallback)


def drop_any_null(df: DataFrame, columns=None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def seconds_to_minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def is_plausible_ride(minutes: Column, metres: Column) -> Column:
    """Rides of more than 1 and at most 300 minutes, longer than 50 m and shorter than 15 km."""
    return (minutes > 1) & (minutes <= 300) & (metres > 50) & (metres < 15000)


def null_flag_sentinel(df: DataFrame, column: str, flag: str, sentinel: float = MISSING) -> DataFrame:
    """Record nulls in a 0/1 column, then replace them. Both read the incoming value."""
    return df.withColumns(
        {
            flag: F.col(column).isNull().cast("int"),
            column: F.coalesce(F.col(column), F.lit(sentinel)),
        }
    )


def sentinel_to_null(df: DataFrame, columns, sentinel: float = MISSING) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def add_prefix(df: DataFrame, prefix: str, columns=None) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in (columns or df.columns)})


def ride_speed(metres: Column, minutes: Column) -> Column:
    """Kilometres per hour; null when the duration is zero."""
    return F.try_divide(metres / F.lit(1000.0), minutes / F.lit(60.0))


def rain_flag(precipitation: Column) -> Column:
    """1 when it rained; unknown (null or the sentinel) counts as dry."""
    return (F.coalesce(precipitation, F.lit(0.0)) > 0).cast("int")


def pair_key_directed(start: Column, end: Column) -> Column:
    return F.concat(start, F.lit(DIRECTED_ARROW), end)


def pair_ends(first: Column, second: Column) -> tuple[Column, Column]:
    """The two names of an undirected pair in code-point order; both null unless both are known."""
    known = first.isNotNull() & second.isNotNull()
    return F.when(known, F.least(first, second)), F.when(known, F.greatest(first, second))


def pair_key_undirected(first: Column, second: Column) -> Column:
    low, high = pair_ends(first, second)
    return F.concat(low, F.lit(UNDIRECTED_ARROW), high)


def pair_key_split(key: Column, separator: str = UNDIRECTED_ARROW) -> tuple[Column, Column]:
    parts = F.split(key, separator)
    return parts[0], parts[1]


def quartile_color(quartile: Column) -> Column:
    entries = [F.lit(x) for item in QUARTILE_COLORS.items() for x in item]
    return F.create_map(*entries)[quartile]


def ordinal_label(n: Column) -> Column:
    """1 to '1st', 2 to '2nd', 11 to '11th'."""
    tens = F.pmod(n, F.lit(100))
    units = F.pmod(n, F.lit(10))
    suffix = (
        F.when(tens.between(10, 20), "th")
        .when(units == 1, "st")
        .when(units == 2, "nd")
        .when(units == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def trips_label(name: Column, trips: Column) -> Column:
    """Text such as 'A: 12 trips', used for stations and for routes."""
    return F.format_string("%s: %d trips", name, trips)


def binary_target(y: Column) -> Column:
    return (y > 0).cast("int")


def two_phase_combine(is_active: Column, amount: Column) -> Column:
    return F.when(is_active == 0, F.lit(0.0)).otherwise(amount)


def residual(y: Column, predicted: Column) -> Column:
    return y - predicted


def within_zoom(error: Column, threshold: float = 15.0) -> Column:
    return F.abs(error) < threshold


def require_columns(df: DataFrame, needed) -> DataFrame:
    """Stop before any job starts when a column is absent."""
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"required columns not found: {', '.join(absent)}")
    return df


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
