"""Missing sensor values: forward fill, run lengths, short-gap fill.

A series need not have a key, so nothing here may put a whole series into one task. Rows are cut into
calendar chunks; windows run inside a chunk, and one summary row per chunk is carried to its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.functions.columns import MISSING, null_flag_sentinel

SHORT_GAP = 6


def with_neighbours(df: DataFrame, columns, time: str = "time", by=(), order=(), chunk: str = "month") -> DataFrame:
    """Add, for each column c, `_prev_c` and `_next_c`: its nearest present value at or before and at or
    after the row, as structs (ordinal, at, value); also `_ordinal` and `_total`, the row position in its
    series and the length of the series.

    `order` breaks ties of equal `time`. Rows are shuffled once, by chunk. The only table that meets in one
    task per series is the chunk summary: one row per calendar chunk.
    """
    by, keys = list(by), [*by, "_chunk"]
    rows = df.withColumn("_chunk", F.date_trunc(chunk, F.col(time)))
    forward = Window.partitionBy(*keys).orderBy(time, *order)
    rows = rows.withColumn("_local", F.row_number().over(forward))
    here = {
        c: F.when(
            F.col(c).isNotNull(),
            F.struct(F.col("_local").cast("bigint").alias("ordinal"), F.col(time).alias("at"),
                     F.col(c).cast("double").alias("value")),
        )
        for c in columns
    }
    so_far = forward.rowsBetween(Window.unboundedPreceding, 0)
    to_come = Window.partitionBy(*keys).orderBy(F.desc("_local")).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_prev_{c}": F.last(x, ignorenulls=True).over(so_far) for c, x in here.items()})
    local = local.withColumns({f"_next_{c}": F.last(x, ignorenulls=True).over(to_come) for c, x in here.items()})

    edges = local.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(here[c]).alias(f"_first_{c}") for c in columns],
        *[F.max(here[c]).alias(f"_last_{c}") for c in columns],
    )
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns(
        {
            "_offset": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            "_total": F.sum("_rows").over(Window.partitionBy(*by)),
        }
    )
    for c in columns:
        for end in ("first", "last"):
            edges = edges.withColumn(f"_{end}_{c}", _moved(F.col(f"_{end}_{c}"), F.col("_offset")))
    carried = edges.select(
        *keys,
        "_offset",
        "_total",
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_before_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_after_{c}") for c in columns],
    )
    # No hint: chunk rows are few, and a larger summary joins in place, as both sides are spread by chunk.
    joined = local.join(carried, keys, "left")
    found = {"_ordinal": F.col("_offset") + F.col("_local")}
    for c in columns:
        for side, edge in (("prev", "before"), ("next", "after")):
            inside = _moved(F.col(f"_{side}_{c}"), F.col("_offset"))
            found[f"_{side}_{c}"] = F.coalesce(inside, F.col(f"_{edge}_{c}"))
    return joined.withColumns(found).drop("_chunk", "_local", "_offset", *[f"_{e}_{c}" for c in columns for e in ("before", "after")])


def _moved(mark: Column, offset: Column) -> Column:
    """A marker with its position counted from the start of the series."""
    return F.when(mark.isNotNull(), mark.withField("ordinal", mark["ordinal"] + offset))


def ffill(df: DataFrame, column: str, time: str = "time", by=(), order=(), chunk: str = "month") -> DataFrame:
    """Replace nulls by the last present value; nulls before the first one stay."""
    filled = with_neighbours(df, [column], time, by, order, chunk)
    return filled.withColumn(column, F.col(f"_prev_{column}.value")).select(*df.columns)


def _run_length(column: str) -> Column:
    """Nulls in the run of a row: those between its last present value and the next one."""
    following = F.coalesce(F.col(f"_next_{column}.ordinal"), F.col("_total") + 1)
    preceding = F.coalesce(F.col(f"_prev_{column}.ordinal"), F.lit(0))
    return F.greatest(following - preceding - 1, F.lit(0))


def null_run_id(df: DataFrame, column: str, time: str = "time", by=(), order=(), chunk: str = "month") -> DataFrame:
    """Add run_start (time of the last present value, null for the leading run) and run_length of null rows."""
    out = with_neighbours(df, [column], time, by, order, chunk)
    missing = F.col(column).isNull()
    return out.select(
        *df.columns,
        F.col(f"_prev_{column}.at").alias("run_start"),
        F.when(missing, _run_length(column)).otherwise(F.lit(0)).cast("bigint").alias("run_length"),
    )


def gap_lengths(df: DataFrame, column: str, longer_than: int = SHORT_GAP, time: str = "time", by=(), order=(),
                chunk: str = "month") -> DataFrame:
    """One row per run of nulls longer than the limit."""
    runs = null_run_id(df, column, time, by, order, chunk).filter(F.col(column).isNull())
    return (
        runs.filter(F.col("run_length") > longer_than)
        .groupBy(*by, "run_start")
        .agg(F.max("run_length").alias("gap_length"))
    )


def fill_short_gaps(df: DataFrame, column: str, limit: int = SHORT_GAP, method: str = "repeat", time: str = "time",
                    by=(), order=(), chunk: str = "month") -> DataFrame:
    """Fill runs of 1..limit nulls that follow a present value.

    'repeat' carries the last value forward, the default behaviour to match; 'linear' interpolates
    by row position towards the next present value (repeating at the end of the series).
    """
    if method not in ("repeat", "linear"):
        raise ValueError(f"unknown method: {method}")
    out = with_neighbours(df, [column], time, by, order, chunk)
    return out.withColumn(column, _short_gap_value(column, limit, method)).select(*df.columns)


def _short_gap_value(column: str, limit: int, method: str) -> Column:
    prev, following = F.col(f"_prev_{column}"), F.col(f"_next_{column}")
    fill = prev["value"]
    if method == "linear":
        share = (F.col("_ordinal") - prev["ordinal"]) / (following["ordinal"] - prev["ordinal"])
        between = prev["value"] + share * (following["value"] - prev["value"])
        fill = F.when(following.isNotNull(), between).otherwise(prev["value"])
    short = prev.isNotNull() & _run_length(column).between(1, limit)
    return F.when(F.col(column).isNotNull(), F.col(column)).when(short, fill)


def long_gap_flag(df: DataFrame, column: str = "wind_speed", flag: str = "ws_missing") -> DataFrame:
    """What is still null is flagged and set to the sentinel; filled values carry flag 0."""
    return null_flag_sentinel(df, column, flag)


def handle_wind_speed_gaps(df: DataFrame, column: str = "wind_speed", flag: str = "ws_missing",
                           limit: int = SHORT_GAP, method: str = "repeat", time: str = "time", by=(), order=(),
                           chunk: str = "month") -> DataFrame:
    return long_gap_flag(fill_short_gaps(df, column, limit, method, time, by, order, chunk), column, flag)


def clean_weather(df: DataFrame, time: str = "time", by=(), order=(), chunk: str = "month",
                  method: str = "repeat", limit: int = SHORT_GAP) -> DataFrame:
    """Flag and replace missing precipitation, carry temperature forward, handle wind gaps.

    Temperature and wind share one pass over the series.
    """
    flagged = null_flag_sentinel(df, "precipitation", "precip_missing")
    near = with_neighbours(flagged, ["temperature", "wind_speed"], time, by, order, chunk)
    filled = near.withColumns(
        {"temperature": F.col("_prev_temperature.value"), "wind_speed": _short_gap_value("wind_speed", limit, method)}
    )
    return long_gap_flag(filled.select(*flagged.columns))


def missing_summary(df: DataFrame, columns=None) -> DataFrame:
    """Null count and percentage of every column, from one aggregation."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counted.unpivot(["_n"], columns, "column_name", "missing").select(
        "column_name", "missing", F.round(100 * F.col("missing") / F.col("_n"), 3).alias("percent")
    )


