"""Lag, rolling and same-hour features of a regular series per station.

All windows share one partitioning and one order (station, epoch), so a chain of these functions plans
one shuffle and one sort. Window partitions are grid rows of one station: bounded by the calendar, not
by the number of trips.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.functions.columns import drop_any_null, rain_flag
from tripwise.functions.timeparts import calendar_parts

# Lags and windows (steps, days) of the published feature set.
LAGS = (1, 2, 3, 6, 12, 18, 24, 48, 72, 168)
ROLLING_WINDOWS = (3, 24, 168)
SAME_HOUR_WINDOWS = (3, 7)
WEATHER_COLUMNS = ("temperature", "wind_speed", "precipitation", "precip_missing", "ws_missing")
HOUR_SECONDS = 3600


def _order(key: str):
    return Window.partitionBy(key).orderBy("_epoch")


def _with_epoch(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("_epoch", F.unix_seconds(F.col(time)))


def _lag(value, k: int, key: str, step: int) -> Column:
    """Value exactly k steps earlier by the clock; null when that moment is not in the series."""
    return F.first(value).over(_order(key).rangeBetween(-k * step, -k * step))


def _names(target: str) -> str:
    """Columns are named after the first three letters of the target."""
    return target[:3]


def lag_columns(target: str, lags, key: str, step: int) -> dict[str, Column]:
    return {f"{_names(target)}_lag_{k}": _lag(F.col(target), k, key, step) for k in lags}


def add_lags(df: DataFrame, target: str = "departures", lags=LAGS, key: str = "station_id", time: str = "time",
             step: int = HOUR_SECONDS) -> DataFrame:
    return _with_epoch(df, time).withColumns(lag_columns(target, lags, key, step)).drop("_epoch")


def time_shift_self_join(df: DataFrame, target: str, k: int, name: str, key: str = "station_id",
                         time: str = "time", step: int = HOUR_SECONDS) -> DataFrame:
    """The same shift written as an equi-join on (station, time + k steps); the window form needs one shuffle less."""
    moved = df.select(
        key, F.timestamp_seconds(F.unix_seconds(F.col(time)) + k * step).alias(time), F.col(target).alias(name)
    )
    return df.join(moved, [key, time], "left")


def _integral(df: DataFrame, target: str) -> bool:
    return isinstance(df.schema[target].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _prefix_sums(target: str, key: str) -> dict[str, Column]:
    """Count, sum and sum of squares of all earlier rows: exact integers, one running pass."""
    before = _order(key).rowsBetween(Window.unboundedPreceding, -1)
    y = F.col(target).cast("bigint")
    return {
        "_c0": F.count(y).over(before),
        "_c1": F.coalesce(F.sum(y).over(before), F.lit(0)),
        "_c2": F.coalesce(F.sum(y * y).over(before), F.lit(0)),
    }


def _rolling_from_prefix(target: str, windows, key: str, mean: bool, std: bool) -> dict[str, Column]:
    """Window statistics as differences of prefix sums: constant work per row for any window length."""
    out = {}
    for n in windows:
        size, total, squares = (F.col(c) - F.lag(c, n).over(_order(key)) for c in ("_c0", "_c1", "_c2"))
        full = F.col("_previous") & (size == n)
        if mean:
            out[f"{_names(target)}_roll_mean_{n}"] = F.when(full, total / F.lit(float(n)))
        if std:
            spread = (F.lit(n) * squares - total * total) / F.lit(float(n) * (n - 1)) if n > 1 else F.lit(None)
            out[f"{_names(target)}_roll_std_{n}"] = F.when(full, F.sqrt(spread))
    return out


def _moments(value: Column, frame) -> Column:
    """Count, mean and sum of squared deviations of a growing frame, updated row by row."""
    return F.struct(F.count(value).over(frame).alias("n"), F.avg(value).over(frame).alias("mean"),
                    (F.var_pop(value).over(frame) * F.count(value).over(frame)).alias("m2"))


def _joined(a: str, b: str) -> tuple[Column, Column, Column]:
    """Count, mean and squared deviations of two runs of rows taken together."""
    n = F.col(f"{a}.n") + F.coalesce(F.col(f"{b}.n"), F.lit(0))
    empty = F.coalesce(F.col(f"{b}.n"), F.lit(0)) == 0
    gap, share = F.col(f"{b}.mean") - F.col(f"{a}.mean"), F.try_divide(F.col(f"{b}.n"), n)
    mean = F.when(empty, F.col(f"{a}.mean")).otherwise(F.col(f"{a}.mean") + gap * share)
    m2 = F.col(f"{a}.m2") + F.col(f"{b}.m2") + gap * gap * F.col(f"{a}.n") * share
    return n, mean, F.when(empty, F.col(f"{a}.m2")).otherwise(m2)


def _rolling_from_blocks(df: DataFrame, target: str, windows, key: str, mean: bool, std: bool) -> DataFrame:
    """Window statistics of numbers that are not whole: constant work per row for any window length, nothing subtracted.

    A series is cut into blocks as long as the window. The n rows before a row are the end of one block and the start
    of the next, so their figures are joined from those of a run from the block's start up to the row before and of a run
    from n rows back to that block's end. Both runs grow inside their block, in either direction.
    """
    value = F.col(target).cast("double")
    out = df.withColumn("_row", F.row_number().over(_order(key)) - 1)
    for n in windows:
        out = out.withColumn("_block", F.floor(F.col("_row") / n))
        block = Window.partitionBy(key, "_block")
        out = out.withColumn("_up_to", _moments(value, block.orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        out = out.withColumn("_from", _moments(value, block.orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        out = out.withColumns({"_head": F.lag("_up_to", 1).over(_order(key)), "_tail": F.lag("_from", n).over(_order(key))})
        out = out.withColumn("_tail", F.when(F.col("_row") % n != 0, F.col("_tail")))
        size, average, spread = _joined("_head", "_tail")
        full = F.col("_previous") & (size == n)
        if mean:
            out = out.withColumn(f"{_names(target)}_roll_mean_{n}", F.when(full, average))
        if std:
            out = out.withColumn(f"{_names(target)}_roll_std_{n}", F.when(full, F.sqrt(spread / (n - 1)) if n > 1 else F.lit(None)))
        out = out.drop("_block", "_up_to", "_from", "_head", "_tail")
    return out.drop("_row")


def add_rolling(df: DataFrame, target: str = "departures", windows=ROLLING_WINDOWS, key: str = "station_id",
                time: str = "time", step: int = HOUR_SECONDS, mean: bool = True, std: bool = True) -> DataFrame:
    """Mean and sample deviation of the n rows before each row.

    The window counts rows, so it reaches across a season break, and it is null when the step just before
    is absent or when fewer than n rows precede.
    """
    base = _with_epoch(df, time).withColumn("_previous", _lag(F.col(target), 1, key, step).isNotNull())
    if _integral(df, target):
        out = base.withColumns(_prefix_sums(target, key)).withColumns(_rolling_from_prefix(target, windows, key, mean, std))
    else:
        out = _rolling_from_blocks(base, target, windows, key, mean, std)
    return out.drop("_epoch", "_previous", "_c0", "_c1", "_c2")


def _plus(values) -> Column:
    return reduce(lambda a, b: a + b, values)


def _same_hour_from(days, target: str, windows, mean: bool, std: bool) -> dict[str, Column]:
    """Mean and sample deviation over present values of the same hour on the previous days."""
    out = {}
    for n in windows:
        values = [F.col(days[i]).cast("double") for i in range(n)]
        size = _plus([v.isNotNull().cast("int") for v in values])
        average = F.when(size > 0, _plus([F.coalesce(v, F.lit(0.0)) for v in values]) / size)
        if mean:
            out[f"{_names(target)}_same_hour_mean_{n}d"] = average
        if std:
            squares = _plus([F.coalesce((v - average) * (v - average), F.lit(0.0)) for v in values])
            out[f"{_names(target)}_same_hour_std_{n}d"] = F.when(size > 1, F.sqrt(squares / (size - 1)))
    return out


def add_same_hour(df: DataFrame, target: str = "departures", windows=SAME_HOUR_WINDOWS, key: str = "station_id",
                  time: str = "time", step: int = HOUR_SECONDS, per_day: int = 24, mean: bool = True,
                  std: bool = True) -> DataFrame:
    days = [f"_day_{i}" for i in range(1, max(windows) + 1)]
    shifted = {name: _lag(F.col(target), i * per_day, key, step) for i, name in enumerate(days, 1)}
    out = _with_epoch(df, time).withColumns(shifted).withColumns(_same_hour_from(days, target, windows, mean, std))
    return out.drop("_epoch", *days)


def shift_weather(df: DataFrame, columns=WEATHER_COLUMNS, key: str = "station_id", time: str = "time",
                  step: int = HOUR_SECONDS) -> DataFrame:
    """Every weather column takes its value of one step before, so that a forecast cannot see the present."""
    moved = _with_epoch(df, time).withColumn("_w", _lag(F.struct(*columns), 1, key, step))
    return moved.withColumns({c: F.col(f"_w.{c}") for c in columns}).drop("_w", "_epoch")


def seasonal_naive(df: DataFrame, target: str = "departures", steps: int = 168, key: str = "station_id",
                   time: str = "time", step: int = HOUR_SECONDS, name: str = "forecast") -> DataFrame:
    """Forecast = the value one week before."""
    return _with_epoch(df, time).withColumn(name, _lag(F.col(target), steps, key, step)).drop("_epoch")


def demand_features(df: DataFrame, target: str = "departures", lags=LAGS, rolling_windows=ROLLING_WINDOWS,
                    same_hour_windows=SAME_HOUR_WINDOWS, weather_columns=(), key: str = "station_id",
                    time: str = "time", step: int = HOUR_SECONDS, per_day: int = 24) -> DataFrame:
    """All lag, rolling and same-hour columns with one shuffle; for whole-number targets with one sort and two Window nodes."""
    days = [f"_day_{i}" for i in range(1, max(same_hour_windows) + 1)]
    first = lag_columns(target, lags, key, step)
    first |= {name: _lag(F.col(target), i * per_day, key, step) for i, name in enumerate(days, 1)}
    first["_previous"] = _lag(F.col(target), 1, key, step).isNotNull()
    integral = _integral(df, target)
    if integral:
        first |= _prefix_sums(target, key)
    if weather_columns:
        first["_w"] = _lag(F.struct(*weather_columns), 1, key, step)
    out = _with_epoch(df, time).withColumns(first)

    second = _rolling_from_prefix(target, rolling_windows, key, True, True) if integral else {}
    second |= _same_hour_from(days, target, same_hour_windows, True, True)
    second |= {c: F.col(f"_w.{c}") for c in weather_columns}
    if not integral:
        out = _rolling_from_blocks(out, target, rolling_windows, key, True, True)
    return out.withColumns(second).drop("_epoch", "_previous", "_c0", "_c1", "_c2", "_w", *days)


def add_features(df: DataFrame, target: str = "departures", lags=LAGS, rolling_windows=ROLLING_WINDOWS,
                 same_hour_windows=SAME_HOUR_WINDOWS, weather_columns=WEATHER_COLUMNS, key: str = "station_id",
                 time: str = "time", step: int = HOUR_SECONDS, per_day: int = 24) -> DataFrame:
    """Complete feature set of an hourly table that already carries weather; rows with any null are dropped.

    Rows come back unordered: nothing downstream needs an order, and `sort_features` gives one for output.
    """
    out = demand_features(
        df, target, lags, rolling_windows, same_hour_windows, weather_columns, key, time, step, per_day
    )
    out = calendar_parts(out, time)
    if "precipitation" in out.columns:
        out = out.withColumn("rain", rain_flag(F.col("precipitation")))
    return drop_any_null(out)


def sort_features(df: DataFrame, time: str = "time", key: str = "station_id") -> DataFrame:
    return df.orderBy(time, key)


def sort_trips(trips: DataFrame, time: str = "departure") -> DataFrame:
    return trips.orderBy(F.asc_nulls_last(time))
