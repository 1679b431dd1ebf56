"""Windows and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise.checks.adapters import MONTHS, TOP
from tripwise.checks.join_queries import R, S, demand
from tripwise.checks.registry import check, view
from tripwise.checks.views import LAG_STEPS, WEATHER, _FEATURES, day_list, rolling, time_lag
from tripwise.operators import features, folds, gaps
from tripwise.operators.grid import join_weather_exact
from tripwise.operators.staging import fresh_path
from tripwise.plans import incremental
from tripwise.plans.feature_table import aggregate_hourly_departures, build_feature_table
from tripwise.sources.writers import write_table

_KEY = ("station_id", "time", "departures")


@check("W1_add_lags", "select station_id, time, departures, "
       + ", ".join(f"{time_lag('departures', k)} as dep_lag_{k}" for k in LAG_STEPS) + " from demand")
def _(t):
    return features.add_lags(demand(t))


def _rolling_sql(function: str, name: str) -> str:
    return "select station_id, time, departures, " + ", ".join(
        f"round({rolling(function, n)}, 4) as dep_roll_{name}_{n}" for n in (3, 24, 168)) + " from demand"


@check("W2_rolling_mean", _rolling_sql("avg", "mean"))
def _(t):
    out = features.add_rolling(demand(t), std=False)
    return out.select(*_KEY, *R(*[f"dep_roll_mean_{n}" for n in (3, 24, 168)]))


@check("W3_rolling_std", _rolling_sql("stddev_samp", "std"))
def _(t):
    out = features.add_rolling(demand(t), mean=False)
    return out.select(*_KEY, *R(*[f"dep_roll_std_{n}" for n in (3, 24, 168)]))


def _real_rolling_sql(function: str, name: str) -> str:
    return "select station_id, time, departures / 7 as load, " + ", ".join(
        f"round({rolling(function, n).replace('departures', 'departures / 7')}, 4) as loa_roll_{name}_{n}" for n in (3, 24, 168)) + " from demand"


def _real_rolling(t, name: str, **parts):
    load = demand(t).select("station_id", "time", (F.col("departures") / 7).alias("load"))
    return features.add_rolling(load, "load", **parts).select("station_id", "time", "load", *R(*[f"loa_roll_{name}_{n}" for n in (3, 24, 168)]))


@check("W2b_rolling_mean_of_doubles", _real_rolling_sql("avg", "mean"))
def _(t):
    return _real_rolling(t, "mean", std=False)


@check("W3b_rolling_std_of_doubles", _real_rolling_sql("stddev_samp", "std"))
def _(t):
    return _real_rolling(t, "std", mean=False)


@check("W4_same_hour_mean", "select station_id, time, departures, " + ", ".join(
    f"round({day_list('avg', d)}, 4) as dep_same_hour_mean_{d}d" for d in (3, 7)) + " from same_hour_values")
def _(t):
    out = features.add_same_hour(demand(t), std=False)
    return out.select(*_KEY, *R("dep_same_hour_mean_3d", "dep_same_hour_mean_7d"))


@check("W5_same_hour_std", "select station_id, time, departures, " + ", ".join(
    f"round({day_list('stddev_samp', d)}, 4) as dep_same_hour_std_{d}d" for d in (3, 7)) + " from same_hour_values")
def _(t):
    out = features.add_same_hour(demand(t), mean=False)
    return out.select(*_KEY, *R("dep_same_hour_std_3d", "dep_same_hour_std_7d"))


@check("W6_shift_weather", "select station_id, time, departures, " + ", ".join(
    f"round({time_lag(w, 1)}, 4) as {w}" if w in WEATHER[:3] else f"{time_lag(w, 1)} as {w}" for w in WEATHER)
    + " from hourly_weather")
def _(t):
    out = features.shift_weather(join_weather_exact(demand(t), t.clean_weather))
    return out.select(*_KEY, *R(*WEATHER[:3]), *WEATHER[3:])


@check("W7_ffill_temperature", """
select time, round(last_value(temperature ignore nulls) over (order by time), 4) as temperature from weather""")
def _(t):
    return gaps.ffill(t.weather, "temperature", chunk="week").select("time", *R("temperature"))


@check("W8_null_run_id", """
select time, run_start, cast(case when wind_speed is null then gap else 0 end as bigint) as run_length from wind_gaps""")
def _(t):
    return gaps.null_run_id(t.weather, "wind_speed", chunk="week").select("time", "run_start", "run_length")


@check("W9_short_gap_fill", "select time, round(wind_speed, 4) as wind_speed from wind_filled")
def _(t):
    return gaps.fill_short_gaps(t.weather, "wind_speed", chunk="week").select("time", *R("wind_speed"))


@check("W10_long_gap_flag", """
select time, round(coalesce(wind_speed, -1), 4) as wind_speed, cast(wind_speed is null as integer) as ws_missing
from weather""")
def _(t):
    return gaps.long_gap_flag(t.weather).select("time", *R("wind_speed"), "ws_missing")


@check("W11_handle_wind_speed_gaps", """
select time, round(wind_speed, 4) as wind_speed, ws_missing from weather_clean""")
def _(t):
    return gaps.handle_wind_speed_gaps(t.weather, chunk="week").select("time", *R("wind_speed"), "ws_missing")


@check("W12_clean_weather", f"select time, {S(*WEATHER[:3])}, precip_missing, ws_missing from weather_clean")
def _(t):
    return gaps.clean_weather(t.weather, chunk="week").select("time", *R(*WEATHER[:3]), *WEATHER[3:])


@check("W13_sample_per_station", """
select station_id, time, departures from features qualify row_number() over (partition by station_id
  order by md5(station_id || '|' || strftime(time, '%Y-%m-%d %H:%M:%S')), time) <= 50""")
def _(t):
    return folds.sample_per_station(t.features, 50).select(*_KEY)


@check("W14_time_series_folds", """
select station_id, time, departures, cast(case when o < n - 7 * s then 0 else (o - (n - 7 * s)) // s + 1 end as integer) as fold
from (select *, row_number() over (order by time, station_id) - 1 as o, count(*) over () as n, count(*) over () // 8 as s
  from daily_orders)""")
def _(t):
    return folds.time_series_folds(t.daily_orders, 7).select(*_KEY, "fold")


@check("W15_week_slice", """
select station_id, time, departures, p - 105 as position from (
  select *, row_number() over (partition by station_id order by time) as p from daily_orders)
where p between 106 and 112""")
def _(t):
    out = folds.week_slice(t.daily_orders, start_day=105, per_day=1)
    return out.select(*_KEY, F.col("position").cast("bigint").alias("position"))


@check("W16_seasonal_naive", f"select station_id, time, departures, {time_lag('departures', 168)} as forecast from demand")
def _(t):
    return features.seasonal_naive(demand(t))


_ROUNDED = tuple(c for c in _FEATURES if "roll" in c or "same_hour" in c) + ("lat", "lon") + tuple(WEATHER[:3])
_EXACT = ("station_id", "time", "departures", "capacity", *WEATHER[3:], *[f"dep_lag_{k}" for k in LAG_STEPS],
          "hour", "weekday", "month", "is_weekend", "year", "rain")
_FEATURES_SQL = f"select {', '.join(_EXACT)}, {S(*_ROUNDED)} from features"


@check("W17_add_features", _FEATURES_SQL)
def _(t):
    table = join_weather_exact(aggregate_hourly_departures(t.clean, TOP, MONTHS), t.clean_weather)
    return features.add_features(table).select(*_EXACT, *R(*_ROUNDED))


@check("W18_build_feature_table", _FEATURES_SQL)
def _(t):
    return build_feature_table(t.clean, t.clean_weather, TOP, MONTHS).select(*_EXACT, *R(*_ROUNDED))


@check("W18b_rebuild_months", _FEATURES_SQL)
def _(t):
    """Built while the last month was half there, then that month written anew."""
    root = fresh_path(t.spark, "months")
    last = t.clean.agg(F.max("departure")).first()[0]
    month = last.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    stations = incremental.choose_stations(t.clean, f"{root}/stations", TOP)
    half = t.clean.filter(F.col("departure") < F.lit(month.replace(day=15)))
    early = incremental.features_since(half, t.clean_weather, stations, months=MONTHS)
    write_table(early, f"{root}/features", partition_by=incremental.PARTS)
    incremental.rebuild_months(t.clean, t.clean_weather, root, month, months=MONTHS)
    return incremental.read_months(t.spark, root).select(*_EXACT, *R(*_ROUNDED))
