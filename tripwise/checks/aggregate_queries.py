"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise.checks.adapters import MONTHS, TOP
from tripwise.checks.join_queries import R, S
from tripwise.checks.registry import check, view
from tripwise.functions import columns as C
from tripwise.operators import gaps, grid, identity, metrics, quantiles, spatial, stats, usage
from tripwise.plans import report


@check("A1_station_usage_counts", "select id, name, n from usage")
def _(t):
    return identity.station_usage_counts(t.rides)


@check("A2_main_id_per_name", "select name, main_id from main_ids")
def _(t):
    return identity.main_id_per_name(identity.station_usage_counts(t.rides))


@check("A3_id_merge_map", "select id, main_id from id_map")
def _(t):
    counts = identity.station_usage_counts(t.rides)
    return identity.id_merge_map(identity.join_usage_main_id(counts, identity.main_id_per_name(counts)))


@check("A4_latest_name_per_id", "select id, name from names_of_rides where id is not null")
def _(t):
    return identity.latest_name_per_id(t.rides)


@check("A5_value_counts", "select departure_id, count(*) as n from clean group by 1 order by n desc, 1")
def _(t):
    return grid.value_counts(t.clean, "departure_id")


@check("A6_hourly_departures", """
select departure_id as station_id, date_trunc('hour', departure) as time, count(*) as departures from clean group by 1, 2""")
def _(t):
    return grid.hourly_departures(t.clean)


@check("A7_hourly_total", "select time, departures from hourly")
def _(t):
    return grid.hourly_total(t.clean, MONTHS)


def hourly(t):
    return t.staged("hourly", lambda: grid.hourly_total(t.clean, MONTHS))


def orders_daily(t):
    """Several years of daily totals."""
    day = F.to_date("time").alias("date")
    return t.daily_orders.groupBy(day).agg(F.sum("departures").cast("bigint").alias("departures"))


@check("A8_daily_total", "select date, departures from daily")
def _(t):
    return usage.daily_total(hourly(t))


@check("A9_yearly_usage", "select cast(year(o_orderdate) as integer) as year, count(*) as trips from orders group by 1")
def _(t):
    return usage.yearly_usage(t.read("orders"), "o_orderdate")


_MEAN = "round(avg(departures), 4) as mean_departures"


@check("A10_monthly_usage", f"select cast(month(date) as integer) as month, {_MEAN} from orders_daily group by 1")
def _(t):
    return usage.monthly_usage(orders_daily(t)).select("month", *R("mean_departures"))


@check("A11_monthly_usage_by_year", f"""
select cast(year(date) as integer) as year, cast(month(date) as integer) as month, {_MEAN} from orders_daily group by 1, 2""")
def _(t):
    return usage.monthly_usage_by_year(orders_daily(t)).select("year", "month", *R("mean_departures"))


@check("A12_weekday_usage", f"select cast(isodow(date) - 1 as integer) as weekday, {_MEAN} from orders_daily group by 1")
def _(t):
    return usage.weekday_usage(orders_daily(t)).select("weekday", *R("mean_departures"))


@check("A12b_daily_profiles", f"""
select case when grouping(weekday) = 0 then 'weekday' when grouping(year) = 0 then 'monthly_by_year' else 'monthly' end as profile,
  year, month, weekday, {_MEAN} from (
  select cast(year(date) as integer) as year, cast(month(date) as integer) as month, cast(isodow(date) - 1 as integer) as weekday,
    departures from orders_daily) group by grouping sets ((month), (year, month), (weekday))""")
def _(t):
    return usage.daily_profiles(orders_daily(t)).select("profile", "year", "month", "weekday", *R("mean_departures"))


@check("A13_hourly_usage", f"select cast(hour(time) as integer) as hour, {_MEAN} from hourly group by 1")
def _(t):
    return usage.hourly_usage(hourly(t)).select("hour", *R("mean_departures"))


@check("A14_hourly_usage_by_year", f"""
select cast(year(time) as integer) as year, cast(hour(time) as integer) as hour, {_MEAN} from daily_orders group by 1, 2""")
def _(t):
    return usage.hourly_usage_by_year(t.daily_orders).select("year", "hour", *R("mean_departures"))


@check("A15_hourly_usage_by_daytype", f"""
select isodow(time) >= 6 as is_weekend, cast(hour(time) as integer) as hour, {_MEAN} from hourly group by 1, 2""")
def _(t):
    return usage.hourly_usage_by_daytype(hourly(t)).select("is_weekend", "hour", *R("mean_departures"))


@check("A15b_hourly_profiles", f"""
select case when grouping(is_weekend) = 0 then 'hourly_by_daytype' when grouping(year) = 0 then 'hourly_by_year' else 'hourly' end as profile,
  year, is_weekend, hour, {_MEAN} from (
  select cast(year(time) as integer) as year, isodow(time) >= 6 as is_weekend, cast(hour(time) as integer) as hour, departures from hourly)
group by grouping sets ((hour), (year, hour), (is_weekend, hour))""")
def _(t):
    return usage.hourly_profiles(hourly(t)).select("profile", "year", "is_weekend", "hour", *R("mean_departures"))


@check("A16_station_departures", f"select station, {S('lat', 'lon')}, departures from dep_counts")
def _(t):
    return spatial.station_departures(t.clean).select("station", *R("lat", "lon"), "departures")


@check("A17_station_returns", f"select station, {S('lat', 'lon')}, returns from ret_counts")
def _(t):
    return spatial.station_returns(t.clean).select("station", *R("lat", "lon"), "returns")


@check("A18_station_total_trips", f"""
select station, {S('lat', 'lon')}, departures, returns, total_trips from station_totals""")
def _(t):
    return spatial.station_total_trips(t.clean).select(
        "station", *R("lat", "lon"), "departures", "returns", "total_trips"
    )


@check("A19_top_station_pairs", """
select departure_name || ' → ' || return_name as station_pair, count(*) as trips from clean
group by 1 order by 2 desc, 1 limit 10""")
def _(t):
    return spatial.top_station_pairs(t.clean)


@check("A21_station_coverage", """
select * from (with u as (select station_id, sum(departures) as n, row_number() over (order by sum(departures) desc, station_id) as r
    from daily_orders group by 1),
  th as (select unnest([20, 50, 100, 150, 200, 250, 300, 350, 400, 450]) as threshold)
select threshold, count(*) as stations_kept, cast(sum(n) as bigint) as rides_kept,
  round(sum(n) / (select sum(departures) from daily_orders) * 100, 2) as rides_percent
from u join th on r <= threshold group by 1)""")
def _(t):
    return usage.station_coverage(t.daily_orders, station="station_id", weight="departures")


@check("A22_missing_summary", """
select column_name, missing, round(100.0 * missing / n, 3) as percent from (
  select 'temperature' as column_name, count(*) - count(temperature) as missing, count(*) as n from weather
  union all select 'wind_speed', count(*) - count(wind_speed), count(*) from weather
  union all select 'precipitation', count(*) - count(precipitation), count(*) from weather)""")
def _(t):
    return gaps.missing_summary(t.weather, ("temperature", "wind_speed", "precipitation"))


@check("A23_gap_lengths", """
select run_start, cast(max(gap) as bigint) as gap_length from wind_gaps where wind_speed is null and gap > 6 group by 1""")
def _(t):
    return gaps.gap_lengths(t.weather, "wind_speed", chunk="week")


def _describe_sql(column: str, source: str) -> str:
    rows = {
        "count": f"count({column})::double", "mean": f"avg({column})", "std": f"stddev_samp({column})",
        "min": f"min({column})", "25%": f"quantile_cont({column}, 0.25)", "50%": f"quantile_cont({column}, 0.5)",
        "75%": f"quantile_cont({column}, 0.75)", "max": f"max({column})",
    }
    return " union all ".join(
        f"select '{name}' as statistic, round({value}, 4) as value from {source}" for name, value in rows.items()
    )


@check("A24_describe_column", _describe_sql("duration", "clean"))
def _(t):
    return quantiles.describe_column(t.clean, "duration").select("statistic", *R("value"))


_CORR_COLUMNS = ("departures", "temperature", "wind_speed", "precipitation")
view("usage_weather", """
select h.time, h.departures, w.temperature, nullif(w.wind_speed, -1) as wind_speed,
  nullif(w.precipitation, -1) as precipitation, w.ws_missing, w.precip_missing
from hourly h left join weather_clean w on w.time = h.time""")


def _corr_sql() -> str:
    return " union all ".join(
        f"select '{a.capitalize()}' as a, '{b.capitalize()}' as b, round(corr({a}, {b}), 4) as r from usage_weather"
        for a in _CORR_COLUMNS for b in _CORR_COLUMNS
    )


@check("A25_weather_corr_matrix", _corr_sql())
def _(t):
    joined = report.hourly_with_weather(t.clean, t.clean_weather, MONTHS)
    known = C.sentinel_to_null(joined, ("wind_speed", "precipitation"))
    return stats.correlation_matrix(known, _CORR_COLUMNS).select("a", "b", *R("r"))


@check("A26_duration_distance_corr", "select round(corr(duration, distance), 4) as r from clean")
def _(t):
    return stats.pair_correlation(t.clean, "duration", "distance").select(*R("r"))


def _histogram_sql(column: str, source: str, bins: int) -> str:
    return f"""
select b.bin, round(lo + (hi - lo) * (b.bin - 1) / {bins}, 4) as bin_start, coalesce(n, 0) as n
from (select cast(unnest(range(1, {bins + 1})) as integer) as bin) b
cross join (select min({column}) as lo, max({column}) as hi from {source})
left join (
  select least(cast(floor({bins} * ({column} - lo) / (hi - lo)) as integer) + 1, {bins}) as bin, count(*) as n
  from {source} cross join (select min({column}) as lo, max({column}) as hi from {source})
  where {column} is not null group by 1) c on c.bin = b.bin"""


@check("A27_histogram", _histogram_sql("duration", "clean", 60))
def _(t):
    return stats.histogram(t.clean, "duration", 60).select("bin", *R("bin_start"), "n")


view("short_orders", """
select year(o_orderdate) >= 2000 as from_cutoff, o_totalprice / 10000 as x from orders where o_totalprice / 10000 < 40""")


@check("A28_histogram_by_cutoff", """
select g.from_cutoff, b.bin, round(lo + (hi - lo) * (b.bin - 1) / 50, 4) as bin_start, coalesce(n, 0) as n
from (select from_cutoff, min(x) as lo, max(x) as hi from short_orders group by 1) g
cross join (select cast(unnest(range(1, 51)) as integer) as bin) b
left join (
  select s.from_cutoff, least(cast(floor(50 * (x - lo) / (hi - lo)) as integer) + 1, 50) as bin, count(*) as n
  from short_orders s join (select from_cutoff, min(x) as lo, max(x) as hi from short_orders group by 1) e
    on e.from_cutoff = s.from_cutoff group by 1, 2) c on c.from_cutoff = g.from_cutoff and c.bin = b.bin""")
def _(t):
    scaled = t.read("orders").select("o_orderdate", (F.col("o_totalprice") / 10000).alias("x"))
    out = stats.histogram_by_cutoff(scaled, "x", "o_orderdate", 2000, below=40.0)
    return out.select("from_cutoff", "bin", *R("bin_start"), "n")


@check("A29_share_over_threshold", """
select year(o_orderdate) >= 2000 as from_cutoff, round(avg(cast(o_totalprice > 250000 as double)), 3) as share
from orders group by 1""")
def _(t):
    return stats.share_over_threshold(t.read("orders"), "o_totalprice", 250000, "o_orderdate", 2000)


_SPEED = "(distance / 1000) / (duration / 60)"


@check("A30_count_over_thresholds", f"""
select count(*) as rides, count(*) filter ({_SPEED} > 4) as over_4, count(*) filter ({_SPEED} > 5) as over_5,
  count(*) filter ({_SPEED} > 6) as over_6 from clean""")
def _(t):
    fast = t.clean.withColumn("speed", C.ride_speed(F.col("distance"), F.col("duration")))
    return stats.count_over_thresholds(fast, "speed", (4, 5, 6))


@check("A31_usage_quartile", f"""
select station, {S('lat', 'lon')}, total_trips, case when total_trips <= q[1] then 0 when total_trips <= q[2] then 1
  when total_trips <= q[3] then 2 else 3 end as usage_quartile
from station_totals cross join (select quantile_cont(total_trips, [0.25, 0.5, 0.75]) as q from station_totals)""")
def _(t):
    out = quantiles.usage_quartile(spatial.station_total_trips(t.clean, sort=False))
    return out.select("station", *R("lat", "lon"), "total_trips", "usage_quartile")


@check("A32_time_bounds", "select min(time) as first_time, max(time) as last_time from features")
def _(t):
    return grid.time_bounds(t.features)


@check("A33_dedupe_keys", """
select station_id, time, departures from daily_orders""")
def _(t):
    twice = t.daily_orders.select("*", F.lit(2).alias("source")).unionByName(
        t.daily_orders.select("station_id", "time", (F.col("departures") + 1000).alias("departures"), F.lit(3).alias("source"))
    )
    return grid.dedupe_keys(twice, ["station_id", "time"], ["source"]).drop("source")


@check("A34_distinct_rows", "select distinct departure_id, departure_name from clean")
def _(t):
    return stats.distinct_rows(t.clean, ["departure_id", "departure_name"])


@check("A35_regression_metrics", """
select round(avg(abs(departures - dep_lag_24)), 4) as mae, round(sqrt(avg((departures - dep_lag_24) ** 2)), 4) as rmse,
  round(1 - sum((departures - dep_lag_24) ** 2) / (var_pop(departures) * count(*)), 4) as r2 from features""")
def _(t):
    return metrics.regression_metrics(t.features, y="departures", predicted="dep_lag_24").select(*R("mae", "rmse", "r2"))


view("per_weekday", """
select weekday, avg(abs(departures - dep_lag_24)) as mae, sqrt(avg((departures - dep_lag_24) ** 2)) as rmse,
  1 - sum((departures - dep_lag_24) ** 2) / (var_pop(departures) * count(*)) as r2 from features group by 1""")


@check("A36_cv_summary", " union all ".join(
    f"select '{m}' as metric, round(avg({m}), 4) as mean, round(stddev_pop({m}), 4) as std from per_weekday"
    for m in ("mae", "rmse", "r2")))
def _(t):
    folds = metrics.regression_metrics(t.features, ("weekday",), "departures", "dep_lag_24")
    return metrics.cv_summary(folds).select("metric", *R("mean", "std"))


view("classes", """
select cast(departures > 0 as integer) as y, cast(dep_roll_mean_24 > 0.5 as integer) as yhat from features""")


def classes(t):
    return t.features.select(
        C.binary_target(F.col("departures")).alias("y"), (F.col("dep_roll_mean_24") > 0.5).cast("int").alias("yhat")
    )


@check("A37_confusion_matrix", """
select g.actual, g.predicted, count(c.y) as n
from (values (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted)
left join classes c on c.y = g.actual and c.yhat = g.predicted group by 1, 2""")
def _(t):
    return metrics.confusion_matrix(classes(t))


@check("A38_classification_report", """
select * from (with k as (
  select u.k, count(*) filter (y = u.k and yhat = u.k) as hit, count(*) filter (y = u.k) as support,
    count(*) filter (yhat = u.k) as claimed from classes cross join (values (0), (1)) u(k) group by 1),
 m as (select k, support, case when claimed = 0 then 0 else hit / claimed end as p,
    case when support = 0 then 0 else hit / support end as r, hit from k),
 f as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1 from m)
select k::varchar as label, round(p, 4) as precision, round(r, 4) as recall, round(f1, 4) as f1, support from f
union all select 'accuracy', round(sum(hit) / sum(support), 4), round(sum(hit) / sum(support), 4),
  round(sum(hit) / sum(support), 4), cast(sum(support) as bigint) from f
union all select 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f1), 4), cast(sum(support) as bigint) from f
union all select 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), cast(sum(support) as bigint) from f)""")
def _(t):
    return metrics.classification_report(classes(t)).select("label", *R("precision", "recall", "f1"), "support")


@check("A39_hexbin_counts", """
select i, j, count(*) as n, round(log10(count(*)), 4) as log10_n from (
  select case when d0 < d1 then i0 else i1 end as i, case when d0 < d1 then j0 else j1 end as j from (
    select *, (u - i0) ** 2 + 3 * (v - j0) ** 2 as d0, (u - i1) ** 2 + 3 * (v - j1) ** 2 as d1 from (
      select u, v, round_even(u, 0) as i0, round_even(v, 0) as j0, floor(u) + 0.5 as i1, floor(v) + 0.5 as j1 from (
        select (dep_roll_mean_24 - x0) / ((x1 - x0) / 50) as u, (e - y0) / ((y1 - y0) / 28) as v
        from (select dep_roll_mean_24, departures - dep_roll_mean_24 as e from features)
        cross join (select min(dep_roll_mean_24) as x0, max(dep_roll_mean_24) as x1,
          min(departures - dep_roll_mean_24) as y0, max(departures - dep_roll_mean_24) as y1 from features)))))
group by 1, 2""")
def _(t):
    error = C.residual(F.col("departures"), F.col("dep_roll_mean_24"))
    return stats.hexbin_counts(t.features.withColumn("e", error), "dep_roll_mean_24", "e").select("i", "j", "n", *R("log10_n"))


@check("A40_scatter_density", """
select least(cast(floor(50 * (x - x0) / (x1 - x0)) as integer) + 1, 50) as x_bin,
  least(cast(floor(50 * (y - y0) / (y1 - y0)) as integer) + 1, 50) as y_bin, count(*) as n
from (select temperature as x, departures as y from usage_weather where temperature is not null)
cross join (select min(temperature) as x0, max(temperature) as x1, min(departures)::double as y0, max(departures)::double as y1
  from usage_weather where temperature is not null) group by 1, 2""")
def _(t):
    joined = report.hourly_with_weather(t.clean, t.clean_weather, MONTHS)
    return stats.scatter_density(joined, "temperature", "departures", 50)


@check("A41_station_demand_rank", """
select station_id, cast(sum(departures) as bigint) as total, row_number() over (order by sum(departures) desc, station_id) as rank
from daily_orders group by 1""")
def _(t):
    train = t.daily_orders.filter(F.year("time") < 2001)
    test = t.daily_orders.filter(F.year("time") >= 2001)
    return usage.station_demand_rank(train, test).select("station_id", "total", "rank")


@check("A42_row_count", "select count(*) as n_rows from features")
def _(t):
    return stats.row_count(t.features)


@check("A43_merge_station_ids", "select ride_id, departure_id, departure_name, return_id, return_name from merged")
def _(t):
    return identity.merge_station_ids(t.rides).select(
        "ride_id", "departure_id", "departure_name", "return_id", "return_name"
    )


@check("A44_update_station_names", "select ride_id, departure_id, departure_name, return_id, return_name from unified")
def _(t):
    merged = identity.merge_station_ids(t.rides)
    return identity.update_station_names(merged).select(
        "ride_id", "departure_id", "departure_name", "return_id", "return_name"
    )


def _cells_sql(x: str, where: str) -> str:
    return f"""(select count(*) from (select distinct
  least(cast(floor(50 * ({x} - x0) / (x1 - x0)) as integer) + 1, 50),
  least(cast(floor(50 * (departures - y0) / (y1 - y0)) as integer) + 1, 50)
  from usage_weather cross join (select min({x}) as x0, max({x}) as x1, min(departures)::double as y0,
    max(departures)::double as y1 from usage_weather where {where}) where {where}))"""


_REPORT_ROWS = {
    "histogram_duration": "60", "histogram_distance": "60", "histogram_speed": "60", "duration_by_cutoff": "50",
    "speed_counts": "1", "station_map": "(select count(*) from station_totals)",
    "top_stations": "(select least(count(*), 10) from station_totals)",
    "top_station_pairs": "(select least(count(*), 10) from (select distinct departure_name, return_name from clean))",
    "top_routes": "(select count(*) from route_counts)", "correlation": "16",
    "temperature_points": _cells_sql("temperature", "temperature is not null"),
    "wind_points": _cells_sql("wind_speed", "ws_missing = 0"),
    "rain_points": _cells_sql("precipitation", "precip_missing = 0"),
    "yearly": "(select count(distinct year(departure)) from clean)",
    "monthly": "(select count(distinct month(date)) from daily)",
    "monthly_by_year": "(select count(distinct (year(date), month(date))) from daily)",
    "weekday": "(select count(distinct isodow(date)) from daily)",
    "hourly": "(select count(distinct hour(time)) from hourly)",
    "hourly_by_year": "(select count(distinct (year(time), hour(time))) from hourly)",
    "hourly_by_daytype": "(select count(distinct (isodow(time) >= 6, hour(time))) from hourly)",
}


def _place_sql(column: str, lo: str, hi: str, bins: int) -> str:
    return f"least(cast(floor({bins} * ({column} - {lo}) / ({hi} - {lo})) as integer) + 1, {bins})"


def _bins_sql(column: str, bins: int, source: str = "clean", by: str = "1") -> str:
    """Sum of the bin numbers of all values; `by` gives every group its own range."""
    edges = f"min(x) over (partition by {by}) as lo, max(x) over (partition by {by}) as hi"
    return f"""(select sum({_place_sql('x', 'lo', 'hi', bins)}) from (
  select x, {edges} from (select *, {column} as x from {source}) where x is not null))"""


def _points_sql(x: str, where: str) -> str:
    return f"""(select sum({_place_sql(x, 'x0', 'x1', 50)} + 100 * {_place_sql('departures', 'y0', 'y1', 50)})
  from usage_weather cross join (select min({x}) as x0, max({x}) as x1, min(departures)::double as y0,
    max(departures)::double as y1 from usage_weather where {where}) where {where})"""


def _means_sql(source: str, *parts: str) -> str:
    """Sum of the means, each times one and the sum of what it is grouped by."""
    return f"(select sum(m * (1 + p)) from (select avg(departures) as m, any_value({' + '.join(parts)}) as p from {source} group by {', '.join(parts)}))"


# Per table: what its rows add up to, in Spark and in SQL. Bins and parts weigh in, so that a value in a wrong place shows.
_REPORT_TOTALS = {
    **{f"histogram_{c}": ("sum(bin * n)", _bins_sql(c, 60)) for c in ("duration", "distance")},
    "histogram_speed": ("sum(bin * n)", _bins_sql(f"({_SPEED})", 60)),
    "duration_by_cutoff": ("sum(bin * n)", _bins_sql(
        "duration", 50, "(select duration, year(departure) >= 2024 as late from clean where duration < 60)", "late")),
    "speed_counts": ("sum(rides + over_20 + 2 * over_30 + 3 * over_40)", f"""(select count(*) + count(*) filter ({_SPEED} > 20)
  + 2 * count(*) filter ({_SPEED} > 30) + 3 * count(*) filter ({_SPEED} > 40) from clean)"""),
    "station_map": ("sum(total_trips * (1 + usage_quartile))", """(select sum(total_trips * (case when total_trips <= q[1] then 1
  when total_trips <= q[2] then 2 when total_trips <= q[3] then 3 else 4 end))
  from station_totals cross join (select quantile_cont(total_trips, [0.25, 0.5, 0.75]) as q from station_totals))"""),
    "top_stations": ("sum(total_trips + departures)", """(select sum(total_trips + departures) from (
  select * from station_totals order by total_trips desc, station, lat, lon limit 10))"""),
    "top_station_pairs": ("sum(trips)", """(select sum(trips) from (select count(*) as trips from clean
  where departure_name is not null and return_name is not null group by departure_name, return_name order by 1 desc limit 10))"""),
    "top_routes": ("sum(trip_count)", "(select sum(trip_count) from route_counts)"),
    "correlation": ("sum(r)", f"(select sum(r) from ({' union all '.join(f'select corr({a}, {b}) as r from usage_weather' for a in _CORR_COLUMNS for b in _CORR_COLUMNS)}))"),
    "temperature_points": ("sum((x_bin + 100 * y_bin) * n)", _points_sql("temperature", "temperature is not null")),
    "wind_points": ("sum((x_bin + 100 * y_bin) * n)", _points_sql("wind_speed", "ws_missing = 0")),
    "rain_points": ("sum((x_bin + 100 * y_bin) * n)", _points_sql("precipitation", "precip_missing = 0")),
    "yearly": ("sum(year * trips)", "(select sum(year(departure)) from clean)"),
    "monthly": ("sum(mean_departures * (1 + month))", _means_sql("daily", "month(date)")),
    "monthly_by_year": ("sum(mean_departures * (1 + year + month))", _means_sql("daily", "year(date)", "month(date)")),
    "weekday": ("sum(mean_departures * (1 + weekday))", _means_sql("daily", "(isodow(date) - 1)")),
    "hourly": ("sum(mean_departures * (1 + hour))", _means_sql("hourly", "hour(time)")),
    "hourly_by_year": ("sum(mean_departures * (1 + year + hour))", _means_sql("hourly", "year(time)", "hour(time)")),
    "hourly_by_daytype": ("sum(mean_departures * (1 + int(is_weekend) + hour))", _means_sql("hourly", "(isodow(time) >= 6)::int", "hour(time)")),
}


@check("A45_eda_report", " union all ".join(
    f"select '{name}' as report, cast({rows} as bigint) as n_rows, round(cast({_REPORT_TOTALS[name][1]} as double), 4) as total"
    for name, rows in _REPORT_ROWS.items()))
def _(t):
    tables = report.eda_report(t.clean, t.clean_weather, MONTHS)
    return usage.union_all(*[
        df.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows"),
               F.round(F.expr(_REPORT_TOTALS[name][0]).cast("double"), 4).alias("total"))
        for name, df in tables.items()])
