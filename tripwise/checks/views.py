"""Subqueries for the oracle SQL: the adapters and the chain of cleaning and feature steps in plain SQL."""

from __future__ import annotations

from tripwise.checks.adapters import TOP
from tripwise.checks.registry import view

view("rides", """
select event_id as ride_id, ts as departure,
  ts + to_seconds(cast(floor(value * 60) as bigint) + event_id % 5) as return_ts,
  lpad(cast(user_id % 20 as varchar), 3, '0') as departure_id,
  case when user_id % 20 < 3 and event_id % 3 = 0 then 'Old ' else '' end
    || 'S' || lpad(cast(least(user_id % 20, 18) as varchar), 3, '0') as departure_name,
  lpad(cast((user_id * 7 + event_id) % 20 as varchar), 3, '0') as return_id,
  'S' || lpad(cast(least((user_id * 7 + event_id) % 20, 18) as varchar), 3, '0') as return_name,
  case when event_id % 101 = 0 then null else value * 100 end as distance,
  case when event_type = 'error' then null else cast(floor(value * 60) as double) end as duration
from events""")

view("stations", """
select case when n_nationkey < 12 then lpad(cast(n_nationkey as varchar), 3, '0') else '' end as id,
  'S' || lpad(cast(case when n_nationkey = 23 then 13 else n_nationkey end as varchar), 3, '0') as name,
  cast(60.1 + n_nationkey * 0.01 as double) as lat, cast(24.8 + n_nationkey * 0.02 as double) as lon,
  10 + n_nationkey as capacity, case when n_nationkey < 12 then 'HSL' else 'OSM' end as source
from nation where n_nationkey < 17 or n_nationkey = 23""")

view("weather", """
select t.time, w.temperature, w.wind_speed, w.precipitation
from (select unnest(generate_series((select min(date_trunc('hour', ts)) from events),
        (select max(date_trunc('hour', ts)) from events), interval 1 hour)) as time) t
left join (
  select date_trunc('hour', ts) as time,
    avg(case when event_type = 'view' then value end) as temperature,
    avg(case when event_type = 'click' and user_id % 8 = 0 then value end) as wind_speed,
    sum(case when event_type = 'purchase' then cast(floor(value / 40) as double) end) as precipitation
  from events group by 1) w on t.time = w.time""")

view("daily_orders", """
select cast(c_nationkey as varchar) as station_id, o_orderdate as time, count(*) as departures
from orders join customer on o_custkey = c_custkey group by 1, 2""")

view("usage", """
select id, name, count(*) as n from (
  select departure_id as id, departure_name as name from rides
  union all select return_id, return_name from rides)
where id is not null and name is not null group by 1, 2""")

view("main_ids", """
select name, id as main_id from usage
qualify row_number() over (partition by name order by n desc, id) = 1""")

view("id_map", """
select u.id, arg_max(m.main_id, u.name) as main_id from usage u join main_ids m on u.name = m.name group by u.id""")

view("merged", """
select r.ride_id, r.departure, r.return_ts, coalesce(d.main_id, r.departure_id) as departure_id, r.departure_name,
  coalesce(b.main_id, r.return_id) as return_id, r.return_name, r.distance, r.duration
from rides r left join id_map d on r.departure_id = d.id left join id_map b on r.return_id = b.id""")


def latest_names(source: str) -> str:
    """Newest name per id; names at departure win over names at return."""
    return f"""
select coalesce(d.id, r.id) as id, coalesce(d.name, r.name) as name from
 (select departure_id as id, departure_name as name from {source} where departure_name is not null
  qualify row_number() over (partition by departure_id order by departure desc nulls first, departure_name desc) = 1) d
full join
 (select return_id as id, return_name as name from {source} where return_name is not null
  qualify row_number() over (partition by return_id order by departure desc nulls first, return_name desc) = 1) r
on d.id = r.id"""


view("station_names", latest_names("merged"))

view("unified", """
select m.ride_id, m.departure, m.return_ts, m.departure_id, d.name as departure_name, m.return_id,
  b.name as return_name, m.distance, m.duration
from merged m left join station_names d on m.departure_id = d.id left join station_names b on m.return_id = b.id""")

view("kept", """
select * replace (duration / 60 as duration) from (
  select * replace (coalesce(duration, (epoch_us(return_ts) - epoch_us(departure)) / 1e6) as duration)
  from unified where month(departure) <> 3)
where ride_id is not null and departure is not null and return_ts is not null and departure_id is not null
  and departure_name is not null and return_id is not null and return_name is not null
  and distance is not null and duration is not null
  and duration / 60 > 1 and duration / 60 <= 300 and distance > 50 and distance < 15000""")

view("padded", """
select printf('%03d', coalesce(cast(nullif(trim(id), '') as integer), -1)) as id, name, lat, lon,
  cast(capacity as double) as capacity, source from stations""")


def located(source: str, side: str) -> str:
    return f"""
select t.*, coalesce(h.lat, o.lat) as {side}_lat, coalesce(h.lon, o.lon) as {side}_lon,
  coalesce(h.capacity, o.capacity) as {side}_capacity
from {source} t
left join (select * from padded where source = 'HSL') h on t.{side}_id = h.id
left join (select * from padded where source = 'OSM') o on t.{side}_name = o.name"""


view("with_departure", located("kept", "departure"))
view("clean", located("with_departure", "return"))

view("bounds", """
select min(date_trunc('hour', departure)) as lo, max(date_trunc('hour', departure)) as hi from clean""")

view("season_hours", """
select time from (select unnest(generate_series(lo, hi, interval 1 hour)) as time from bounds) where month(time) = 1""")

view("top_stations", f"""
select departure_id as station_id, count(*) as trips from clean where departure_id is not null
group by 1 order by 2 desc, 1 limit {TOP}""")

view("counts", """
select departure_id as station_id, date_trunc('hour', departure) as time, count(*) as departures
from clean where departure_id in (select station_id from top_stations) group by 1, 2""")

view("demand", """
select s.station_id, h.time, coalesce(c.departures, 0) as departures
from top_stations s cross join season_hours h left join counts c on c.station_id = s.station_id and c.time = h.time""")

view("hourly", """
select h.time, coalesce(c.n, 0) as departures from season_hours h
left join (select date_trunc('hour', departure) as time, count(*) as n from clean group by 1) c on c.time = h.time""")

view("daily", "select cast(time as date) as date, cast(sum(departures) as bigint) as departures from hourly group by 1")

view("orders_daily", "select time as date, cast(sum(departures) as bigint) as departures from daily_orders group by 1")

view("locations", """
select departure_id as station_id, departure_lat as lat, departure_lon as lon, departure_capacity as capacity
from clean qualify row_number() over (partition by departure_id
  order by departure, departure_lat, departure_lon, departure_capacity) = 1""")

view("wind_runs", """
select *, count(wind_speed) over (order by time) as run from weather""")

view("wind_gaps", """
select *, sum(case when wind_speed is null then 1 else 0 end) over (partition by run) as gap,
  max(wind_speed) over (partition by run) as held,
  min(case when wind_speed is not null then time end) over (partition by run) as run_start
from wind_runs""")

view("wind_filled", """
select time, temperature, precipitation,
  coalesce(wind_speed, case when gap between 1 and 6 then held end) as wind_speed from wind_gaps""")

view("weather_clean", """
select time, last_value(temperature ignore nulls) over (order by time) as temperature,
  coalesce(wind_speed, -1) as wind_speed, coalesce(precipitation, -1) as precipitation,
  cast(precipitation is null as integer) as precip_missing, cast(wind_speed is null as integer) as ws_missing
from wind_filled""")

LAG_STEPS = (1, 2, 3, 6, 12, 18, 24, 48, 72, 168)


def time_lag(column: str, hours: int) -> str:
    return (
        f"first_value({column}) over (partition by station_id order by time "
        f"range between interval {hours} hour preceding and interval {hours} hour preceding)"
    )


def rolling(function: str, n: int) -> str:
    frame = f"(partition by station_id order by time rows between {n} preceding and 1 preceding)"
    return (
        f"case when {time_lag('departures', 1)} is not null and count(departures) over {frame} = {n} "
        f"then {function}(departures) over {frame} end"
    )


view("same_hour_values", "select station_id, time, departures, " + ", ".join(
    f"{time_lag('departures', 24 * i)} as d{i}" for i in range(1, 8)) + " from demand")

view("hourly_weather", """
select d.station_id, d.time, d.departures, l.lat, l.lon, l.capacity, w.temperature, w.wind_speed, w.precipitation,
  w.precip_missing, w.ws_missing
from demand d left join locations l on l.station_id = d.station_id left join weather_clean w on w.time = d.time""")

WEATHER = ("temperature", "wind_speed", "precipitation", "precip_missing", "ws_missing")


def day_list(function: str, days: int) -> str:
    """An aggregate over the same hour of the last days; list aggregates skip nulls."""
    return f"list_aggregate([{', '.join(f'd{i}' for i in range(1, days + 1))}], '{function}')"


view("lagged", "select h.station_id, h.time, h.departures, h.lat, h.lon, h.capacity, "
     + ", ".join(f"{time_lag(w, 1)} as {w}" for w in WEATHER) + ", "
     + ", ".join(f"{time_lag('departures', k)} as dep_lag_{k}" for k in LAG_STEPS) + ", "
     + ", ".join(f"{rolling('avg', n)} as dep_roll_mean_{n}, {rolling('stddev_samp', n)} as dep_roll_std_{n}"
                 for n in (3, 24, 168)) + ", "
     + ", ".join(f"{time_lag('departures', 24 * i)} as d{i}" for i in range(1, 8))
     + " from hourly_weather h")

_FEATURES = (
    ["departures", "lat", "lon", "capacity", *WEATHER]
    + [f"dep_lag_{k}" for k in LAG_STEPS]
    + [f"dep_roll_{f}_{n}" for n in (3, 24, 168) for f in ("mean", "std")]
    + [f"dep_same_hour_{f}_{d}d" for d in (3, 7) for f in ("mean", "std")]
)

view("all_features", "select * exclude (d1, d2, d3, d4, d5, d6, d7), "
     + ", ".join(f"{day_list('avg', d)} as dep_same_hour_mean_{d}d, {day_list('stddev_samp', d)} as dep_same_hour_std_{d}d" for d in (3, 7))
     + """, cast(hour(time) as integer) as hour, cast(isodow(time) - 1 as integer) as weekday,
  cast(month(time) as integer) as month, cast(isodow(time) >= 6 as integer) as is_weekend,
  cast(year(time) as integer) as year, cast(coalesce(precipitation, 0) > 0 as integer) as rain from lagged""")

view("features", "select * from all_features where " + " and ".join(f"{c} is not null" for c in _FEATURES))
