"""Joins, set operations, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise.checks.adapters import MONTHS, TOP
from tripwise.checks.registry import check
from tripwise.checks.table_queries import _NODES_SQL, _nodes
from tripwise.checks.views import WEATHER, latest_names, located, view
from tripwise.operators import features, grid, identity, locations, spatial, usage
from tripwise.operators.asof import asof_join_backward
from tripwise.operators.staging import as_lookup
from tripwise.plans.cleaning import clean_trips


def R(*names):
    """Rounded columns on the Spark side."""
    return [F.round(n, 4).alias(n) for n in names]


def S(*names):
    """The same in SQL."""
    return ", ".join(f"round({n}, 4) as {n}" for n in names)


view("by_id", """
select t.*, h.lat as departure_lat, h.lon as departure_lon, h.capacity as departure_capacity
from kept t left join (select * from padded where source = 'HSL') h on t.departure_id = h.id""")


@check("J1_join_station_by_id", f"select ride_id, {S('departure_lat', 'departure_lon')}, departure_capacity from by_id")
def _(t):
    out = locations.join_station_by_id(clean_trips(t.unified), locations.prepare_stations(t.stations), "departure")
    return out.select("ride_id", *R("departure_lat", "departure_lon"), "departure_capacity")


@check("J2_join_station_by_name", f"""
select ride_id, {S('departure_lat', 'departure_lon')}, departure_capacity from with_departure""")
def _(t):
    stations = locations.prepare_stations(t.stations)
    by_id = locations.join_station_by_id(clean_trips(t.unified), stations, "departure")
    out = locations.join_station_by_name(by_id, stations, "departure")
    return out.select("ride_id", *R("departure_lat", "departure_lon"), "departure_capacity")


view("with_return", located("kept", "return"))


@check("J3_merge_station_info", f"select ride_id, {S('return_lat', 'return_lon')}, return_capacity from with_return")
def _(t):
    out = locations.merge_station_info(clean_trips(t.unified), locations.prepare_stations(t.stations), "return")
    return out.select("ride_id", *R("return_lat", "return_lon"), "return_capacity")


@check("J4_join_usage_main_id", """
select u.id, u.name, u.n, m.main_id from usage u join main_ids m on u.name = m.name""")
def _(t):
    counts = identity.station_usage_counts(t.rides)
    return identity.join_usage_main_id(counts, identity.main_id_per_name(counts)).select("id", "name", "n", "main_id")


@check("J5_remap_ids", "select ride_id, departure_id, return_id from merged")
def _(t):
    counts = identity.station_usage_counts(t.rides)
    id_map = identity.id_merge_map(identity.join_usage_main_id(counts, identity.main_id_per_name(counts)))
    return identity.remap_ids(t.rides, as_lookup(id_map, stage="id-map")).select("ride_id", "departure_id", "return_id")


view("names_of_rides", latest_names("rides"))


@check("J6_remap_names", """
select r.ride_id, d.name as departure_name, b.name as return_name from rides r
left join names_of_rides d on r.departure_id = d.id left join names_of_rides b on r.return_id = b.id""")
def _(t):
    names = as_lookup(identity.latest_name_per_id(t.rides), stage="names")
    return identity.remap_names(t.rides, names).select("ride_id", "departure_name", "return_name")


_OFFICIAL_SQL = "select c_name as name from customer where c_custkey % 2 = 0"


def _official(t):
    even = t.read("customer").filter(F.col("c_custkey") % 2 == 0)
    return even.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit(60.0).alias("lat"),
        F.lit(24.0).alias("lon"), F.lit(20).alias("capacity"),
    )


@check("J7_anti_join_by_name", f"select * from ({_NODES_SQL}) where name not in ({_OFFICIAL_SQL})")
def _(t):
    return locations.anti_join_by_name(_nodes(t), _official(t))


view("dep_counts", """
select departure_name as station, departure_lat as lat, departure_lon as lon, count(*) as departures
from clean where departure_name is not null and departure_lat is not null and departure_lon is not null group by 1, 2, 3""")
view("ret_counts", """
select return_name as station, return_lat as lat, return_lon as lon, count(*) as returns
from clean where return_name is not null and return_lat is not null and return_lon is not null group by 1, 2, 3""")
view("station_totals", """
select coalesce(d.station, r.station) as station, coalesce(d.lat, r.lat) as lat, coalesce(d.lon, r.lon) as lon,
  coalesce(departures, 0) as departures, coalesce(returns, 0) as returns,
  coalesce(departures, 0) + coalesce(returns, 0) as total_trips
from dep_counts d full join ret_counts r on d.station = r.station and d.lat = r.lat and d.lon = r.lon""")


@check("J8_full_outer_counts", f"select station, {S('lat', 'lon')}, departures, returns from station_totals")
def _(t):
    out = spatial.full_outer_counts(spatial.station_departures(t.clean), spatial.station_returns(t.clean))
    return out.select("station", *R("lat", "lon"), "departures", "returns")


@check("J9_join_station_coords", f"""
select c.station_id, c.time, c.departures, {S('lat', 'lon')}, capacity
from (select departure_id as station_id, date_trunc('hour', departure) as time, count(*) as departures
  from clean group by 1, 2) c left join locations l on l.station_id = c.station_id""")
def _(t):
    at = as_lookup(locations.first_location_per_id(t.clean), stage="locations")
    out = locations.join_station_coords(grid.hourly_departures(t.clean), at)
    return out.select("station_id", "time", "departures", *R("lat", "lon"), "capacity")


@check("J10_join_weather_exact", f"""
select h.time, h.departures, {S(*WEATHER[:3])}, precip_missing, ws_missing
from hourly h left join weather_clean w on w.time = h.time""")
def _(t):
    out = grid.join_weather_exact(grid.hourly_total(t.clean, MONTHS), t.clean_weather)
    return out.select("time", "departures", *R(*WEATHER[:3]), "precip_missing", "ws_missing")


view("late_weather", """
select time + to_seconds(case hour(time) % 3 when 0 then 0 when 1 then 30 else 90 end) as seen_at,
  temperature, precipitation from weather""")


@check("J11_asof_join_backward", f"""
select r.ride_id, r.departure, case when r.departure - w.seen_at <= interval 1 minute then round(w.temperature, 4) end as temperature,
  case when r.departure - w.seen_at <= interval 1 minute then w.precipitation end as precipitation
from rides r asof left join late_weather w on r.departure >= w.seen_at""")
def _(t):
    delay = F.when(F.hour("time") % 3 == 0, 0).when(F.hour("time") % 3 == 1, 30).otherwise(90)
    late = t.weather.select(
        F.timestamp_seconds(F.unix_seconds("time") + delay).alias("departure"), "temperature", "precipitation"
    )
    out = asof_join_backward(t.rides.select("ride_id", "departure"), late, "departure", 60)
    return out.select("ride_id", "departure", *R("temperature"), "precipitation")


@check("J12_cross_join_spine", """
select station_id, time from (select distinct departure_id as station_id from clean) cross join season_hours""")
def _(t):
    stations = t.clean.select(F.col("departure_id").alias("station_id"))
    return grid.cross_join_spine(stations, grid.hour_bounds(t.clean), MONTHS)


@check("J13_spine_fill_zero", "select station_id, time, departures from demand")
def _(t):
    kept = grid.semi_join_top(t.clean, grid.top_n_stations(t.clean, TOP))
    return grid.spine_fill_zero(grid.hourly_departures(kept), grid.hour_bounds(t.clean), MONTHS)


@check("J14_semi_join_top", "select ride_id, departure_id from clean where departure_id in (select station_id from top_stations)")
def _(t):
    return grid.semi_join_top(t.clean, grid.top_n_stations(t.clean, TOP)).select("ride_id", "departure_id")


def demand(t):
    """Zero-filled hourly demand of the busiest stations, written once: window queries start from it."""
    def build():
        kept = grid.semi_join_top(t.clean, grid.top_n_stations(t.clean, TOP))
        return grid.spine_fill_zero(grid.hourly_departures(kept), grid.hour_bounds(t.clean), MONTHS)

    return t.staged("demand", build)


@check("J15_time_shift_self_join", """
select a.station_id, a.time, a.departures, b.departures as dep_lag_24
from demand a left join demand b on a.station_id = b.station_id and a.time = b.time + interval 24 hour""")
def _(t):
    return features.time_shift_self_join(demand(t), "departures", 24, "dep_lag_24").select(
        "station_id", "time", "departures", "dep_lag_24"
    )


view("route_counts", """
select least(departure_name, return_name) as station_a, greatest(departure_name, return_name) as station_b,
  station_a || ' ↔ ' || station_b as pair_key, count(*) as trip_count
from clean group by 1, 2 order by trip_count desc, pair_key limit 20""")
view("points", """
select departure_name as station, departure_lat as lat, departure_lon as lon from clean
qualify row_number() over (partition by departure_name order by departure, departure_lat, departure_lon) = 1""")
_ROUTES_SQL = """
select r.pair_key, r.station_a, r.station_b, r.trip_count, round(a.lat, 4) as lat_a, round(a.lon, 4) as lon_a,
  round(b.lat, 4) as lat_b, round(b.lon, 4) as lon_b{extra}
from route_counts r left join points a on a.station = r.station_a left join points b on b.station = r.station_b"""
_ENDS = ("lat_a", "lon_a", "lat_b", "lon_b")


@check("J16_route_endpoints", _ROUTES_SQL.format(extra=""))
def _(t):
    out = spatial.route_endpoints(spatial.top_route_counts(t.clean), spatial.station_points(t.clean))
    return out.select("pair_key", "station_a", "station_b", "trip_count", *R(*_ENDS))


@check("A20_top_routes", _ROUTES_SQL.format(extra=", r.pair_key || ': ' || r.trip_count || ' trips' as label"))
def _(t):
    # trips with one name unknown count for no route
    half = t.clean.withColumn("return_name", F.lit(None).cast("string"))
    other = t.clean.withColumn("departure_name", F.lit(None).cast("string"))
    return spatial.top_routes(t.clean.unionByName(half.unionByName(other).filter("ride_id % 5 = 0"))).select(
        "pair_key", "station_a", "station_b", "trip_count", *R(*_ENDS), "label"
    )


view("usage_rank", """
select departure_id as station_id, count(*) as total, row_number() over (order by count(*) desc, departure_id) as rank
from clean group by 1""")


@check("J17_ordered_lookup", """
select u.station_id, u.total, u.rank, n.name from usage_rank u left join station_names n on n.id = u.station_id""")
def _(t):
    counted = t.clean.select(F.col("departure_id").alias("station_id"), F.lit(1).alias("departures"))
    ranked = usage.station_demand_rank(counted)
    names = as_lookup(identity.latest_name_per_id(identity.merge_station_ids(t.rides)), stage="names")
    return identity.ordered_lookup(ranked, names).select("station_id", "total", "rank", "name")


# ---- set operations ----------------------------------------------------------------------------------


@check("U1_union_all", """
select ride_id, departure_id as station_id, departure_name as name from clean
union all select ride_id, return_id, return_name from clean""")
def _(t):
    def side(s):
        return t.clean.select("ride_id", F.col(f"{s}_id").alias("station_id"), F.col(f"{s}_name").alias("name"))

    return usage.union_all(side("departure"), side("return"))


@check("U2_combine_stations", f"""
select c_custkey::varchar as id, c_name as name, 60.0::double as lat, 24.0::double as lon, 20 as capacity, 'HSL' as source
from customer where c_custkey % 2 = 0
union all select '', name, lat, lon, capacity, 'OSM' from ({_NODES_SQL}) where name not in ({_OFFICIAL_SQL})""")
def _(t):
    return locations.combine_stations(_nodes(t), _official(t)).select("id", "name", "lat", "lon", "capacity", "source")


# ---- sorts, limits, top-k ----------------------------------------------------------------------------


@check("L1_sort_trips", "select ride_id, departure, departure_id from rides order by departure nulls last")
def _(t):
    return features.sort_trips(t.rides).select("ride_id", "departure", "departure_id")


@check("L2_sort_features", "select time, station_id, departures from daily_orders order by time, station_id")
def _(t):
    return features.sort_features(t.daily_orders).select("time", "station_id", "departures")


@check("L3_top_n_stations", """
select station_id, cast(sum(departures) as bigint) as trips from daily_orders group by 1 order by 2 desc, 1 limit 10""")
def _(t):
    trips = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return grid.top_n_stations(trips.withColumn("station", F.col("c_nationkey").cast("string")), 10, "station")


@check("L4_top_10_stations", f"""
select station, {S('lat', 'lon')}, departures, returns, total_trips from station_totals
order by total_trips desc, station, lat, lon limit 10""")
def _(t):
    out = spatial.top_stations(spatial.station_total_trips(t.clean, sort=False))
    return out.select("station", *R("lat", "lon"), "departures", "returns", "total_trips")


@check("L5_pick_ranks", """
select station_id, total, rank from (select station_id, cast(sum(departures) as bigint) as total,
  row_number() over (order by sum(departures) desc, station_id) as rank from daily_orders group by 1)
where rank in (1, 10, 25)""")
def _(t):
    ranked = usage.station_demand_rank(t.daily_orders)
    return usage.pick_ranks(ranked, (0, 9, 24)).select("station_id", "total", "rank")
