"""Scans, sources and sinks; projections, filters and scalar functions."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from tripwise.checks.adapters import Tables
from tripwise.checks.registry import check
import tripwise.checks.views  # noqa: F401  (registers the views the SQL uses)
from tripwise.functions import columns as C
from tripwise.functions import timeparts as P
from tripwise.operators.learning import CATEGORIES, SELECTED_FEATURES, categorize, fit_regressor, predict, prepare, xy_split
from tripwise.operators.staging import fresh_path
from tripwise.plans.cleaning import clean_rides
from tripwise.sources import payloads, readers, schemas, writers
from tripwise.sources.zipped import open_store

RIDE_COLUMNS = ("departure", "return", "departure_id", "departure_name", "return_id", "return_name", "distance",
                "duration")
_RIDES_SQL = """select {id}departure, return_ts, departure_id, departure_name, return_id, return_name, distance, duration
from {source}"""


def rides_out(df, *extra):
    """Trip columns under names that are plain identifiers in SQL."""
    return df.select(*extra, *[F.col(c).alias("return_ts" if c == "return" else c) for c in RIDE_COLUMNS])


DERIVED = tuple(c for c in SELECTED_FEATURES if c.startswith(("dep_roll", "dep_same")) or c in ("temperature", "precipitation", "wind_speed"))


def rounded(df, columns, *extra):
    """All the columns, computed floats to four places."""
    return df.select(*extra, *[F.round(c, 4).alias(c) if c in DERIVED else F.col(c) for c in columns])


def rounded_sql(columns) -> str:
    return ", ".join(f"round({c}, 4) as {c}" if c in DERIVED else c for c in columns)


def raw_text(t: Tables):
    """Trips as they are landed: upper-case headers, times as text with some unreadable, padded names."""
    r = t.rides
    stamp = F.date_format("departure", writers.CSV_TIME)
    return r.select(
        F.col("ride_id").alias("Ride_ID"),
        F.when(F.col("ride_id") % 50 == 0, "unknown").otherwise(stamp).alias("Departure"),
        F.date_format("return", writers.CSV_TIME).alias("Return"),
        F.col("departure_id").alias("Departure_id"),
        F.concat(F.lit(" \t"), "departure_name", F.lit("\n ")).alias("Departure_name"),
        F.col("return_id").alias("Return_id"),
        F.concat("return_name", F.lit("  ")).alias("Return_name"),
        F.col("distance").alias("Distance"),
        F.col("duration").alias("Duration"),
    )


# ---- scans, sources, sinks ---------------------------------------------------------------------------


@check("S1_read_csv_typed", _RIDES_SQL.format(id="", source="rides"))
def _(t):
    path = fresh_path(t.spark, "rides-csv")
    writers.write_table(t.rides.select(*RIDE_COLUMNS), path, "csv")
    return rides_out(readers.read_csv_typed(t.spark, path, schemas.TRIPS, timestampFormat=writers.CSV_TIME))


@check("S2_read_trips_multi", """
select strftime(departure, '%Y-%m-%d %H:%M:%S.%f') as departure, strftime(return_ts, '%Y-%m-%d %H:%M:%S.%f') as return_ts,
  departure_id, departure_name, return_id, return_name, distance, duration from rides""")
def _(t):
    base = fresh_path(t.spark, "trips-by-year")
    text = {c: F.date_format(c, writers.CSV_TIME) for c in ("departure", "return")}
    landed = t.rides.withColumn("year", F.year("departure")).withColumns(text)
    for half in (0, 1):
        part = landed.filter(F.col("ride_id") % 2 == half).select(*RIDE_COLUMNS).toDF(*[c.title() for c in RIDE_COLUMNS])
        writers.write_table(part, f"{base}/{2023 + half}", "csv")
    years = [f"{base}/{year}" for year in range(2022, 2026)]
    return readers.read_trips_multi(t.spark, years).withColumnRenamed("return", "return_ts")


def zipped(trips):
    """One archive per Arrow batch, built in the executors: (path, content)."""

    def pack(batches):
        for i, batch in enumerate(batches):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("trips.csv", batch.to_csv(index=False))
                archive.writestr("readme.txt", "not a table")
            yield pd.DataFrame({"path": [f"trips-{i}.zip"], "content": [buffer.getvalue()]})

    return trips.mapInPandas(pack, "path string, content binary")


@check("S3_read_trips_zip", """
select strftime(departure, '%Y-%m-%d %H:%M:%S.%f') as departure, strftime(return_ts, '%Y-%m-%d %H:%M:%S.%f') as return_ts,
  departure_id, departure_name, return_id, return_name, distance, duration from rides""")
def _(t):
    text = {c: F.date_format(c, writers.CSV_TIME) for c in ("departure", "return")}
    landed = t.rides.select(*RIDE_COLUMNS).withColumns(text)
    return readers.unzip_trips(zipped(landed)).withColumnRenamed("return", "return_ts")


def write_archives(trips, path: str):
    """Write one archive of several members per Arrow batch from the executors; gives the members back."""

    def write(batches):
        part = TaskContext.get().partitionId()
        store, inside = open_store(path)
        for i, batch in enumerate(batches):
            store.create_dir(inside)
            pieces = [batch.iloc[at::3] for at in range(3)]
            with store.open_output_stream(f"{inside}/trips-{part}-{i}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for at, piece in enumerate(pieces):
                    archive.writestr(f"months/{at}.csv", piece.to_csv(index=False))
                archive.writestr("readme.txt", "not a table")
            yield pd.DataFrame({"members": [len(pieces)]})

    return trips.mapInPandas(write, "members int")


@check("S3b_read_zip_members", """
select strftime(departure, '%Y-%m-%d %H:%M:%S.%f') as departure, strftime(return_ts, '%Y-%m-%d %H:%M:%S.%f') as return_ts,
  departure_id, departure_name, return_id, return_name, distance, duration from rides""")
def _(t):
    path = fresh_path(t.spark, "archives")
    text = {c: F.date_format(c, writers.CSV_TIME) for c in ("departure", "return")}
    write_archives(t.rides.select(*RIDE_COLUMNS).withColumns(text), path).agg(F.sum("members")).collect()
    return readers.read_trips_zip(t.spark, path).withColumnRenamed("return", "return_ts")


@check("S4_parse_station_json", """
select 'smoove:' || c_custkey as id, c_name as name, 60 + c_nationkey * 0.01::double as lat,
  24 + c_nationkey * 0.02::double as lon, cast(c_custkey % 40 as integer) as capacity from customer""")
def _(t):
    station = F.struct(
        F.concat(F.lit("smoove:"), "c_custkey").alias("stationId"),
        F.col("c_name").alias("name"),
        (60 + F.col("c_nationkey") * F.lit(0.01)).alias("lat"),
        (24 + F.col("c_nationkey") * F.lit(0.02)).alias("lon"),
        (F.col("c_custkey") % 40).cast("int").alias("capacity"),
    )
    path = fresh_path(t.spark, "station-payload")
    payload = t.read("customer").select(F.struct(F.array(station).alias("vehicleRentalStations")).alias("data"))
    payload.write.json(path)
    return readers.parse_station_json(t.spark, path, multi_line=False)


@check("S4b_station_records", """
select case when c_custkey % 13 <> 0 then 'smoove:' || c_custkey end as id, c_name as name, 60 + c_nationkey * 0.01::double as lat,
  24 + c_nationkey * 0.02::double as lon, case when c_custkey % 11 <> 0 then cast(c_custkey % 40 as integer) end as capacity,
  concat_ws(', ', case when c_custkey % 13 = 0 then 'id is missing' end, case when c_custkey % 11 = 0 then 'capacity is not int' end) as reasons,
  case when c_custkey % 5 = 0 then 'open' end as state from customer""")
def _(t):
    """Payloads with a field of the wrong type, a required one that is missing and a new one."""
    key = F.col("c_custkey")

    def station(capacity):
        return F.to_json(F.struct(
            F.when(key % 13 != 0, F.concat(F.lit("smoove:"), key.cast("string"))).alias("stationId"), F.col("c_name").alias("name"),
            (60 + F.col("c_nationkey") * F.lit(0.01)).alias("lat"), (24 + F.col("c_nationkey") * F.lit(0.02)).alias("lon"),
            F.when(key % 5 == 0, F.lit("open")).alias("state"), capacity.alias("capacity")))

    text = F.when(key % 11 == 0, station(F.lit("many"))).otherwise(station((key % 40).cast("int")))
    path = fresh_path(t.spark, "drifting-payload")
    t.read("customer").select(F.concat(F.lit('{"data":{"vehicleRentalStations":['), text, F.lit("]}}"))).write.text(path)
    rows = payloads.station_records(payloads.read_documents(t.spark, path, multi_line=False))
    return rows.select("id", "name", "lat", "lon", "capacity", F.concat_ws(", ", "reasons").alias("reasons"),
                       F.try_variant_get("record", "$.state", "string").alias("state"))


def _node_payload(t, broken: int | None = None) -> str:
    """Written payloads; nodes whose capacity would be `broken` get one that is no number."""
    key = F.col("c_custkey")
    capacity = (key % 50).cast("string")
    if broken is not None:
        capacity = F.when(key % 50 == broken, "about fifty").otherwise(capacity)
    tags = F.map_filter(
        F.create_map(
            F.lit("name"), F.when(key % 7 != 0, F.col("c_name")),
            F.lit("capacity"), F.when(key % 3 != 0, capacity),
            F.lit("amenity"), F.lit("bicycle_rental"),
        ),
        lambda k, v: v.isNotNull(),
    )
    node = F.struct(
        (60 + F.col("c_nationkey") * F.lit(0.01)).alias("lat"), (24 + F.col("c_nationkey") * F.lit(0.02)).alias("lon"),
        tags.alias("tags"),
    )
    path = fresh_path(t.spark, "node-payload")
    t.read("customer").select(F.array(node).alias("elements")).write.json(path)
    return path


def _nodes(t):
    return readers.parse_osm_nodes(t.spark, _node_payload(t), multi_line=False)


_NODES_SQL = """
select c_name as name, 60 + c_nationkey * 0.01::double as lat, 24 + c_nationkey * 0.02::double as lon,
  case when c_custkey % 3 = 0 then 0 else cast(c_custkey % 50 as integer) end as capacity
from customer where c_custkey % 7 <> 0"""


@check("S5_parse_osm_nodes", _NODES_SQL)
def _(t):
    return _nodes(t)


@check("S5b_node_records", _NODES_SQL + " and (c_custkey % 3 = 0 or c_custkey % 50 <> 49)")
def _(t):
    """The same nodes; a capacity that is no number rejects its node instead of stopping the job."""
    documents = payloads.read_documents(t.spark, _node_payload(t, broken=49), multi_line=False)
    return payloads.accepted(payloads.node_records(documents)).select("name", "lat", "lon", "capacity")


@check("S6_parse_weather_arrays", """
select time, round(temperature, 4) as temperature, round(wind_speed, 4) as wind_speed, precipitation from weather""")
def _(t):
    hour = F.struct("time", "temperature", "wind_speed", "precipitation")
    day = t.weather.groupBy(F.to_date("time").alias("day")).agg(F.sort_array(F.collect_list(hour)).alias("h"))
    path = fresh_path(t.spark, "weather-payload")
    day.select(
        F.col("h.time").alias("times"), F.col("h.temperature").alias("t2m"), F.col("h.wind_speed").alias("ws_10min"),
        F.col("h.precipitation").alias("r_1h"),
    ).write.option("ignoreNullFields", False).json(path)
    rows = readers.parse_weather_arrays(t.spark, path, multi_line=False)
    return rows.withColumns({c: F.round(c, 4) for c in ("temperature", "wind_speed")})


@check("S7_write_table", """
select cast(year(departure) as integer) as year, ride_id, departure, return_ts, departure_id, departure_name, return_id,
  return_name, distance, duration from rides""")
def _(t):
    path = fresh_path(t.spark, "trips")
    writers.write_trips_by_year(t.rides, path)
    return rides_out(t.spark.read.parquet(path), "year", "ride_id")


@check("S8_write_train_test", """
select case when year(time) < 2001 then 'train' else 'test' end as split, station_id, time, departures
from daily_orders where year(time) <= 2001""")
def _(t):
    path = fresh_path(t.spark, "train-test")
    writers.write_train_test(t.daily_orders.withColumn("year", F.year("time")), path, test_year=2001)
    return t.spark.read.parquet(path).select("split", "station_id", "time", "departures")


@check("S7b_write_counted", """
select column_name, missing, round(100.0 * missing / n, 3) as percent, n as n_rows from (
  select 'distance' as column_name, count(*) - count(distance) as missing, count(*) as n from rides
  union all select 'duration', count(*) - count(duration), count(*) from rides
  union all select 'departure_id', count(*) - count(departure_id), count(*) from rides)""")
def _(t):
    done = writers.write_counted(t.rides, fresh_path(t.spark, "counted"), ("distance", "duration", "departure_id"))
    return done.missing_summary(t.spark).withColumn("n_rows", F.lit(done.rows).cast("bigint"))


@check("S9_save_load_model", "select station_id, time, true as same from features")
def _(t):
    ready = prepare(t.features)
    model = fit_regressor(ready, max_iter=2, max_depth=3)
    path = fresh_path(t.spark, "model")
    writers.save_model(model, path)
    both = predict(writers.load_model(path), predict(model, ready, "first"), "second")
    return both.select("station_id", "time", (F.col("first") == F.col("second")).alias("same"))


@check("S10_require_columns", f"select {rounded_sql(SELECTED_FEATURES)} from features")
def _(t):
    return rounded(C.require_columns(t.features, SELECTED_FEATURES), SELECTED_FEATURES)


# ---- projections, filters, scalar functions ----------------------------------------------------------


@check("P1_lowercase_columns", r"""
select ride_id, case when ride_id % 50 = 0 then 'unknown' else strftime(departure, '%Y-%m-%d %H:%M:%S.%f') end as departure,
  strftime(return_ts, '%Y-%m-%d %H:%M:%S.%f') as return_ts, departure_id, ' ' || chr(9) || departure_name || chr(10) || ' ' as departure_name,
  return_id, return_name || '  ' as return_name, distance, duration from rides""")
def _(t):
    return C.lowercase_columns(raw_text(t)).withColumnRenamed("return", "return_ts")


@check("P2_strip_names", "select ride_id, departure_name, return_name from rides")
def _(t):
    return C.strip_names(C.lowercase_columns(raw_text(t))).select("ride_id", "departure_name", "return_name")


@check("P3_coerce_timestamp", """
select ride_id, case when ride_id % 50 <> 0 then departure end as departure, return_ts from rides""")
def _(t):
    parsed = C.coerce_timestamp(C.lowercase_columns(raw_text(t)))
    return parsed.select("ride_id", "departure", F.col("return").alias("return_ts"))


@check("P4_filter_id_prefix", """
select cast(c_custkey as varchar) as id, c_name as name from customer where c_custkey % 5 <> 0""")
def _(t):
    key = F.col("c_custkey")
    ids = F.concat(F.when(key % 5 == 0, "other:").otherwise(C.STATION_ID_PREFIX), key.cast("string"))
    return C.filter_id_prefix(t.read("customer").select(ids.alias("id"), F.col("c_name").alias("name")))


@check("P5_tag_source", "select '' as id, c_name as name, 'OSM' as source from customer")
def _(t):
    customers = t.read("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return C.tag_source(customers, "OSM", blank_id=True).select("id", "name", "source")


@check("P6_zero_pad_id", """
select c_custkey, printf('%03d', case when c_custkey % 9 = 0 then -1 else c_custkey end) as id from customer""")
def _(t):
    key = F.col("c_custkey")
    text = F.when(key % 18 == 0, F.lit(None)).when(key % 9 == 0, "").otherwise(key.cast("string"))
    return t.read("customer").select("c_custkey", C.zero_pad_id(text).alias("id"))


@check("P7_exclude_month", "select o_orderkey, o_orderdate from orders where month(o_orderdate) <> 3")
def _(t):
    return P.exclude_month(t.read("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 3)


_COMPUTED = "(epoch_us(return_ts) - epoch_us(departure)) / 1e6"


def _computed():
    return C.duration_from_timestamps(F.col("departure"), F.col("return"))


@check("P8_duration_from_timestamps", f"select ride_id, round({_COMPUTED}, 4) as seconds from rides")
def _(t):
    return t.rides.select("ride_id", F.round(_computed(), 4).alias("seconds"))


@check("P9_duration_diff", f"select ride_id, round(abs({_COMPUTED} - duration), 4) as gap from rides")
def _(t):
    return t.rides.select("ride_id", F.round(C.duration_diff(_computed(), F.col("duration")), 4).alias("gap"))


@check("P10_fill_from", f"select ride_id, round(coalesce(duration, {_COMPUTED}), 4) as duration from rides")
def _(t):
    return t.rides.select("ride_id", F.round(C.fill_from(F.col("duration"), _computed()), 4).alias("duration"))


@check("P11_drop_any_null", _RIDES_SQL.format(id="ride_id, ", source="rides")
       + " where distance is not null and duration is not null")
def _(t):
    return rides_out(C.drop_any_null(t.rides), "ride_id")


@check("P12_seconds_to_minutes", "select ride_id, round(duration / 60, 4) as minutes from rides")
def _(t):
    return t.rides.select("ride_id", F.round(C.seconds_to_minutes(F.col("duration")), 4).alias("minutes"))


@check("P13_ride_outlier_filter", """
select ride_id, distance, duration from rides
where duration / 60 > 1 and duration / 60 <= 300 and distance > 50 and distance < 15000""")
def _(t):
    keep = C.is_plausible_ride(C.seconds_to_minutes(F.col("duration")), F.col("distance"))
    return t.rides.filter(keep).select("ride_id", "distance", "duration")


@check("P14_null_flag_sentinel", """
select time, coalesce(precipitation, -1) as precipitation, cast(precipitation is null as integer) as precip_missing
from weather""")
def _(t):
    return C.null_flag_sentinel(t.weather, "precipitation", "precip_missing").select(
        "time", "precipitation", "precip_missing"
    )


@check("P15_sentinel_to_null", """
select time, round(nullif(wind_speed, -1), 4) as wind_speed, nullif(precipitation, -1) as precipitation
from weather_clean""")
def _(t):
    return C.sentinel_to_null(t.clean_weather, ("wind_speed", "precipitation")).select(
        "time", F.round("wind_speed", 4).alias("wind_speed"), "precipitation"
    )


@check("P16_select_drop_rename_prefix", """
select ride_id, round(departure_lat, 4) as start_lat,
  round(departure_lon, 4) as start_lon, departure_name as station from clean""")
def _(t):
    part = t.clean.select("ride_id", "departure_name", "departure_lat", "departure_lon", "distance").drop("distance")
    part = part.withColumns({c: F.round(c, 4) for c in ("departure_lat", "departure_lon")})
    part = part.withColumnsRenamed({"departure_lat": "lat", "departure_lon": "lon", "departure_name": "station"})
    return C.add_prefix(part, "start_", ("lat", "lon"))


@check("P17_ride_speed", "select ride_id, round((distance / 1000) / (duration / 60), 6) as speed from clean")
def _(t):
    return t.clean.select("ride_id", F.round(C.ride_speed(F.col("distance"), F.col("duration")), 6).alias("speed"))


@check("P18_floor_hour", "select ride_id, date_trunc('hour', departure) as time from rides")
def _(t):
    return t.rides.select("ride_id", P.floor_hour(F.col("departure")).alias("time"))


@check("P19_calendar_parts", """
select o_orderkey, cast(hour(x) as integer) as hour, cast(isodow(x) - 1 as integer) as weekday,
  cast(month(x) as integer) as month, cast(isodow(x) >= 6 as integer) as is_weekend, cast(year(x) as integer) as year
from (select o_orderkey, o_orderdate + to_hours(o_orderkey % 24) as x from orders)""")
def _(t):
    moved = F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("o_orderkey") % 24 * 3600)
    return P.calendar_parts(t.read("orders").select("o_orderkey", moved.alias("time"))).drop("time")


@check("P20_rain_flag", """
select time, cast(coalesce(precipitation, 0) > 0 as integer) as rain from weather""")
def _(t):
    return t.weather.select("time", C.rain_flag(F.col("precipitation")).alias("rain"))


@check("P21_season_filter", """
select station_id, time, departures from daily_orders where month(time) between 4 and 10""")
def _(t):
    return P.season_filter(t.daily_orders)


@check("P22_year_split", """
select 'train' as part, station_id, time, departures from daily_orders where year(time) < 2001
union all select 'test', station_id, time, departures from daily_orders where year(time) = 2001""")
def _(t):
    train, test = P.year_split(t.daily_orders.withColumn("year", F.year("time")), 2001)
    parts = [df.select(F.lit(n).alias("part"), "station_id", "time", "departures") for n, df in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


@check("P23_xy_split", """
select departures as y, {columns} from features""".format(columns=rounded_sql(SELECTED_FEATURES)))
def _(t):
    return rounded(xy_split(t.features, SELECTED_FEATURES, "departures"), SELECTED_FEATURES, "y")


@check("P24_categorize", """
select station_id, time, {indexes} from features""".format(indexes=", ".join(
    f"cast(dense_rank() over (order by cast({c} as varchar)) - 1 as double) as {c}_index" for c in CATEGORIES)))
def _(t):
    indexed = categorize(t.features, CATEGORIES).transform(t.features)
    return indexed.select("station_id", "time", *[f"{c}_index" for c in CATEGORIES])


_ORDER_TIME = "o_orderdate + to_hours(o_orderkey % 24)"


def _order_hours(t):
    moved = F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("o_orderkey") % 24 * 3600)
    return t.read("orders").select("o_orderkey", moved.alias("utc_time"))


@check("P25_utc_to_local", f"""
select o_orderkey, ({_ORDER_TIME}) at time zone 'UTC' at time zone 'Europe/Helsinki' as local_time from orders""")
def _(t):
    return _order_hours(t).select("o_orderkey", P.utc_to_local(F.col("utc_time")).alias("local_time"))


@check("P26_local_to_utc", f"""
select o_orderkey, utc_time from (select o_orderkey, {_ORDER_TIME} as utc_time,
    year(({_ORDER_TIME}) at time zone 'UTC' at time zone 'Europe/Helsinki') as y from orders)
where utc_time >= make_timestamp(y, 4, 1, 0, 0, 0) at time zone 'Europe/Helsinki' at time zone 'UTC'
  and utc_time <= make_timestamp(y, 10, 31, 23, 59, 0) at time zone 'Europe/Helsinki' at time zone 'UTC'""")
def _(t):
    return P.local_season_filter(_order_hours(t), "utc_time")


@check("P27_pair_key_directed", "select ride_id, departure_name || ' → ' || return_name as pair from unified")
def _(t):
    return t.unified.select("ride_id", C.pair_key_directed(F.col("departure_name"), F.col("return_name")).alias("pair"))


_UNDIRECTED = "least(departure_name, return_name) || ' ↔ ' || greatest(departure_name, return_name)"


@check("P28_pair_key_undirected", f"""
select ride_id, {_UNDIRECTED} as pair from unified union all
select -ride_id, case when ride_id % 3 = 0 then {_UNDIRECTED} end as pair from unified""")
def _(t):
    name = F.when(F.col("ride_id") % 3 != 1, F.col("departure_name")), F.when(F.col("ride_id") % 3 != 2, F.col("return_name"))
    gaps = t.unified.select((-F.col("ride_id")).alias("ride_id"), name[0].alias("departure_name"), name[1].alias("return_name"))
    rides = t.unified.select("ride_id", "departure_name", "return_name").unionByName(gaps)
    return rides.select("ride_id", C.pair_key_undirected(F.col("departure_name"), F.col("return_name")).alias("pair"))


@check("P29_pair_key_split", """
select ride_id, least(departure_name, return_name) as station_a, greatest(departure_name, return_name) as station_b
from unified""")
def _(t):
    key = C.pair_key_undirected(F.col("departure_name"), F.col("return_name"))
    a, b = C.pair_key_split(F.col("pair"))
    return t.unified.select("ride_id", key.alias("pair")).select("ride_id", a.alias("station_a"), b.alias("station_b"))


@check("P30_quartile_color", """
select ride_id, case ride_id % 4 when 0 then '#ffffb2' when 1 then '#fecc5c' when 2 then '#fd8d3c'
  else '#e31a1c' end as color from rides""")
def _(t):
    return t.rides.select("ride_id", C.quartile_color((F.col("ride_id") % 4).cast("int")).alias("color"))


@check("P31_ordinal_label", """
select c_custkey, c_custkey || case when c_custkey % 100 between 10 and 20 then 'th' when c_custkey % 10 = 1 then 'st'
  when c_custkey % 10 = 2 then 'nd' when c_custkey % 10 = 3 then 'rd' else 'th' end as label from customer""")
def _(t):
    return t.read("customer").select("c_custkey", C.ordinal_label(F.col("c_custkey")).alias("label"))


@check("P32_binary_target", "select station_id, time, cast(departures > 0 as integer) as y from features")
def _(t):
    return t.features.select("station_id", "time", C.binary_target(F.col("departures")).alias("y"))


@check("P33_two_phase_combine", """
select station_id, time, case when dep_lag_1 > 0 then round(dep_roll_mean_24, 4) else 0.0 end as yhat from features""")
def _(t):
    active = C.binary_target(F.col("dep_lag_1"))
    return t.features.select(
        "station_id", "time", F.round(C.two_phase_combine(active, F.col("dep_roll_mean_24")), 4).alias("yhat")
    )


@check("P34_residual", """
select station_id, time, departures - dep_lag_168 as residual from features where abs(departures - dep_lag_168) < 2""")
def _(t):
    error = C.residual(F.col("departures"), F.col("dep_lag_168"))
    return t.features.select("station_id", "time", error.alias("residual")).filter(C.within_zoom(F.col("residual"), 2))


@check("P35_route_label", f"""
select pair || ': ' || n || ' trips' as label from (select {_UNDIRECTED} as pair, count(*) as n from clean group by 1)""")
def _(t):
    key = C.pair_key_undirected(F.col("departure_name"), F.col("return_name"))
    counted = t.clean.groupBy(key.alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(C.trips_label(F.col("pair"), F.col("n")).alias("label"))


@check("P36_filter_period", """
select o_orderkey, o_totalprice from orders
where month(o_orderdate) = 10 and year(o_orderdate) <> 2000 and o_totalprice is not null""")
def _(t):
    orders = t.read("orders")
    return P.filter_period(orders, "o_orderdate", 10, 2000, other_years=True, not_null="o_totalprice").select(
        "o_orderkey", "o_totalprice"
    )


@check("P37_clean_rides", """
select ride_id, departure, return_ts, departure_id, departure_name, return_id, return_name, distance,
  round(duration, 4) as duration, round(departure_lat, 4) as departure_lat, round(departure_lon, 4) as departure_lon,
  departure_capacity, round(return_lat, 4) as return_lat, round(return_lon, 4) as return_lon,
  return_capacity from clean""")
def _(t):
    out = clean_rides(t.unified, t.stations).withColumn("duration", F.round("duration", 4))
    places = [f"{s}_{c}" for s in ("departure", "return") for c in ("lat", "lon", "capacity")]
    return rides_out(out.withColumns({c: F.round(c, 4) for c in places if not c.endswith("capacity")}).select("*"),
                     "ride_id", *places)
