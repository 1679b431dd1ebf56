from datetime import datetime

from pyspark.sql import functions as F

from tripwise.operators import identity, locations
from tripwise.operators.staging import as_lookup
from tripwise.plans.cleaning import clean_rides, clean_trips, normalize_trips

SCHEMA = ("departure timestamp, return timestamp, departure_id string, departure_name string, return_id string, "
          "return_name string, distance double, duration double")


def trip(hour, a, an, b, bn, distance=1000.0, duration=600.0):
    at = None if hour is None else datetime(2023, 6, 1, hour)
    return (at, datetime(2023, 6, 1, 23), a, an, b, bn, distance, duration)


def test_equal_use_goes_to_the_smallest_id(spark):
    df = spark.createDataFrame([trip(1, "2", "A", "1", "A"), trip(2, "2", "A", "1", "A"), trip(3, "9", "B", "9", "B")], SCHEMA)
    usage = identity.station_usage_counts(df)
    assert {r.name: r.main_id for r in identity.main_id_per_name(usage).collect()} == {"A": "1", "B": "9"}


def test_id_with_two_names_follows_the_greatest_name(spark):
    usage = spark.createDataFrame([("1", "A", 5), ("1", "B", 1), ("2", "B", 9), ("3", "A", 9)], "id string, name string, n long")
    mains = identity.main_id_per_name(usage)
    got = {r.id: r.main_id for r in identity.id_merge_map(identity.join_usage_main_id(usage, mains)).collect()}
    assert got == {"1": "2", "2": "2", "3": "3"}


def test_remap_is_one_step_and_keeps_unknown_ids(spark):
    df = spark.createDataFrame([trip(1, "1", "A", "7", "X")], SCHEMA)
    id_map = spark.createDataFrame([("1", "2"), ("2", "3")], "id string, main_id string")
    row = identity.remap_ids(df, as_lookup(id_map)).first()
    assert (row.departure_id, row.return_id) == ("2", "7")


def test_latest_name_rules(spark):
    rows = [
        trip(5, "1", "old", "2", "ret-late"), trip(9, "1", "new", "2", None), trip(None, "3", "no time", "4", "only return"),
        trip(10, "3", "timed", "1", "return name loses"), trip(1, "2", "dep-early", "9", None),
    ]
    got = {r.id: r.name for r in identity.latest_name_per_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"1": "new", "2": "dep-early", "3": "no time", "4": "only return"}


def test_names_of_unknown_ids_become_null(spark):
    df = spark.createDataFrame([trip(1, "1", "A", "7", None)], SCHEMA)
    row = identity.update_station_names(df).first()
    assert (row.departure_name, row.return_name) == ("A", None)


STATIONS = "id string, name string, lat double, lon double, capacity int, source string"


def stations(spark):
    rows = [("1", "A", 60.0, 24.0, 10, "HSL"), (None, "B", 61.0, 25.0, 20, "OSM"), ("", "C", 62.0, 26.0, 30, "OSM"),
            ("", "C", 62.5, 26.5, 31, "OSM")]
    return spark.createDataFrame(rows, STATIONS)


def test_location_by_id_then_by_name(spark):
    df = spark.createDataFrame([trip(1, "001", "renamed", "050", "B"), trip(2, "060", "nowhere", "001", "B")], SCHEMA)
    lookup = locations.prepare_stations(stations(spark))
    out = locations.merge_station_info(locations.merge_station_info(df, lookup, "departure"), lookup, "return")
    got = [(r.departure_lat, r.return_lat, r.return_capacity) for r in out.orderBy("departure").collect()]
    assert got == [(60.0, 61.0, 20.0), (None, 60.0, 10.0)]


def test_repeated_community_name_repeats_the_trip_unless_deduped(spark):
    df = spark.createDataFrame([trip(1, "050", "C", "001", "A")], SCHEMA)
    lookup = locations.prepare_stations(stations(spark))
    assert locations.merge_station_info(df, lookup, "departure").count() == 2
    once = locations.merge_station_info(df, lookup, "departure", dedupe=True).collect()
    assert [(r.departure_lat, r.departure_lon, r.departure_capacity) for r in once] == [(62.0, 26.0, 30.0)]


def test_cleaning_order(spark):
    march = (datetime(2023, 3, 5), datetime(2023, 3, 5, 1), "1", "A", "1", "A", 900.0, 600.0)
    filled = (datetime(2023, 6, 1, 1), datetime(2023, 6, 1, 1, 30), "001", "A", "060", "nowhere", 900.0, None)
    no_distance = (datetime(2023, 6, 1, 1), datetime(2023, 6, 1, 1, 30), "001", "A", "001", "A", None, 60.0)
    df = spark.createDataFrame([march, filled, no_distance], SCHEMA)
    assert [r.duration for r in clean_trips(df).collect()] == [30.0]
    row = clean_rides(df, stations(spark)).first()
    assert (row.departure_lat, row.return_lat) == (60.0, None)


def test_normalize(spark):
    df = spark.createDataFrame([("2023-06-01 10:00:00", "bad", "1", " A ", "2", "B\t", 1.0, 2.0)],
                               "Departure string, Return string, Departure_id string, Departure_name string, "
                               "Return_id string, Return_name string, Distance double, Duration double")
    row = normalize_trips(df).first()
    assert row["departure"] == datetime(2023, 6, 1, 10) and row["return"] is None
    assert (row["departure_name"], row["return_name"]) == ("A", "B")


def test_combine_stations(spark):
    official = spark.createDataFrame([("1", "A", 60.0, 24.0, 10)], "id string, name string, lat double, lon double, capacity int")
    community = spark.createDataFrame([("A", 1.0, 1.0, 1), ("B", 2.0, 2.0, 2)], "name string, lat double, lon double, capacity int")
    got = sorted((r.id, r.name, r.source) for r in locations.combine_stations(community, official).collect())
    assert got == [("", "B", "OSM"), ("1", "A", "HSL")]
    alone = locations.combine_stations(community)
    assert {(r.id, r.source) for r in alone.collect()} == {("", "OSM")} and alone.count() == 2


def test_unknown_station_keeps_its_rank(spark):
    ranked = spark.createDataFrame([("9", 2), ("1", 1)], "station_id string, rank long")
    names = as_lookup(spark.createDataFrame([("1", "A")], "id string, name string"))
    assert [(r.station_id, r.name) for r in identity.ordered_lookup(ranked, names).collect()] == [("1", "A"), ("9", None)]


def test_unify_equals_the_two_steps(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        def name():
            return rng.choice(["A", "B", "C", "D", None])

        def key():
            return rng.choice(["1", "2", "3", "4", "5", None])

        hour = rng.choice([None, *range(23)])
        rows.append(trip(hour, key(), name(), key(), name(), float(i)))
    rows.append(trip(4, "77", None, "88", None))
    df = spark.createDataFrame(rows, SCHEMA)
    steps = identity.update_station_names(identity.merge_station_ids(df))
    once = identity.unify_stations(df)
    assert once.columns == steps.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, steps.collect()))
