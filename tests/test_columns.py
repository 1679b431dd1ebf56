from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripwise.functions import columns as C
from tripwise.functions import timeparts as P


def one(df):
    return [tuple(r) for r in df.collect()]


def test_zero_pad_keeps_long_ids_and_marks_missing(spark):
    df = spark.createDataFrame([("7",), ("1001",), (None,), ("",), (" 12 ",)], "id string")
    assert [r[0] for r in one(df.select(C.zero_pad_id(F.col("id"))))] == ["007", "1001", "-01", "-01", "012"]


def test_strip_removes_every_kind_of_space(spark):
    df = spark.createDataFrame([(" \tA b\n",)], "departure_name string").withColumn("return_name", F.col("departure_name"))
    assert one(C.strip_names(df)) == [("A b", "A b")]


def test_prefix_is_literal(spark):
    df = spark.createDataFrame([("smoove:1",), ("smoove.2",), ("x",)], "id string")
    assert one(C.filter_id_prefix(df)) == [("1",)]


def test_flag_is_taken_before_the_fill(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.5,)], "p double")
    assert sorted(one(C.null_flag_sentinel(df, "p", "m"))) == [(-1.0, 1), (0.0, 0), (2.5, 0)]


def test_outlier_bounds(spark):
    rows = [(1.0, 100.0), (300.0, 100.0), (300.1, 100.0), (5.0, 50.0), (5.0, 15000.0), (5.0, 50.1)]
    df = spark.createDataFrame(rows, "m double, d double")
    assert one(df.filter(C.is_plausible_ride(F.col("m"), F.col("d")))) == [(300.0, 100.0), (5.0, 50.1)]


@pytest.mark.parametrize("n,label", [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (13, "13th"),
                                     (20, "20th"), (21, "21st"), (111, "111th"), (101, "101st")])
def test_ordinal(spark, n, label):
    assert one(spark.range(1).select(C.ordinal_label(F.lit(n)))) == [(label,)]


def test_rain_treats_unknown_as_dry(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (0.1,)], "p double")
    assert [r[0] for r in one(df.select(C.rain_flag(F.col("p"))))] == [0, 0, 0, 1]


def test_pair_keys(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "b")], "x string, y string")
    keys = one(df.select(C.pair_key_undirected(F.col("x"), F.col("y")).alias("k")))
    assert keys == [("a ↔ b",), ("a ↔ b",)]
    parts = C.pair_key_split(F.lit("a ↔ b"))
    assert one(spark.range(1).select(*parts)) == [("a", "b")]


def test_clock_change(spark):
    hours = [datetime(2020, 10, 25, h) for h in (0, 1, 2)] + [datetime(2020, 7, 1)]
    df = spark.createDataFrame([(h,) for h in hours], "t timestamp")
    local = [r[0] for r in one(df.select(P.utc_to_local(F.col("t"))))]
    assert [x.hour for x in local] == [3, 3, 4, 3]


def test_season_in_local_time(spark):
    times = [datetime(2021, 3, 31, 20), datetime(2021, 3, 31, 21), datetime(2021, 10, 31, 21, 59), datetime(2021, 10, 31, 22)]
    df = spark.createDataFrame([(x,) for x in times], "t timestamp")
    assert [r[0] for r in one(P.local_season_filter(df, "t"))] == times[1:3]


def test_calendar_weekday_starts_on_monday(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5),), (datetime(2024, 1, 7),)], "time timestamp")
    out = [(r.weekday, r.is_weekend, r.hour) for r in P.calendar_parts(df).collect()]
    assert out == [(0, 0, 5), (6, 1, 0)]


def test_missing_column_stops_before_any_job(spark):
    with pytest.raises(ValueError, match="nope"):
        C.require_columns(spark.range(1), ["id", "nope"])


def test_filter_period(spark):
    df = spark.createDataFrame([(datetime(2021, 10, 1), 1.0), (datetime(2020, 10, 1), 1.0), (datetime(2020, 10, 2), None)],
                               "t timestamp, v double")
    assert P.filter_period(df, "t", 10, 2021).count() == 1
    assert P.filter_period(df, "t", 10, 2021, other_years=True, not_null="v").count() == 1


def test_undirected_pair_needs_both_names(spark):
    df = spark.createDataFrame([("B", "A"), ("A", None), (None, "C")], "a string, b string")
    assert [r[0] for r in one(df.select(C.pair_key_undirected(F.col("a"), F.col("b"))))] == ["A ↔ B", None, None]
