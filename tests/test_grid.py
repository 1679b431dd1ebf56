import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tripwise.operators import grid


def trips(seed=0, n=4000):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2022-10-25")
    stations = rng.choice(["001", "002", "003", "004"], n, p=[0.6, 0.3, 0.09, 0.01])
    return pd.DataFrame({"departure_id": stations, "departure": start + pd.to_timedelta(rng.integers(0, 3600 * 24 * 180, n), "s")})


def reindexed(pdf, months=range(4, 11)):
    pdf = pdf.assign(time=pdf["departure"].dt.floor("h"))
    hours = pd.date_range(pdf["time"].min(), pdf["time"].max(), freq="h")
    hours = hours[hours.month.isin(list(months))]
    index = pd.MultiIndex.from_product([sorted(pdf["departure_id"].unique()), hours], names=["station_id", "time"])
    counts = pdf.groupby(["departure_id", "time"]).size()
    counts.index.names = ["station_id", "time"]
    return counts.reindex(index, fill_value=0).reset_index(name="departures")


def test_spine_equals_full_reindex(spark):
    pdf = trips()
    df = spark.createDataFrame(pdf)
    got = grid.spine_fill_zero(grid.hourly_departures(df), grid.hour_bounds(df)).toPandas()
    got = got.sort_values(["station_id", "time"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, reindexed(pdf), check_dtype=False)


def test_cross_spine_has_the_same_keys_and_no_join(spark):
    pdf = trips(1)
    df = spark.createDataFrame(pdf)
    spine = grid.cross_join_spine(df.select(F.col("departure_id").alias("station_id")), grid.hour_bounds(df))
    plan = spine._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spine.count() == spine.distinct().count() == len(reindexed(pdf))


def test_hourly_total(spark):
    pdf = trips(2)
    want = reindexed(pdf.assign(departure_id="all"))
    got = grid.hourly_total(spark.createDataFrame(pdf)).toPandas().sort_values("time")
    assert list(got["departures"]) == list(want["departures"]) and list(got["time"]) == list(want["time"])


def test_top_n_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)], "departure_id string")
    assert [r[0] for r in grid.top_n_stations(df, 2).collect()] == ["c", "a"]


def test_dedupe_keeps_the_first_by_order(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, None)], "k string, o int, v string")
    assert sorted(map(tuple, grid.dedupe_keys(df, ["k"], ["o"]).collect())) == [("a", 1, "early"), ("b", 1, None)]


def test_weather_of_a_repeated_hour_does_not_fan_out(spark):
    hourly = spark.createDataFrame([("2020-10-25 03:00:00", 5)], "t string, n int").select(F.col("t").cast("timestamp").alias("time"), "n")
    weather = spark.createDataFrame([("2020-10-25 03:00:00", 2, 9.0), ("2020-10-25 03:00:00", 1, 8.0)], "t string, utc int, temperature double")
    weather = weather.select(F.col("t").cast("timestamp").alias("time"), "utc", "temperature")
    assert [r.temperature for r in grid.join_weather_exact(hourly, weather, ("utc",)).collect()] == [8.0]
