"""Tables laid out on write: bounded files, buckets that spare shuffles, counts taken on the way."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripwise.operators import features, gaps, stats, usage
from tripwise.sources import writers


def trips(spark, n=4000):
    return spark.range(n, numPartitions=16).select(
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 20_000).alias("departure"), F.col("id").alias("ride"))


def test_a_year_gets_few_files(spark, tmp_path):
    writers.write_trips_by_year(trips(spark), str(tmp_path / "t"))
    files = {p.name: len(list(p.glob("part-*"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert len(files) == 4 and set(files.values()) == {1}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_a_large_year_is_split(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        one = trips(spark, 20_000).withColumn("departure", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("ride")))
        writers.write_trips_by_year(one, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "t" / "year=2020").glob("part-*"))) > 3


def grid(spark):
    hours = [datetime(2023, 5, 1) + timedelta(hours=h) for h in range(400)]
    rows = [(f"{s:03d}", t, (s * 7 + i * 3) % 11) for s in range(5) for i, t in enumerate(hours)]
    return spark.createDataFrame(rows, "station_id string, time timestamp, departures bigint")


def test_windows_over_a_bucketed_grid_need_no_shuffle(spark, tmp_path):
    plain = grid(spark)
    before = spark.conf.get("spark.sql.sources.bucketing.enabled")
    assert before == "true"
    try:
        written = writers.write_grid(plain, "layout_grid", str(tmp_path / "grid"), 4)
        for build in (features.add_lags, features.add_rolling, features.add_same_hour, features.demand_features):
            done = build(written)
            plan = done._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Window" in plan
            again = build(plain)
            assert done.exceptAll(again).isEmpty() and again.exceptAll(done).isEmpty()
        shifted = features.shift_weather(written.withColumn("temperature", F.col("departures") + 0.5), ("temperature",))
        assert "Exchange" not in shifted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("drop table if exists layout_grid")


def test_counts_taken_while_writing_equal_a_second_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.0), (2, "a", float("nan")), (None, "b", None)], "a int, `b c` string, d double")
    done = writers.write_counted(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert done.rows == stats.row_count(back).first()[0] == 3
    assert done.missing == {"a": 1, "b c": 1, "d": 2}
    part = back.select("a", "d").withColumn("d", F.nanvl("d", F.lit(None)))
    want = {tuple(r) for r in gaps.missing_summary(part, ("a", "d")).select("column_name", "missing", "percent").collect()}
    assert {tuple(r) for r in done.missing_summary(spark).filter("column_name <> 'b c'").collect()} == want
    empty = writers.write_counted(df.filter("false"), str(tmp_path / "e"), ("a",), partition_by=("a",))
    assert empty.rows == 0 and empty.missing_summary(spark).first()["percent"] is None


@pytest.mark.parametrize("profiles, singles", [
    (usage.hourly_profiles, {"hourly": usage.hourly_usage, "hourly_by_year": usage.hourly_usage_by_year, "hourly_by_daytype": usage.hourly_usage_by_daytype}),
    (usage.daily_profiles, {"monthly": usage.monthly_usage, "monthly_by_year": usage.monthly_usage_by_year, "weekday": usage.weekday_usage})])
def test_profiles_equal_single_tables_in_one_shuffle(spark, profiles, singles):
    start = datetime(2022, 10, 1)
    hourly = spark.createDataFrame([(start + timedelta(hours=7 * h), h % 13) for h in range(1500)], "time timestamp, departures bigint")
    table = usage.daily_total(hourly) if profiles is usage.daily_profiles else hourly
    found = profiles(table)
    if table is hourly:
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for name, single in singles.items():
        one = single(table)
        mine = found.filter(F.col("profile") == name).select(one.columns)
        assert mine.exceptAll(one).isEmpty() and one.exceptAll(mine).isEmpty() and one.count() > 0
    assert found.filter("profile is null").isEmpty()
