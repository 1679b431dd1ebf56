"""Behaviour that matters on large and skewed inputs."""

import pytest
from pyspark.sql import functions as F

from tripwise.operators.staging import Lookup, as_lookup, fresh_path, lookup_join, salted_join, scratch_dir
from tripwise.checks.adapters import MONTHS, TOP, Tables
from tripwise.plans.feature_table import build_feature_table, build_feature_table_stepwise

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    """One key holds more than a third of the left rows; some keys are null, some unmatched."""
    left = spark.range(3000).select(
        F.when(F.col("id") % 5 < 2, F.lit("hot")).when(F.col("id") % 5 == 2, None)
        .otherwise((F.col("id") % 40).cast("string")).alias("k"), (F.col("id") % 700).alias("v"))
    right = spark.range(30).select(F.when(F.col("id") < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                   (F.col("id") * 10).alias("w"))
    left = left.repartition(5).persist()
    plain, salted = left.join(right, "k", how), salted_join(left, right, "k", how, hot_rows=100)
    assert plain.columns == salted.columns
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_lookup_is_broadcast_only_below_the_bound(spark):
    left, dim = spark.range(100), spark.range(50).withColumn("w", F.lit("x"))
    small, large = as_lookup(dim), as_lookup(dim, max_rows=10)
    assert small.small and not large.small and not as_lookup(dim, max_bytes=100).small
    assert "BroadcastHashJoin" in plan_of(lookup_join(left, small, "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin [id#" in plan_of(lookup_join(left, large, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert lookup_join(left, large, "id").filter("w is not null").count() == 50


def test_feature_plan_shuffles_trips_once_and_the_grid_once(spark):
    t = Tables(spark, SMALL)
    plan = plan_of(build_feature_table(t.clean, t.clean_weather, TOP, MONTHS))
    assert plan.count("hashpartitioning(station_id") == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "rangepartitioning" not in plan


def test_feature_plan_equals_the_stepwise_one(spark):
    t = Tables(spark, SMALL)
    fast = build_feature_table(t.clean, t.clean_weather, TOP, MONTHS)
    slow = build_feature_table_stepwise(t.clean, t.clean_weather, TOP, MONTHS).select(*fast.columns)

    def digest(df):
        """Row count and an order-free sum of row hashes, doubles to six places."""
        values = [F.round(c, 6) + 0.0 if k == "double" else F.col(c) for c, k in df.dtypes]
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*values).cast("decimal(38,0)"))).first())

    assert digest(fast)[0] > 0 and digest(fast) == digest(slow)


def test_all_stations_are_possible(spark):
    t = Tables(spark, SMALL)
    some = build_feature_table(t.clean, t.clean_weather, TOP, MONTHS).select("station_id").distinct().count()
    everything = build_feature_table(t.clean, t.clean_weather, None, MONTHS).select("station_id").distinct().count()
    assert some <= TOP < everything


def test_scratch_folder_is_the_shared_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark) == shared.rstrip("/") if shared else scratch_dir(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_identities_between_operators(spark):
    from tripwise.operators import grid, spatial, stats, usage

    t = Tables(spark, SMALL)
    hourly = grid.hourly_total(t.clean, MONTHS)
    n = t.clean.count()
    assert hourly.agg(F.sum("departures")).first()[0] == n
    assert usage.daily_total(hourly).agg(F.sum("departures")).first()[0] == n
    assert stats.histogram(t.clean, "duration").agg(F.sum("n")).first()[0] == n
    ends = t.clean.filter("departure_lat is not null").count() + t.clean.filter("return_lat is not null").count()
    assert spatial.station_total_trips(t.clean).agg(F.sum("total_trips")).first()[0] == ends


def test_lookup_subset_stays_small(spark):
    assert Lookup(spark.range(3), True).derive(lambda d: d.filter("id > 1")).small


def test_rows_without_key_get_as_many_salts_as_they_need(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), "id", F.create_map("id", "id").alias("m"))
    right = spark.range(7).select(F.col("id").alias("k"), F.col("id").alias("v"))
    from tripwise.operators.staging import spread_hot_keys

    dealt, repeated = spread_hot_keys(left, right, ["k"], hot_rows=20)
    counts = dealt.groupBy("k", "_salt").count().filter("k is null").collect()
    assert len(counts) > 40 and max(r["count"] for r in counts) < 60
    assert dealt.join(repeated, ["k", "_salt"], "left").count() == 3000


def test_folds_keep_rows_without_a_time(spark):
    from tripwise.operators.folds import time_series_folds

    df = spark.sql("select id as station_id, case when id % 10 > 0 then timestamp_seconds(id * 3600) end as time from range(80)")
    assert time_series_folds(df, 3).groupBy("fold").count().count() == 4 and time_series_folds(df, 3).count() == 80
