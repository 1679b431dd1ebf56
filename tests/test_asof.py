import numpy as np
import pandas as pd
import pytest

from tripwise.operators.asof import asof_join_backward


def frames(seed, n=400, m=300, span=20_000):
    rng = np.random.default_rng(seed)
    base = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"time": base + pd.to_timedelta(np.sort(rng.integers(0, span, n)), "s"), "id": np.arange(n)})
    right = pd.DataFrame({"time": base + pd.to_timedelta(np.unique(rng.integers(0, span, m)), "s")})
    right["v"] = rng.normal(size=len(right)).round(3)
    return left, right


@pytest.mark.parametrize("tolerance", [1, 60, 600])
def test_matches_merge_asof(spark, tolerance):
    left, right = frames(tolerance)
    want = pd.merge_asof(left, right, on="time", tolerance=pd.Timedelta(tolerance, "s")).sort_values("id")
    got = asof_join_backward(spark.createDataFrame(left), spark.createDataFrame(right), "time", tolerance)
    got = got.toPandas().sort_values("id")
    np.testing.assert_allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_keyed_and_unique_left(spark):
    left, right = frames(3)
    left, right = left.drop_duplicates("time"), right.copy()
    left["k"], right["k"] = left["id"] % 3, np.arange(len(right)) % 3
    want = pd.merge_asof(left, right, on="time", by="k", tolerance=pd.Timedelta(60, "s")).sort_values("id")
    got = asof_join_backward(
        spark.createDataFrame(left), spark.createDataFrame(right), "time", 60, by=("k",), hot_rows=None
    ).toPandas().sort_values("id")
    np.testing.assert_allclose(got["v"].astype(float), want["v"], equal_nan=True)
    assert list(got.columns) == ["time", "id", "k", "v"]


@pytest.mark.parametrize("hot_rows", [10, 100])
def test_hot_buckets_give_the_same_result(spark, hot_rows):
    """Tolerance of the whole span: every row is in one or two buckets, dealt out over many windows."""
    left, right = frames(11, 900, 500)
    want = pd.merge_asof(left, right, on="time", tolerance=pd.Timedelta("2h")).sort_values("id")
    got = asof_join_backward(
        spark.createDataFrame(left).repartition(6), spark.createDataFrame(right), "time", 7200, hot_rows=hot_rows
    ).toPandas().sort_values("id")
    np.testing.assert_allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_left_rows_without_a_time_stay(spark):
    left = spark.createDataFrame([(None, 1), (pd.Timestamp("2024-01-01").to_pydatetime(), 2)], "time timestamp, id int")
    right = spark.createDataFrame([(pd.Timestamp("2024-01-01").to_pydatetime(), 5.0)], "time timestamp, v double")
    got = asof_join_backward(left, right, "time", 60).orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == [(1, None), (2, 5.0)]


def test_hot_moment_is_not_multiplied(spark):
    """Half of all rows at one moment on both sides: the result keeps one row per left row."""
    left = pd.DataFrame({"time": [pd.Timestamp("2024-01-01")] * 5000, "id": range(5000)})
    right = pd.DataFrame({"time": [pd.Timestamp("2024-01-01")] * 5000, "v": [1.0] * 4999 + [2.0]})
    out = asof_join_backward(spark.createDataFrame(left), spark.createDataFrame(right), "time", 60, hot_rows=300)
    assert out.count() == 5000 and [r.v for r in out.select("v").distinct().collect()] == [2.0]


def test_no_pairs_in_the_plan(spark):
    left, right = frames(5)
    out = asof_join_backward(spark.createDataFrame(left), spark.createDataFrame(right), "time", 60, hot_rows=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
