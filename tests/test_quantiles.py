import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from tripwise.operators import quantiles, stats, usage

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.mark.parametrize("name", ["normal", "ties", "hot", "one", "outlier"])
def test_percentiles_are_exact(spark, name):
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(size=5001),
        "ties": rng.integers(0, 5, 4000).astype(float),
        "hot": np.concatenate([np.full(3000, 7.0), rng.normal(size=1500)]),
        "one": np.array([3.5]),
        "outlier": np.concatenate([rng.random(2000), [1e12]]),
    }[name]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(7)
    got = quantiles.exact_percentiles(df, "x", PROBS).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(x, PROBS), rtol=1e-12)


def test_describe_matches_pandas(spark):
    s = pd.Series(np.random.default_rng(2).gamma(2, 5, 999))
    got = {r.statistic: r.value for r in quantiles.describe_column(spark.createDataFrame(s.to_frame("x")), "x").collect()}
    for name, value in s.describe().items():
        np.testing.assert_allclose(got[name], value)


def test_quartiles_match_qcut_and_refuse_equal_edges(spark):
    x = np.random.default_rng(3).integers(0, 1000, 77)
    df = spark.createDataFrame(pd.DataFrame({"total_trips": x}))
    got = quantiles.usage_quartile(df).toPandas().sort_values("total_trips")
    want = pd.qcut(pd.Series(np.sort(x)), 4, labels=False)
    assert list(got["usage_quartile"]) == list(want)
    flat = spark.createDataFrame([(1,), (1,), (1,), (5,)], "total_trips int")
    with pytest.raises(PySparkException, match="not unique"):
        quantiles.usage_quartile(flat).collect()


def test_rank_without_global_window(spark):
    pdf = pd.DataFrame({"station_id": [f"{i:04d}" for i in range(700)], "total": np.random.default_rng(4).integers(0, 50, 700)})
    got = quantiles.rank_rows(spark.createDataFrame(pdf), "total", "station_id").toPandas().sort_values("rank")
    want = pdf.sort_values(["total", "station_id"], ascending=[False, True])
    assert list(got["station_id"]) == list(want["station_id"]) and list(got["rank"]) == list(range(1, 701))


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(5).normal(size=3000)
    got = stats.histogram(spark.createDataFrame(pd.DataFrame({"x": x})), "x", 60).orderBy("bin").toPandas()
    counts, edges = np.histogram(x, 60)
    assert abs(got["n"].to_numpy() - counts).sum() <= 2 and got["n"].sum() == 3000
    np.testing.assert_allclose(got["bin_start"], edges[:-1])


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    assert [r.n for r in stats.histogram(df, "x", 5).orderBy("bin").collect()] == [1, 0, 0, 0, 1]


def test_share_and_counts(spark):
    df = spark.createDataFrame([(10.0,), (35.0,), (40.0,), (None,)], "x double")
    assert stats.share_over_threshold(df, "x", 30).first()[0] == 0.5
    assert tuple(stats.count_over_thresholds(df, "x", (20, 36)).first()) == (4, 2, 1)


def test_correlation_uses_pairwise_complete_rows(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    pdf.loc[::5, "b"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    got = stats.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()
    want = pdf.corr()
    for r in got:
        np.testing.assert_allclose(r.r, want.loc[r.a.lower(), r.b.lower()])


def test_hexbin_counts_all_points(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(2000, 2)), columns=["x", "y"]))
    out = stats.hexbin_counts(df, "x", "y", 20).toPandas()
    assert out["n"].sum() == 2000 and (out["n"] > 0).all()
    halves = (out["i"] % 1 != 0)
    assert ((out["j"] % 1 != 0) == halves).all()


def test_coverage_above_station_count_keeps_all(spark):
    df = spark.createDataFrame([(s,) for s in "aaabbc"], "departure_id string")
    got = usage.station_coverage(df, (1, 2, 50)).orderBy("threshold").collect()
    assert [tuple(r) for r in got] == [(1, 1, 3, 50.0), (2, 2, 5, 83.33), (50, 3, 6, 100.0)]
