"""Window operators against pandas on random data with season breaks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwise.operators import features, folds, gaps


def series(seed=0, stations=3, breaks=True):
    rng = np.random.default_rng(seed)
    hours = pd.date_range("2022-10-20", "2023-04-12", freq="h")
    if breaks:
        hours = hours[(hours.month >= 4) & (hours.month <= 10)]
    frames = [
        pd.DataFrame({"station_id": f"{s:03d}", "time": hours, "departures": rng.poisson(2, len(hours))})
        for s in range(stations)
    ]
    return pd.concat(frames, ignore_index=True)


def expected(pdf):
    out = []
    for _, g in pdf.groupby("station_id"):
        g = g.set_index("time")
        y = g["departures"]
        for k in features.LAGS:
            g[f"dep_lag_{k}"] = y.shift(k, freq="h")
        for n in features.ROLLING_WINDOWS:
            g[f"dep_roll_mean_{n}"] = y.shift(1, freq="h").rolling(n).mean()
            g[f"dep_roll_std_{n}"] = y.shift(1, freq="h").rolling(n).std()
        days = pd.DataFrame({i: y.shift(24 * i, freq="h").reindex(g.index) for i in range(1, 8)})
        for n in features.SAME_HOUR_WINDOWS:
            g[f"dep_same_hour_mean_{n}d"] = days[list(range(1, n + 1))].mean(axis=1)
            g[f"dep_same_hour_std_{n}d"] = days[list(range(1, n + 1))].std(axis=1)
        out.append(g.reset_index())
    return pd.concat(out).sort_values(["station_id", "time"]).reset_index(drop=True)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_demand_features_match_pandas(spark, kind):
    pdf = series()
    df = spark.createDataFrame(pdf).withColumn("departures", F.col("departures").cast(kind))
    got = features.demand_features(df).toPandas().sort_values(["station_id", "time"]).reset_index(drop=True)
    want = expected(pdf)
    for c in want.columns[3:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, equal_nan=True, err_msg=c)


def frames(df, windows):
    """The same figures from sliding frames, which Spark adds up anew for every row."""
    from pyspark.sql import Window

    order = Window.partitionBy("station_id").orderBy("time")
    ready = F.lag("load", 1).over(order).isNotNull()
    for n in windows:
        frame = order.rowsBetween(-n, -1)
        full = ready & (F.count("load").over(frame) == n)
        df = df.withColumns({f"mean_{n}": F.when(full, F.avg("load").over(frame)), f"std_{n}": F.when(full, F.stddev_samp("load").over(frame))})
    return df


def test_blocks_equal_sliding_frames_on_doubles(spark):
    rng = np.random.default_rng(7)
    pdf = series(4, stations=2, breaks=False)[["station_id", "time"]].groupby("station_id").head(700).reset_index(drop=True)
    pdf["load"] = rng.normal(0, 1, len(pdf)) * rng.choice([1e-3, 1.0, 1e6], len(pdf))
    df = spark.createDataFrame(pdf).withColumn("load", F.when(F.hash("time") % 97 != 0, F.col("load")))
    windows = (1, 2, 3, 24, 168)
    key = ["station_id", "time"]
    got = features.add_rolling(df, "load", windows).toPandas().sort_values(key).reset_index(drop=True)
    want = frames(df, windows).toPandas().sort_values(key).reset_index(drop=True)
    for n in windows:
        scale = np.nanmax(np.abs(want[f"mean_{n}"]))
        np.testing.assert_allclose(got[f"loa_roll_mean_{n}"].astype(float), want[f"mean_{n}"].astype(float), rtol=1e-9, atol=1e-9 * scale, equal_nan=True)
        if n > 1:
            np.testing.assert_allclose(got[f"loa_roll_std_{n}"].astype(float), want[f"std_{n}"].astype(float), rtol=1e-9, atol=1e-9 * scale, equal_nan=True)
        else:
            assert got["loa_roll_std_1"].isna().all()


def test_a_number_far_from_the_others_leaves_later_windows_exact(spark):
    values = [1.0 + i / 8 for i in range(40)]
    values[10], values[20] = 1e17, float("nan")
    pdf = pd.DataFrame({"station_id": "1", "time": pd.date_range("2023-05-01", periods=40, freq="h"), "load": values})
    got = features.add_rolling(spark.createDataFrame(pdf), "load", (3,)).toPandas().sort_values("time").reset_index(drop=True)
    for i in (*range(3, 11), *range(14, 21), *range(24, 40)):
        assert got["loa_roll_mean_3"][i] == pytest.approx(np.mean(values[i - 3:i]), rel=1e-14)
        assert got["loa_roll_std_3"][i] == pytest.approx(np.std(values[i - 3:i], ddof=1), rel=1e-12)


def test_double_windows_need_one_shuffle_and_no_sliding_frame(spark):
    df = spark.createDataFrame(series(2)).withColumn("departures", F.col("departures") / 7)
    plan = features.add_rolling(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "RowFrame, -168, -1)" not in plan


def test_single_operators_equal_the_combined_plan(spark):
    df = spark.createDataFrame(series(1))
    key = ["station_id", "time"]
    combined = features.demand_features(df).toPandas().sort_values(key).reset_index(drop=True)
    for part in (features.add_lags(df), features.add_rolling(df), features.add_same_hour(df)):
        got = part.toPandas().sort_values(key).reset_index(drop=True)
        for c in got.columns[3:]:
            np.testing.assert_allclose(got[c].astype(float), combined[c].astype(float), equal_nan=True, err_msg=c)


def test_lag_equals_self_join(spark):
    df = spark.createDataFrame(series(2))
    joined = features.time_shift_self_join(df, "departures", 24, "x").select("station_id", "time", "x")
    window = features.add_lags(df, lags=(24,)).select("station_id", "time", F.col("dep_lag_24").alias("x"))
    assert joined.exceptAll(window).count() == 0 and window.exceptAll(joined).count() == 0


def test_features_share_one_shuffle(spark):
    plan = features.demand_features(spark.createDataFrame(series(3)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") + plan.count("Window(") <= 2


def weather(seed, n=3000, runs=True):
    rng = np.random.default_rng(seed)
    t = pd.date_range("2023-01-01", periods=n, freq="h")
    wind = rng.normal(5, 2, n).round(2)
    wind[:4] = np.nan
    at = 30
    while at < n - 40:
        length = int(rng.integers(1, 12))
        wind[at : at + length] = np.nan
        at += length + int(rng.integers(1, 30))
    wind[1200:1290] = np.nan
    wind[-3:] = np.nan
    temp = rng.normal(10, 5, n).round(2)
    temp[rng.random(n) < 0.2] = np.nan
    temp[:2] = np.nan
    rain = np.where(rng.random(n) < 0.1, np.nan, 0.5)
    return pd.DataFrame({"time": t, "temperature": temp, "wind_speed": wind, "precipitation": rain})


def with_nulls(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in pdf.columns[1:]})


def repeat_short(s, limit=6):
    run = s.notna().cumsum()
    size = s.isna().astype(int).groupby(run).transform("sum")
    return s.where(s.notna() | (size > limit), s.ffill())


@pytest.mark.parametrize("chunk", ["day", "month", "year"])
def test_clean_weather_matches_pandas(spark, chunk):
    pdf = weather(5)
    got = gaps.clean_weather(with_nulls(spark, pdf), chunk=chunk).toPandas().sort_values("time").reset_index(drop=True)
    wind = repeat_short(pdf["wind_speed"])
    np.testing.assert_allclose(got["temperature"], pdf["temperature"].ffill(), equal_nan=True)
    np.testing.assert_array_equal(got["ws_missing"], wind.isna().astype(int))
    np.testing.assert_allclose(got["wind_speed"], wind.fillna(-1))
    np.testing.assert_array_equal(got["precip_missing"], pdf["precipitation"].isna().astype(int))


def test_gap_lengths_match_pandas(spark):
    pdf = weather(6)
    s = pdf["wind_speed"]
    runs = s.isna().astype(int).groupby(s.notna().cumsum()).sum()
    got = gaps.gap_lengths(with_nulls(spark, pdf), "wind_speed", chunk="day").toPandas()["gap_length"]
    assert sorted(got) == sorted(x for x in runs if x > 6)


def test_linear_option_interpolates(spark):
    pdf = weather(7)
    got = gaps.fill_short_gaps(with_nulls(spark, pdf), "wind_speed", method="linear", chunk="day")
    got = got.toPandas().sort_values("time").reset_index(drop=True)["wind_speed"]
    s = pdf["wind_speed"]
    size = s.isna().astype(int).groupby(s.notna().cumsum()).transform("sum")
    want = s.where(s.notna() | (size > 6), s.interpolate("linear", limit_area="inside").fillna(s.ffill()))
    np.testing.assert_allclose(got, want, equal_nan=True)


def test_series_with_a_key_stay_apart(spark):
    a, b = weather(8, 400), weather(9, 400)
    df = with_nulls(spark, a).withColumn("site", F.lit("a")).unionByName(with_nulls(spark, b).withColumn("site", F.lit("b")))
    got = gaps.ffill(df, "temperature", by=("site",), chunk="day").toPandas()
    for name, pdf in (("a", a), ("b", b)):
        part = got[got.site == name].sort_values("time").reset_index(drop=True)
        np.testing.assert_allclose(part["temperature"], pdf["temperature"].ffill(), equal_nan=True)


def test_repeated_hour_is_ordered_by_the_extra_column(spark):
    rows = [("2020-10-25 03:00:00", 1, 4.0), ("2020-10-25 03:00:00", 2, None), ("2020-10-25 04:00:00", 3, None)]
    df = spark.createDataFrame(rows, "t string, utc int, temperature double").withColumn("time", F.col("t").cast("timestamp"))
    out = gaps.ffill(df, "temperature", order=("utc",)).orderBy("utc").collect()
    assert [r.temperature for r in out] == [4.0, 4.0, 4.0]


def test_folds_match_expanding_split(spark):
    pdf = series(4)
    n, k = len(pdf), 7
    size = n // (k + 1)
    ordered = pdf.sort_values(["time", "station_id"]).reset_index(drop=True)
    position = np.arange(n)
    ordered["fold"] = np.where(position < n - k * size, 0, (position - (n - k * size)) // size + 1)
    got = folds.time_series_folds(spark.createDataFrame(pdf), k).toPandas().sort_values(["time", "station_id"])
    np.testing.assert_array_equal(got["fold"].to_numpy(), ordered["fold"].to_numpy())


def test_sample_takes_all_rows_of_a_small_station(spark):
    pdf = pd.concat([series(1, 1), series(2, 2).query("station_id == '001'").head(7)])
    counts = folds.sample_per_station(spark.createDataFrame(pdf), 50).groupBy("station_id").count().collect()
    assert {r["station_id"]: r["count"] for r in counts} == {"000": 50, "001": 7}


def test_week_slice_is_by_position(spark):
    pdf = series(1, 1)
    got = folds.week_slice(spark.createDataFrame(pdf), ["000"], start_day=2).toPandas().sort_values("time")
    want = pdf.iloc[48 : 48 + 168]
    assert list(got["time"]) == list(want["time"]) and list(got["position"]) == list(range(1, 169))
