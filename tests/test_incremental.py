"""Months added to a feature table against the whole table built at once."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwise.operators.locations import DETAILS
from tripwise.plans import incremental as I
from tripwise.plans.feature_table import build_feature_table

SHORT = {"lags": (1, 24, 48), "rolling_windows": (3, 48), "same_hour_windows": (2,)}


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(0)
    hours = [datetime(2022, 9, 20) + timedelta(hours=int(h)) for h in np.sort(rng.integers(0, 24 * 230, 6000))]
    hours = [h for h in hours if h.month in (9, 10, 4, 5)]
    station = rng.choice(["a", "b", "c", "d"], len(hours), p=[0.5, 0.3, 0.19, 0.01])
    pdf = pd.DataFrame({"departure": hours, "departure_id": station})
    for i, c in enumerate(DETAILS):
        pdf[f"departure_{c}"] = [f"{c}-{s}" if c not in ("lat", "lon", "capacity") else float(ord(s) + i) for s in station]
    span = pd.date_range("2022-09-20", "2023-05-10", freq="h")
    weather = pd.DataFrame({"time": span, "temperature": rng.normal(8, 5, len(span)), "wind_speed": 3.0, "precipitation": 0.0,
                            "precip_missing": 0, "ws_missing": 0})
    return spark.createDataFrame(pdf).cache(), spark.createDataFrame(weather).cache()


def same(a, b):
    columns = sorted(a.columns)
    whole = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(a.select(columns).dtypes)]
    left, right = a.select(whole), b.select(whole)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("part-*")}


def test_the_whole_build_equals_the_flagship_plan(spark, inputs, tmp_path):
    trips, weather = inputs
    I.build_months(trips, weather, str(tmp_path), 3, **SHORT)
    whole = build_feature_table(trips, weather, 3, **SHORT)
    found = I.read_months(spark, str(tmp_path))
    assert found.count() > 1000 and same(found.select(whole.columns), whole)


@pytest.mark.parametrize("since", [datetime(2022, 10, 17, 5), datetime(2023, 4, 3), datetime(2023, 5, 1)])
def test_added_months_equal_the_whole_build(spark, inputs, tmp_path, since):
    """Also across the winter, for stations without trips in the months read, and with a month that is only half there."""
    trips, weather = inputs
    month = datetime(since.year, since.month, 1)
    stations = I.choose_stations(trips, str(tmp_path / "whole" / "stations"), 4)
    I.choose_stations(trips, str(tmp_path / "grown" / "stations"), 4)
    whole = I.features_since(trips, weather, stations, **SHORT)
    half = I.features_since(trips.filter(F.col("departure") < F.lit(month + timedelta(days=3))), weather, stations, **SHORT)
    I.write_table(half, str(tmp_path / "grown" / "features"), partition_by=I.PARTS)
    before = files(tmp_path / "grown" / "features")
    I.rebuild_months(trips, weather, str(tmp_path / "grown"), since, **SHORT)
    after = files(tmp_path / "grown" / "features")
    old = {p for p in before if (int(p.parts[-3].split("=")[1]), int(p.parts[-2].split("=")[1])) < (since.year, since.month)}
    assert old and all(after.get(p) == before[p] for p in old)
    assert same(I.read_months(spark, str(tmp_path / "grown")).select(whole.columns), whole)


def test_only_the_reach_of_the_windows_is_read(spark, inputs):
    assert I.look_back(datetime(2023, 4, 1), 168) == datetime(2022, 10, 25)
    assert I.look_back(datetime(2023, 6, 1), 168) == datetime(2023, 5, 25)
    assert I.look_back(datetime(2023, 1, 8), 168, None) == datetime(2023, 1, 1)
