"""Tree contributions against the definition of Shapley values on plain trees."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tripwise.operators import contributions as C
from tripwise.operators import learning as L

COLUMNS = ("hour", "month", "dep_lag_1", "wind_speed", "flat")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 900
    hour, month, lag, wind = np.arange(n) % 24, 4 + np.arange(n) // 200, rng.integers(0, 9, n), rng.random(n) * 10
    y = (hour > 7) * lag + (month > 5) * (wind > 4) * 3 + rng.random(n)
    pdf = pd.DataFrame({"station_id": "1", "time": pd.date_range("2023-05-01", periods=n, freq="h"), "hour": hour, "month": month,
                        "dep_lag_1": lag.astype(float), "wind_speed": wind, "flat": 1.0, "departures": np.round(y)})
    return L.prepare(spark.createDataFrame(pdf)).cache()


@pytest.fixture(scope="module")
def model(table):
    return L.fit_regressor(table, COLUMNS, max_iter=4, max_depth=4)


def known(nodes, at, row, features):
    """Mean prediction of a tree that may ask only about some features."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    split, sides = node["split"], (nodes[node["leftChild"]], nodes[node["rightChild"]])
    if split["featureIndex"] in features:
        x, cut = row[split["featureIndex"]], split["leftCategoriesOrThreshold"]
        left = x in cut if split["numCategories"] >= 0 else x <= cut[0]
        return known(nodes, node["leftChild"] if left else node["rightChild"], row, features)
    return sum(known(nodes, node[c], row, features) * s["rawCount"] / node["rawCount"] for c, s in zip(("leftChild", "rightChild"), sides))


def test_contributions_equal_the_definition(spark, table, model, tmp_path):
    boosted = model.stages[-1]
    boosted.write().save(str(tmp_path / "m"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "m" / "data")).collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
    assert any(n["split"]["numCategories"] > 0 for t in trees.values() for n in t.values())  # categories take part
    few = table.filter("departures > 4").limit(6)
    d = len(COLUMNS)
    vectors = model.transform(few).select(vector_to_array("features").alias("v"), "time").collect()
    found = {r["time"]: r for r in C.with_contributions(model, few).collect()}
    for r in vectors:
        value = {}
        for k in range(d + 1):
            for s in combinations(range(d), k):
                value[s] = sum(w * known(trees[t], 0, r["v"], s) for t, w in enumerate(boosted.treeWeights))
        for i in range(d):
            want = sum(factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d) * (value[tuple(sorted((*s, i)))] - value[s])
                       for s in value if i not in s)
            np.testing.assert_allclose(found[r["time"]]["contributions"][i], want, atol=1e-9)
        np.testing.assert_allclose(found[r["time"]]["base"], value[()], atol=1e-9)


def test_base_and_contributions_add_up_to_every_prediction(table, model):
    scored = C.with_contributions(model, L.predict(model, table))
    gap = F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) - F.col("yhat"))
    row = scored.agg(F.max(gap).alias("gap"), F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("contributions")[4])).alias("flat")).first()
    assert row["n"] == 900 and row["gap"] < 1e-9 and row["flat"] == 0


def test_contributions_of_a_classifier_add_up_to_its_margin(table):
    model = L.fit_classifier(table, COLUMNS, max_iter=3, max_depth=3)
    margin = model.transform(table).select("time", vector_to_array("rawPrediction")[1].alias("margin"))
    scored = C.with_contributions(model, table).join(margin, "time")
    gap = F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) - F.col("margin"))
    assert scored.agg(F.max(gap)).first()[0] < 1e-9


def test_columns_with_the_results_names_and_an_empty_table(table, model):
    odd = table.withColumns({"base": F.lit("x"), "contributions": F.lit(1)})
    out = C.with_contributions(model, odd)
    assert sorted(out.columns) == sorted(odd.columns) and out.limit(3).count() == 3
    assert C.with_contributions(model, table.filter("false")).count() == 0


def test_exchange_and_contributions_agree_on_the_order(table, model):
    by_contribution = [r.feature for r in L.feature_importance(model, table, COLUMNS).collect()]
    by_exchange = [r.feature for r in L.exchange_importance(model, table, COLUMNS).collect()]
    assert by_contribution[-1] == "flat" and set(by_contribution) == set(by_exchange)


def test_deep_paths_stay_exact():
    rng = np.random.default_rng(3)
    depth, rows = 9, rng.random((7, 9))
    paths = C.Paths(np.arange(depth)[None], np.full((1, depth), 0.4), np.full((1, depth), np.inf), np.ones((1, depth, 1), bool),
                    np.zeros((1, depth), bool), rng.random((1, depth)) * 0.9 + 0.05, np.array([3.0]))
    got = paths.shares(rows, depth)
    passed, share = rows > 0.4, paths.share[0]
    for r in range(len(rows)):
        game = lambda s: 3.0 * np.prod([passed[r, j] if j in s else share[j] for j in range(depth)])
        for i in range(depth):
            others = [j for j in range(depth) if j != i]
            want = sum(factorial(k) * factorial(depth - k - 1) / factorial(depth) * (game((*s, i)) - game(s))
                       for k in range(depth) for s in combinations(others, k))
            np.testing.assert_allclose(got[r, i], want, atol=1e-12)
