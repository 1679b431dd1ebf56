"""Trees grown leaf by leaf against a plain best-first tree and closed forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tripwise.operators import leafwise as W
from tripwise.operators import learning as L
from tripwise.operators.metrics import regression_metrics

COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 1500
    pdf = pd.DataFrame({"a": rng.integers(0, 12, n).astype(float), "b": rng.normal(0, 1, n).round(1), "c": rng.integers(0, 2, n).astype(float)})
    pdf["y"] = np.round(3 * (pdf.a > 6) + pdf.a * pdf.c + (pdf.b > 0.5) * 2 + rng.integers(0, 2, n))
    pdf["active"] = (pdf.y > 3).astype(float)
    return spark.createDataFrame(pdf).repartition(5).cache()


def assembled():
    return Pipeline(stages=[VectorAssembler(inputCols=list(COLUMNS), outputCol="features")])


def plain_tree(x, y, leaves, least, deepest=0):
    """Best-first growth on plain arrays; the prediction of each row."""
    groups = [(np.arange(len(y)), 0)]

    def best(rows, depth):
        found = (0.0, None)
        if deepest and depth >= deepest:
            return found
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= cut
                if min(low.sum(), (~low).sum()) < least:
                    continue
                r = y[rows] - y.mean()
                gain = r[low].sum() ** 2 / low.sum() + r[~low].sum() ** 2 / (~low).sum() - r.sum() ** 2 / len(r)
                if gain > found[0] + 1e-9:
                    found = (gain, (rows[low], rows[~low]))
        return found

    while len(groups) < leaves:
        options = [(best(rows, d), i) for i, (rows, d) in enumerate(groups)]
        (gain, halves), i = max(options, key=lambda o: o[0][0])
        if not gain:
            break
        depth = groups.pop(i)[1] + 1
        groups += [(h, depth) for h in halves]
    out = np.empty(len(y))
    for rows, _ in groups:
        out[rows] = y[rows].mean()
    return out, len(groups)


@pytest.mark.parametrize("leaves, least, deepest", [(2, 1, -1), (7, 1, -1), (20, 30, -1), (20, 5, 3)])
def test_one_tree_equals_plain_best_first_growth(table, leaves, least, deepest):
    params = {"num_leaves": leaves, "n_estimators": 1, "learning_rate": 1.0, "min_child_samples": least, "max_depth": deepest}
    model = W.fit(table, assembled(), "y", params)
    got = model.transform(table).toPandas()
    want, number = plain_tree(got[list(COLUMNS)].to_numpy(), got.y.to_numpy(), leaves, least, max(deepest, 0))
    np.testing.assert_allclose(got.prediction, want, atol=1e-9)
    assert model.trees[0].leaves == number


def test_the_leaf_limit_is_exact(table):
    for leaves in (2, 5, 13, 31):
        model = W.fit(table, assembled(), "y", {"num_leaves": leaves, "n_estimators": 2, "min_child_samples": 1})
        assert [t.leaves for t in model.trees] == [leaves, leaves]


def test_two_leaves_are_the_means_of_two_sides(table):
    one = Pipeline(stages=[VectorAssembler(inputCols=["c"], outputCol="features")])
    model = W.fit(table, one, "y", {"num_leaves": 2, "n_estimators": 1, "learning_rate": 1.0})
    want = {r.c: r.mean for r in table.groupBy("c").agg(F.avg("y").alias("mean")).collect()}
    for r in model.transform(table).select("c", "prediction").distinct().collect():
        assert r.prediction == pytest.approx(want[r.c], abs=1e-9)


def test_boosting_goes_on_over_written_scores(table, monkeypatch):
    params = {"num_leaves": 6, "n_estimators": 7, "learning_rate": 0.3, "feature_fraction": 0.7}
    whole = W.fit(table, assembled(), "y", params)
    monkeypatch.setattr(W, "REWRITE", 2)
    parts = W.fit(table, assembled(), "y", params)
    a, b = (m.transform(table).select("a", "b", "c", F.round("prediction", 9)) for m in (whole, parts))
    assert a.exceptAll(b).isEmpty()
    error = [regression_metrics(W.LeafwiseModel(whole.prepared, whole.edges, whole.trees[:k], whole.start, whole.objective)
                                .transform(table).withColumnRenamed("prediction", "yhat")).first().rmse for k in (1, 3, 7)]
    assert error == sorted(error, reverse=True)


def test_waves_do_not_change_the_tree(table, monkeypatch):
    params = {"num_leaves": 15, "n_estimators": 1, "min_child_samples": 3}
    wide = W.fit(table, assembled(), "y", params)
    monkeypatch.setattr(W, "WAVE", 1)
    narrow = W.fit(table, assembled(), "y", params)
    assert vars(wide.trees[0]).keys() and wide.trees[0].feature == narrow.trees[0].feature and wide.trees[0].bin == narrow.trees[0].bin
    np.testing.assert_allclose(wide.trees[0].value, narrow.trees[0].value, atol=1e-9)


def test_classifier_drawn_rows_and_two_phases(table):
    params = {"num_leaves": 8, "n_estimators": 8, "learning_rate": 0.3, "bagging_fraction": 0.6, "bagging_freq": 1, "min_child_samples": 5}
    active, amount = L.fit_leafwise_two_phase(table, COLUMNS, params, params)
    out = L.predict_two_phase(active, amount, table).toPandas()
    assert ((out.active_hat > 0) == (out.active > 0)).mean() > 0.9
    assert (out.yhat[out.active_hat == 0] == 0).all() and np.corrcoef(out.yhat, out.y)[0, 1] > 0.8


def test_saved_models_score_alike_and_odd_tables(spark, table, tmp_path):
    model = W.fit(table, assembled(), "active", {"num_leaves": 4, "n_estimators": 3}, "binary")
    model.save(str(tmp_path / "m"))
    again = W.LeafwiseModel.load(str(tmp_path / "m"))
    a, b = (m.transform(table.withColumn("margin", F.lit("x"))) for m in (model, again))
    assert a.columns[-2:] == ["prediction", "margin"] and a.exceptAll(b).isEmpty()
    assert model.transform(table.limit(0)).count() == 0
    flat = table.withColumn("y", F.lit(2.0))
    constant = W.fit(flat, assembled(), "y", {"n_estimators": 2})
    assert [t.leaves for t in constant.trees] == [1, 1] and constant.transform(flat).filter("prediction <> 2").isEmpty()
    assert W.fit(table.limit(0), assembled(), "y").trees == []
