import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwise.operators import learning as L
from tripwise.operators import metrics

COLUMNS = ("station_id", "dep_lag_1", "hour")
FEW = {"max_iter": 4, "max_depth": 3, "columns": COLUMNS}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 1200
    hour = np.arange(n) % 24
    station = np.where(np.arange(n) % 3 == 0, "001", "002")
    y = rng.poisson(np.where((hour > 7) & (hour < 20), 4.0, 0.1) * np.where(station == "001", 2, 1))
    pdf = pd.DataFrame({"station_id": station, "time": pd.date_range("2023-05-01", periods=n, freq="h"), "hour": hour,
                        "dep_lag_1": np.roll(y, 1), "departures": y})
    return L.prepare(spark.createDataFrame(pdf)).cache()


def score(df):
    return metrics.regression_metrics(df).first()


def test_regressor_beats_the_mean(table):
    assert score(L.predict(L.fit_regressor(table, **FEW), table)).r2 > 0.3


def test_two_phase_emits_zeros_and_learns_amounts_from_active_rows(table):
    out = L.predict_two_phase(*L.fit_two_phase(table, **FEW), table)
    zeros = out.filter("yhat = 0").count()
    assert 0 < zeros < out.count()
    assert out.filter("active_hat = 0 and yhat <> 0").count() == 0
    assert out.filter("active_hat = 1 and yhat < 0.9").count() == 0


def test_cross_validation_has_one_row_per_split(table):
    folded = L.with_folds(table.drop("y", "active"), 3)
    scores = L.cv_regression(folded, 3, **FEW).collect()
    assert sorted(r.fold for r in scores) == [1, 2, 3] and all(np.isfinite(r.rmse) for r in scores)
    both = {r.metric: r for r in L.summarize(L.cv_two_phase(folded, 3, **FEW)).collect()}
    assert set(both) == {"mae", "rmse", "r2"} and both["mae"]["std"] >= 0


def test_tuning_is_repeatable_and_sorted(table):
    folded = L.with_folds(table.drop("y", "active"), 2)
    space = {"n_estimators": ("step", 2, 3, 1), "max_depth": ("step", 2, 3, 1), "learning_rate": ("log", 0.05, 0.3, None)}
    runs = [L.tune(folded, trials=3, splits=2, space=space, columns=COLUMNS) for _ in range(2)]
    rows = [r.collect() for r in runs]
    assert rows[0] == rows[1] and [r.loss for r in rows[0]] == sorted(r.loss for r in rows[0])
    best = L.best_params(runs[0], space)
    assert best["n_estimators"] in (2, 3) and isinstance(best["max_depth"], int) and best["learning_rate"] == rows[0][0].learning_rate
    assert L.objective_clf(folded, {"n_estimators": 2, "max_depth": 3}, 2, COLUMNS).first()["loss"] < -0.5


def test_parameter_names_are_translated():
    got = L.tree_settings(L.TUNED_REGRESSOR)
    assert got["maxIter"] == 350 and got["maxDepth"] == 7 and got["minInstancesPerNode"] == 50
    assert got["featureSubsetStrategy"] == "0.5892686656410099"


def test_importance_finds_the_driver(table):
    noisy, columns = table.withColumn("flat", F.lit(1.0)), (*COLUMNS, "flat")
    model = L.fit_regressor(noisy, columns, max_iter=4, max_depth=3)
    importance = L.feature_importance(model, noisy, columns)
    ranked = importance.collect()
    assert ranked[0].feature == "hour" and ranked[-1].feature == "flat" and ranked[-1].importance == 0
    kept = {r.feature for r in L.select_features(importance).collect()}
    assert "hour" in kept and "flat" not in kept


def test_comparison_is_one_row_per_model(table):
    models = {"naive": "dep_lag_1", "trees": L.fit_regressor(table, **FEW), "two": L.fit_two_phase(table, **FEW)}
    got = {r.model: r for r in L.compare_models(L.long_predictions(table, models)).collect()}
    assert set(got) == set(models) and got["trees"].rmse < got["naive"].rmse


def test_regression_metrics_formulas(spark):
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    got = score(spark.createDataFrame(pd.DataFrame({"y": y, "yhat": p})))
    np.testing.assert_allclose(got.mae, 0.5)
    np.testing.assert_allclose(got.rmse, np.sqrt(np.mean((y - p) ** 2)))
    np.testing.assert_allclose(got.r2, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_metrics_are_stable_far_from_zero(spark):
    y = 1e9 + np.array([0.0, 1.0, 2.0, 3.0])
    got = score(spark.createDataFrame(pd.DataFrame({"y": y, "yhat": y + 0.5})))
    np.testing.assert_allclose(got.r2, 1 - 4 * 0.25 / 5.0)


def test_empty_cells_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, yhat int")
    assert sorted(map(tuple, metrics.confusion_matrix(df).collect())) == [(0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 0)]
    rows = {r.label: r for r in metrics.classification_report(df).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].f1, rows["1"].support) == (0.0, 0.0, 0.0, 1)
    np.testing.assert_allclose([rows["0"].precision, rows["0"].recall, rows["0"].f1], [2 / 3, 1.0, 0.8])
    np.testing.assert_allclose(rows["weighted avg"].f1, 0.8 * 2 / 3)


def test_station_seen_only_in_test_is_scored(table):
    train, new = table.filter(F.col("station_id") == "001"), table.filter(F.col("station_id") == "002")
    assert L.predict(L.fit_regressor(train, **FEW), new).filter("yhat is null").count() == 0


def test_m4_scores_the_full_models_beside_the_stump(spark, monkeypatch):
    import __spark_entry__ as entry
    from tripwise.checks.compare import compare, oracle_connection

    full = []
    for name in ("fit_regressor", "fit_two_phase"):
        fit = getattr(L, name)
        monkeypatch.setattr(L, name, lambda *a, fit=fit, name=name, **k: (k or full.append(name), fit(*a, **k))[1])
    folder = entry.SMOKE_FOLDER
    key = "M4_predict"
    assert compare(spark, oracle_connection(folder), entry.queries()[key], entry.oracle_sql()[key], folder) == []
    assert sorted(set(full)) == ["fit_regressor", "fit_two_phase"]
