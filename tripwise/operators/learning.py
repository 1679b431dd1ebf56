"""Forecast models on Spark ML: boosted trees in one or two phases, validation, tuning, importance.

Feature tables come in as written tables (see `staging.materialize`): boosting reads them many times.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwise.functions.columns import binary_target, require_columns, two_phase_combine
from tripwise.operators import leafwise
from tripwise.operators.contributions import mean_contributions, with_contributions
from tripwise.operators.folds import sample_per_station, time_series_folds
from tripwise.operators.metrics import cv_summary, f1_score, regression_metrics
from tripwise.operators.staging import ensure_checkpoint_dir, materialize
from tripwise.operators.tuning import search
from tripwise.operators.usage import union_all

# The 20 features the published models use.
SELECTED_FEATURES = (
    "dep_same_hour_mean_7d", "dep_lag_1", "hour", "dep_roll_mean_3", "dep_lag_2", "station_id", "temperature",
    "dep_lag_24", "dep_lag_168", "is_weekend", "month", "dep_roll_mean_24", "weekday", "precipitation",
    "dep_roll_std_24", "year", "dep_lag_72", "dep_same_hour_std_7d", "dep_lag_3", "wind_speed",
)
# Bounds of the tuning space, (kind, low, high, step).
TUNING_SPACE = {
    "num_leaves": ("step", 20, 150, 1),
    "n_estimators": ("step", 100, 500, 25),
    "max_depth": ("step", 3, 15, 1),
    "learning_rate": ("log", 0.01, 0.3, None),
    "feature_fraction": ("flat", 0.5, 1.0, None),
    "bagging_fraction": ("flat", 0.5, 1.0, None),
    "min_child_samples": ("step", 5, 50, 1),
}
# The tuned settings of the three published models, in the parameter names above.
TUNED_REGRESSOR = {
    "bagging_fraction": 0.9057331994746333, "feature_fraction": 0.5892686656410099,
    "learning_rate": 0.04479216014934237, "max_depth": 12, "min_child_samples": 50, "n_estimators": 350,
    "num_leaves": 127,
}
TUNED_CLASSIFIER = {
    "bagging_fraction": 0.8442905768097371, "feature_fraction": 0.5163806976887504,
    "learning_rate": 0.04238748152900556, "max_depth": 8, "min_child_samples": 38, "n_estimators": 500,
    "num_leaves": 111,
}
TUNED_POSITIVE_REGRESSOR = {
    "bagging_fraction": 0.8177888306580715, "feature_fraction": 0.5362878147369727,
    "learning_rate": 0.06413085337918903, "max_depth": 10, "min_child_samples": 28, "n_estimators": 375,
    "num_leaves": 100,
}

TARGET = "departures"
CATEGORIES = ("station_id", "hour", "weekday", "month")
ENCODED = "station_id"  # as many values as there are stations: enters as the mean of the target
MAX_BINS = 32
CHECKPOINT_EVERY = 10  # boosting rounds


def tree_settings(params: dict) -> dict:
    """Translate a parameter set to Spark's boosted trees.

    Trees grow level by level here, so a leaf limit becomes the depth that holds as many leaves. A bagging fraction
    leaves out rows only together with a bagging frequency above zero, which is where its published meaning begins.
    """
    depth = int(params.get("max_depth", 5))
    if "num_leaves" in params:
        depth = min(depth, max(1, math.ceil(math.log2(int(params["num_leaves"])))))
    out = {"maxDepth": depth}
    names = {"n_estimators": ("maxIter", int), "learning_rate": ("stepSize", float),
             "min_child_samples": ("minInstancesPerNode", int)}
    for source, (name, kind) in names.items():
        if source in params:
            out[name] = kind(params[source])
    if params.get("bagging_freq", 0) > 0 and "bagging_fraction" in params:
        out["subsamplingRate"] = float(params["bagging_fraction"])
    if "feature_fraction" in params:
        out["featureSubsetStrategy"] = str(float(params["feature_fraction"]))
    return out


def prepare(features: DataFrame, target: str = TARGET) -> DataFrame:
    """Add the regression target `y` and the activity target `active`."""
    return features.withColumns({"y": F.col(target).cast("double"), "active": binary_target(F.col(target)).cast("double")})


def xy_split(features: DataFrame, columns=SELECTED_FEATURES, target: str = TARGET) -> DataFrame:
    """The named features and the target as `y`; a missing feature stops the plan."""
    return require_columns(features, columns).select(*columns, F.col(target).alias("y"))


def categorize(df: DataFrame, columns=CATEGORIES):
    """Indexers for categorical columns. Labels (one per station) are the only thing that reaches the driver."""
    indexer = StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_index" for c in columns], handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    return indexer.fit(df)


def _inputs(columns, label: str) -> list:
    """Index the categories, encode the station, assemble the vector.

    Hour, weekday and month are categories of fixed number. The station enters as the mean target of its training
    rows, one number whatever the number of stations, so the trees' bins do not depend on the size of the data.
    """
    text = [c for c in columns if c in CATEGORIES]
    stages = []
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=[f"{c}_index" for c in text], handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    if ENCODED in text:
        stages.append(TargetEncoder(inputCols=[f"{ENCODED}_index"], outputCols=[f"{ENCODED}_mean"], labelCol=label,
                                    targetType="binary" if label == "active" else "continuous", handleInvalid="keep"))
        # an expression sheds the attribute of the index, or the mean would be taken for a category
        stages.append(SQLTransformer(statement=f"SELECT *, {ENCODED}_mean + 0.0D AS {ENCODED}_level FROM __THIS__"))
    inputs = [f"{c}_level" if c == ENCODED else f"{c}_index" if c in text else c for c in columns]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def _stages(columns, estimator) -> Pipeline:
    return Pipeline(stages=[*_inputs(columns, estimator.getLabelCol()), estimator])


def _boosting(kind, label: str, train: DataFrame, columns, max_iter, max_depth, seed, params):
    ensure_checkpoint_dir(train.sparkSession)
    settings = {"maxIter": max_iter, "maxDepth": max_depth, **tree_settings(params or {"max_depth": max_depth})}
    return kind(
        labelCol=label, featuresCol="features", seed=seed, maxBins=MAX_BINS, maxMemoryInMB=1024,
        checkpointInterval=CHECKPOINT_EVERY, **settings,
    )


def regression_pipeline(train: DataFrame, columns=SELECTED_FEATURES, max_iter: int = 20, max_depth: int = 5,
                        seed: int = 0, params: dict | None = None) -> Pipeline:
    return _stages(columns, _boosting(GBTRegressor, "y", train, columns, max_iter, max_depth, seed, params))


def fit_regressor(train: DataFrame, columns=SELECTED_FEATURES, **settings) -> PipelineModel:
    """Boosted regression trees for `y`."""
    require_columns(train, columns)
    return regression_pipeline(train, columns, **settings).fit(train)


def fit_classifier(train: DataFrame, columns=SELECTED_FEATURES, max_iter: int = 20, max_depth: int = 5, seed: int = 0,
                   params: dict | None = None) -> PipelineModel:
    """Boosted trees for `active` (demand above zero)."""
    require_columns(train, columns)
    estimator = _boosting(GBTClassifier, "active", train, columns, max_iter, max_depth, seed, params)
    return _stages(columns, estimator).fit(train)


def fit_leafwise(train: DataFrame, columns=SELECTED_FEATURES, params: dict | None = None, label: str = "y",
                 seed: int = 0) -> leafwise.LeafwiseModel:
    """Trees grown leaf by leaf: the leaf limit of the parameters is obeyed as it is. A classifier where the label is `active`."""
    require_columns(train, columns)
    objective = "binary" if label == "active" else "regression"
    return leafwise.fit(train, Pipeline(stages=_inputs(columns, label)), label, params, objective, seed)


def fit_leafwise_two_phase(train: DataFrame, columns=SELECTED_FEATURES, classifier: dict | None = None,
                           regressor: dict | None = None, seed: int = 0) -> tuple[leafwise.LeafwiseModel, leafwise.LeafwiseModel]:
    """Classifier on all rows, regressor on the rows with demand; `predict_two_phase` takes the pair."""
    active = fit_leafwise(train, columns, classifier, "active", seed)
    return active, fit_leafwise(train.filter(F.col("y") > 0), columns, regressor, "y", seed)


def fit_two_phase(train: DataFrame, columns=SELECTED_FEATURES, classifier: dict | None = None,
                  regressor: dict | None = None, **settings) -> tuple[PipelineModel, PipelineModel]:
    """Classifier on all rows, regressor on the rows with demand."""
    active = fit_classifier(train, columns, params=classifier, **settings)
    amount = fit_regressor(train.filter(F.col("y") > 0), columns, params=regressor, **settings)
    return active, amount


def _scored(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    keep = [c for c in df.columns if c != name]
    return model.transform(df).select(*keep, F.col("prediction").alias(name))


def predict(model: PipelineModel, df: DataFrame, name: str = "yhat") -> DataFrame:
    return _scored(model, df, name)


def predict_two_phase(active: PipelineModel, amount: PipelineModel, df: DataFrame, name: str = "yhat") -> DataFrame:
    """Zero where the classifier sees no demand, the regressor elsewhere; `active_hat` keeps the class."""
    both = _scored(amount, _scored(active, df, "active_hat"), "amount_hat")
    return both.withColumn(name, two_phase_combine(F.col("active_hat"), F.col("amount_hat"))).drop("amount_hat")


def with_folds(features: DataFrame, splits: int = 7) -> DataFrame:
    """Feature table with targets and fold numbers, written once because every fold reads it."""
    return materialize(prepare(time_series_folds(features, splits)), "folds")


def _split(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return folded.filter(F.col("fold") < fold), folded.filter(F.col("fold") == fold)


def _per_fold(folded: DataFrame, splits: int, score, parallelism: int) -> DataFrame:
    """Fit and score every split. Fits are independent Spark jobs, so several run at once."""

    def run(fold: int) -> DataFrame:
        return score(*_split(folded, fold)).select(F.lit(fold).alias("fold"), "*")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return union_all(*pool.map(run, range(1, splits + 1)))


def cv_regression(folded: DataFrame, splits: int = 7, columns=SELECTED_FEATURES, parallelism: int = 4, **settings) -> DataFrame:
    """MAE, RMSE and R2 of each expanding split."""
    return _per_fold(
        folded, splits,
        lambda train, valid: regression_metrics(predict(fit_regressor(train, columns, **settings), valid)),
        parallelism,
    )


def cv_two_phase(folded: DataFrame, splits: int = 7, columns=SELECTED_FEATURES, parallelism: int = 4, **settings) -> DataFrame:
    return _per_fold(
        folded, splits,
        lambda train, valid: regression_metrics(
            predict_two_phase(*fit_two_phase(train, columns, **settings), valid)
        ),
        parallelism,
    )


def summarize(folds: DataFrame) -> DataFrame:
    return cv_summary(folds)


def loss_reg(train: DataFrame, valid: DataFrame, params: dict, columns=SELECTED_FEATURES, two_phase: bool = False, **settings) -> DataFrame:
    """MAE of one split as `loss`. With `two_phase`, only rows with demand train and are scored."""
    if two_phase:
        train, valid = train.filter(F.col("y") > 0), valid.filter(F.col("y") > 0)
    scored = predict(fit_regressor(train, columns, params=params, **settings), valid)
    return regression_metrics(scored).select(F.col("mae").alias("loss"))


def loss_clf(train: DataFrame, valid: DataFrame, params: dict, columns=SELECTED_FEATURES, **settings) -> DataFrame:
    """Negative F1 of the active class of one split as `loss`."""
    scored = predict(fit_classifier(train, columns, params=params, **settings), valid)
    return f1_score(scored, "active", "yhat").select((-F.col("f1")).alias("loss"))


def objective_reg(folded: DataFrame, params: dict, splits: int = 7, columns=SELECTED_FEATURES,
                  two_phase: bool = False, parallelism: int = 4, **settings) -> DataFrame:
    """Mean MAE over the splits."""
    score = partial(loss_reg, params=params, columns=columns, two_phase=two_phase, **settings)
    return _per_fold(folded, splits, score, parallelism).agg(F.avg("loss").alias("loss"))


def objective_clf(folded: DataFrame, params: dict, splits: int = 7, columns=SELECTED_FEATURES, parallelism: int = 4,
                  **settings) -> DataFrame:
    """Negative mean F1 of the active class over the splits."""
    score = partial(loss_clf, params=params, columns=columns, **settings)
    return _per_fold(folded, splits, score, parallelism).agg(F.avg("loss").alias("loss"))


def tune(folded: DataFrame, loss=loss_reg, trials: int = 30, splits: int = 7, space: dict | None = None,
         parallelism: int = 4, seed: int = 0, grace: int = 2, **settings) -> DataFrame:
    """Adaptive search over the tuning space (see `tuning`), best first.

    `trial`, `loss` (mean over the scored splits), `folds` (how many were scored), `stopped`, and the parameters. Trials
    run as concurrent Spark jobs, split after split; each split brings one number back, and a trial that is weaker than
    the median of earlier ones stops before its last split. Whole trials come before stopped ones. `settings` go to the loss.
    """
    space = space or TUNING_SPACE

    def score(params: dict, fold: int) -> float:
        # rounded, as sums of doubles depend on the order in which tasks end
        return round(loss(*_split(folded, fold), params, **settings).first()["loss"], 9)

    found = search(space, score, splits, trials, parallelism, seed, grace)
    rows = [(t.number, t.loss, len(t.losses), t.stopped, *[float(t.params[k]) for k in space]) for t in found]
    schema = "trial int, loss double, folds int, stopped boolean, " + ", ".join(f"`{k}` double" for k in space)
    return folded.sparkSession.createDataFrame(rows, schema).orderBy("stopped", "loss", "trial")


def best_params(tuned: DataFrame, space: dict | None = None) -> dict:
    """The parameters of the best whole trial; steps of one are whole numbers."""
    row = tuned.filter("not stopped").orderBy("loss", "trial").first()
    return {k: int(row[k]) if kind == "step" else row[k] for k, (kind, *_) in (space or TUNING_SPACE).items()}


def feature_importance(model: PipelineModel, features: DataFrame, columns=SELECTED_FEATURES, per_station: int = 50) -> DataFrame:
    """Mean absolute contribution of each feature over a sample per station, largest first.

    Contributions are the Shapley values of the fitted trees (see `contributions`): with the base value they add up to
    the prediction of every row.
    """
    sample = sample_per_station(prepare(features), per_station)
    return mean_contributions(with_contributions(model, sample), columns)


def exchange_importance(model: PipelineModel, features: DataFrame, columns=SELECTED_FEATURES, per_station: int = 50) -> DataFrame:
    """Mean absolute change of the prediction when one feature is exchanged, largest first.

    Rows are a sample per station. Rows of the same sample rank form a ring in hash order, and each row takes
    the feature of the next one, so values are exchanged between stations without any global order. All
    features are scored in one pass over sample x features.
    """
    sample = sample_per_station(prepare(features), per_station).select("time", "sample_rank", *dict.fromkeys(("station_id", *columns)))
    ring = Window.partitionBy("sample_rank").orderBy(F.md5(F.concat_ws("#", "station_id", F.col("time").cast("string"))))
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bundle = F.struct(*columns)
    rows = sample.withColumn("_other", F.coalesce(F.lead(bundle).over(ring), F.first(bundle).over(whole)))
    base = _scored(model, rows, "_base")
    changed = base.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    exchanged = {c: F.when(F.col("feature") == c, F.col(f"_other.{c}")).otherwise(F.col(c)) for c in columns}
    again = _scored(model, changed.withColumns(exchanged), "_again")
    return (
        again.groupBy("feature")
        .agg(F.avg(F.abs(F.col("_again") - F.col("_base"))).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def select_features(importance: DataFrame, above: float = 0.01) -> DataFrame:
    return importance.filter(F.col("importance") > above)


def long_predictions(test: DataFrame, models: dict) -> DataFrame:
    """Rows (model, station_id, time, y, yhat) of a baseline, a regressor and a two-phase pair.

    `models` maps a name to a model, to a (classifier, regressor) pair or to the name of a column.
    """
    parts = []
    for name, model in models.items():
        if isinstance(model, str):
            scored = test.withColumn("yhat", F.col(model).cast("double"))
        elif isinstance(model, tuple):
            scored = predict_two_phase(*model, test)
        else:
            scored = predict(model, test)
        parts.append(scored.select(F.lit(name).alias("model"), "station_id", "time", "y", "yhat"))
    return union_all(*parts)


def compare_models(predictions: DataFrame) -> DataFrame:
    return regression_metrics(predictions, by=("model",))
