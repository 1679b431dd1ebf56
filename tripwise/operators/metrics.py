"""Forecast quality: regression and classification figures from single aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(predictions: DataFrame, by=(), y: str = "y", predicted: str = "yhat") -> DataFrame:
    """MAE, RMSE and R2, per group when `by` is given. Total variation uses the stable population variance."""
    t, p = F.col(y).cast("double"), F.col(predicted).cast("double")
    error = t - p
    total = F.var_pop(t) * F.count(t)
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), total)).alias("r2"),
    )


def cv_summary(folds: DataFrame, metrics=("mae", "rmse", "r2")) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    long = folds.unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _cells(predictions: DataFrame, y: str, predicted: str) -> DataFrame:
    def cell(t: int, p: int):
        return F.count_if((F.col(y) == t) & (F.col(predicted) == p)).alias(f"c{t}{p}")

    return predictions.agg(*[cell(t, p) for t in (0, 1) for p in (0, 1)])


def confusion_matrix(predictions: DataFrame, y: str = "y", predicted: str = "yhat") -> DataFrame:
    """2x2 counts as rows (actual, predicted, n); empty cells are present with 0."""
    rows = [
        F.struct(F.lit(t).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{t}{p}").alias("n"))
        for t in (0, 1)
        for p in (0, 1)
    ]
    return _cells(predictions, y, predicted).select(F.inline(F.array(*rows)))


def classification_report(predictions: DataFrame, y: str = "y", predicted: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages. 0/0 counts as 0."""
    c = _cells(predictions, y, predicted)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    for k in (0, 1):
        o = 1 - k
        hit, support = F.col(f"c{k}{k}"), F.col(f"c{k}0") + F.col(f"c{k}1")
        claimed = F.col(f"c{k}{k}") + F.col(f"c{o}{k}")
        c = c.withColumns({f"p{k}": ratio(hit, claimed), f"r{k}": ratio(hit, support), f"s{k}": support})
        c = c.withColumn(f"f{k}", ratio(2 * F.col(f"p{k}") * F.col(f"r{k}"), F.col(f"p{k}") + F.col(f"r{k}")))
    n = F.col("s0") + F.col("s1")

    def row(label, precision, recall, f1, support):
        return F.struct(
            F.lit(label).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    def macro(m):
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m):
        return ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), n)

    accuracy = ratio(F.col("c00") + F.col("c11"), n)
    rows = [row(str(k), F.col(f"p{k}"), F.col(f"r{k}"), F.col(f"f{k}"), F.col(f"s{k}")) for k in (0, 1)]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, n))
    rows.append(row("macro avg", macro("p"), macro("r"), macro("f"), n))
    rows.append(row("weighted avg", weighted("p"), weighted("r"), weighted("f"), n))
    return c.select(F.inline(F.array(*rows)))


def f1_score(predictions: DataFrame, y: str = "y", predicted: str = "yhat") -> DataFrame:
    """F1 of class 1 as one row."""
    return classification_report(predictions, y, predicted).filter(F.col("label") == "1").select("f1")
