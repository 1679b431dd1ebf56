"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.llm.common import drawn, held_out, packed, seeded_key, tidy
from tripwise.operators.staging import materialize

SEED = "quality-1"
FIT_POSITIVES = 10_000
FIT_UNLABELLED = 20_000
HIDDEN = 16
STEPS = 300
RATE = 0.02
DECAY = 1e-4
THRESHOLD = 0.3
SYMBOLS = b"$%#&*!|<>{}[]=~^_@\\/+"
ENDS = b".?!"
STATISTICS = 27


def text_statistics(text: str | None) -> np.ndarray:
    """STATISTICS numbers that describe the whole text: shares of kinds of characters, shapes of words and lines,
    repetition and compressibility. Null and empty texts give zeros."""
    out = np.zeros(STATISTICS)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    n, count = len(raw), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line for line in raw.split(b"\n") if line]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    distinct, repeats = len(seen), sum(map(operator.eq, words, words[1:]))
    lower, upper, digits = count[97:123].sum(), count[65:91].sum(), count[48:58].sum()
    symbols = sum(int(count[c]) for c in SYMBOLS)
    ends = sum(int(count[c]) for c in ENDS)
    out[:STATISTICS] = (
        np.log1p(n), np.log1p(len(words)), lower / n, upper / n, digits / n, count[128:].sum() / n, symbols / n,
        np.log1p(1000 * symbols / n), np.log1p(1000 * upper / n), np.log1p(1000 * digits / n), np.log1p(1000 * count[33] / n),
        np.log1p(1000 * count[124] / n), np.log1p(1000 * count[44] / n), np.log1p(1000 * ends / n), np.log1p(1000 * count[10] / n),
        sizes.mean(), sizes.std(), np.log1p(sizes.max()), distinct / len(words), distinct / np.sqrt(len(words)),
        len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), len(zlib.compress(raw, 1)) / n,
        sum(map(bytes.isupper, words)) / len(words), np.log1p(1000 * repeats / len(words)), max(seen.values()) / len(words),
        len(words) / n,
    )
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def statistics_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([text_statistics(t).astype(np.float32) for t in texts])


@dataclass(frozen=True)
class PuModel:
    """A net with one hidden layer over standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        x = np.clip((statistics - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.tanh(x @ a + b) @ c + d, -30, 30)))


def _net(x: np.ndarray, weights):
    a, b, c, d = weights
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ c + d


def _slope(x, hidden, weights, by_output: np.ndarray):
    """Gradient of a sum of outputs weighted by `by_output`."""
    back = by_output[:, None] * weights[2][None, :] * (1 - hidden ** 2)
    return x.T @ back, back.sum(0), hidden.T @ by_output, by_output.sum()


def fit_non_negative(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, ...]:
    """Minimise prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with the logistic loss.

    The second term estimates the risk on the negatives hidden in the unlabelled rows. Where it falls below zero it is
    pushed back up instead, which keeps a flexible model from fitting the positives by heart.
    """
    rng = np.random.default_rng(7)
    width = positives.shape[1]
    weights = [rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        hp, gp = _net(positives, weights)
        hu, gu = _net(unlabelled, weights)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        hidden_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        as_negative = (-prior * sp / len(gp), su / len(gu))
        if hidden_risk >= 0:
            dp, du = prior * (sp - 1) / len(gp) + as_negative[0], as_negative[1]
        else:
            dp, du = -as_negative[0], -as_negative[1]
        slopes = [p + u for p, u in zip(_slope(positives, hp, weights, dp), _slope(unlabelled, hu, weights, du))]
        for i, slope in enumerate(slopes):
            slope = slope + DECAY * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope ** 2
            weights[i] = weights[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(weights)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        positives: int = FIT_POSITIVES, unlabelled: int = FIT_UNLABELLED) -> tuple[PuModel | None, DataFrame]:
    """A model and the table of `doc_id` and `statistics` of all documents.

    Means and deviations are those of all documents. Trusted positives are labelled rows of quality 1, unlabelled rows
    any documents; of each a seeded draw of bounded size is taken. The class prior is the share of quality 1 among the
    labelled rows. Only labels of ids that are not held out are read; of repeated labels the highest counts, null
    labels count for nothing. No model without a positive.
    """
    table = materialize(documents.select(
        F.col(id_col).alias("doc_id"), seeded_key(SEED, F.col(id_col)).alias("key"),
        statistics_udf(F.col(text_col)).alias("statistics")), "quality-statistics")
    each = [F.col("statistics")[i] for i in range(STATISTICS)]
    moments = table.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    good = drawn(table.join(known.filter("quality = 1"), "doc_id").select("key", "statistics"), "key", positives)
    if not good:
        return None, table
    mixed = drawn(table.select("key", "statistics"), "key", unlabelled)
    mean, scale = np.array(moments[:STATISTICS]), np.array(moments[STATISTICS:]) + 1e-6
    tidy(documents.sparkSession)
    p, u = (np.clip((np.array([r["statistics"] for r in rows]) - mean) / scale, -8, 8) for rows in (good, mixed))
    return PuModel(mean, scale, fit_non_negative(p, u, share)), table


def score(statistics, model: PuModel | None):
    """The model's score for a column of statistics; 0.5 where there is no model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf(T.DoubleType())
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(rows.to_numpy()).astype(float)) if len(rows) else [], dtype="float64")

    return scored(statistics)


def quality_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD) for every document.

    Scores come from the whole text alone. Null and empty texts have statistics of zero and are scored like any other;
    repeated rows get equal scores; without usable labels every score is 0.5; an empty table gives no rows.
    """
    model, table = fit(documents, labels)
    scored = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("statistics"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns. Their texts are read again instead of shuffled."""
    model, _ = fit(documents, labels)
    scored = documents.select(packed(documents), score(statistics_udf(F.col("text")), model).alias("score"))
    return scored.filter(F.col("score") >= threshold).select("_row.*")
