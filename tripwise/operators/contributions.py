"""Additive contributions of features to the predictions of boosted trees (Shapley values of the fitted trees)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.operators.staging import fresh_path

CELLS = 1 << 21  # doubles of one step: rows times leaves times path features


@dataclass
class Paths:
    """All leaves of an ensemble whose paths ask about the same number of features.

    For leaf l and its i-th feature: `feature[l, i]`; a row passes if its value lies in (`low`, `high`], or, for a
    category, if `members[l, i, value]`; `share[l, i]` is the part of the fitted rows at those questions that passed.
    `value[l]` is the leaf's prediction times the weight of its tree.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    members: np.ndarray
    categorical: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def passed(self, rows: np.ndarray) -> np.ndarray:
        """[rows, leaves, features of the path] as numbers 0 and 1."""
        x = rows[:, self.feature]
        inside = (x > self.low) & (x <= self.high)
        if self.categorical.any():
            code = np.clip(np.where(self.categorical, x, 0), 0, self.members.shape[2] - 1).astype(np.int64)
            leaf, place = np.indices(self.feature.shape)
            inside = np.where(self.categorical, self.members[leaf, place, code], inside)
        return inside.astype(np.float64)

    def shares(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Contributions [rows, width] of these leaves.

        A leaf that knows only the features of a set S counts as value * prod(passed in S) * prod(share outside S). Its
        Shapley value for feature i is (passed_i - share_i) times the mean over t in [0, 1] of the product, over the other
        features, of share * (1 - t) + passed * t. That is a polynomial in t, so Gauss-Legendre points give it exactly;
        every factor is positive inside the interval, so the product without i is the whole product divided by factor i.
        """
        leaves, depth = self.feature.shape
        out = np.zeros((len(rows), width))
        points, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
        targets = np.zeros((depth, leaves, width))
        for i in range(depth):
            targets[i, np.arange(leaves), self.feature[:, i]] = 1.0
        step = max(1, CELLS // max(1, leaves * depth))
        for at in range(0, len(rows), step):
            passed = self.passed(rows[at:at + step])
            mean = np.zeros_like(passed)
            for t, w in zip((points + 1) / 2, weights / 2):
                factors = self.share * (1 - t) + passed * t
                mean += w * factors.prod(2)[:, :, None] / factors
            each = self.value[:, None] * (passed - self.share) * mean
            for i in range(depth):
                out[at:at + step] += each[:, :, i] @ targets[i]
        return out


@dataclass
class Ensemble:
    """A fitted ensemble as paths, with the mean prediction over the rows it was fitted to."""

    groups: list[Paths]
    base: float
    width: int

    def contributions(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width))
        for group in self.groups:
            out += group.shares(rows, self.width)
        return out


def _leaves(nodes: dict[int, dict], at: int, path: list[tuple[int, bool]]) -> Iterator[tuple[dict, list[tuple[int, bool]]]]:
    node = nodes[at]
    if node["leftChild"] < 0:
        yield node, path
        return
    yield from _leaves(nodes, node["leftChild"], [*path, (at, True)])
    yield from _leaves(nodes, node["rightChild"], [*path, (at, False)])


def _conditions(nodes: dict[int, dict], path: list[tuple[int, bool]], sizes: int) -> dict[int, list]:
    """Per feature of the path: low, high, members (or None), share."""
    found: dict[int, list] = {}
    for at, left in path:
        node = nodes[at]
        split = node["split"]
        child = nodes[node["leftChild"] if left else node["rightChild"]]
        condition = found.setdefault(split["featureIndex"], [-np.inf, np.inf, None, 1.0])
        condition[3] *= child["rawCount"] / node["rawCount"]
        if split["numCategories"] >= 0:
            of_left = np.zeros(sizes, bool)
            of_left[np.array(split["leftCategoriesOrThreshold"], int)] = True
            side = of_left if left else ~of_left
            condition[2] = side if condition[2] is None else condition[2] & side
        elif left:
            condition[1] = min(condition[1], split["leftCategoriesOrThreshold"][0])
        else:
            condition[0] = max(condition[0], split["leftCategoriesOrThreshold"][0])
    return found


def ensemble(spark: SparkSession, boosted) -> Ensemble:
    """Read a fitted boosted-tree model's nodes from its saved form. The nodes are the model, whose size is set by rounds and
    depth, so they may pass through the driver."""
    path = fresh_path(spark, "trees")
    boosted.write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"].asDict(recursive=True)
    splits = [n["split"] for nodes in trees.values() for n in nodes.values() if n["leftChild"] >= 0]
    sizes = max([1, *(s["numCategories"] for s in splits)])
    by_depth: dict[int, list] = {}
    base = 0.0
    for tree, weight in enumerate(boosted.treeWeights):
        nodes = trees[tree]
        for leaf, path_to in _leaves(nodes, 0, []):
            conditions = _conditions(nodes, path_to, sizes)
            value = weight * leaf["prediction"]
            base += value * float(np.prod([c[3] for c in conditions.values()]))
            if conditions:
                by_depth.setdefault(len(conditions), []).append((conditions, value))
    groups = []
    for depth, leaves in sorted(by_depth.items()):
        column = lambda i, leaves=leaves: np.array([[c[i] for c in cs.values()] for cs, _ in leaves])
        members = np.array([[np.ones(sizes, bool) if c[2] is None else c[2] for c in cs.values()] for cs, _ in leaves])
        categorical = np.array([[c[2] is not None for c in cs.values()] for cs, _ in leaves])
        groups.append(Paths(np.array([list(cs) for cs, _ in leaves]), column(0), column(1), members, categorical, column(3),
                            np.array([v for _, v in leaves])))
    return Ensemble(groups, base, boosted.numFeatures)


def with_contributions(model: PipelineModel, df: DataFrame, name: str = "contributions", base: str = "base") -> DataFrame:
    """Add `contributions` (one number for each feature, in the order of the model's vector) and `base` (the mean prediction
    over the fitted rows). Base and contributions add up to the prediction on every row; for a classifier, to the margin
    before its link.

    Each row follows the paths of all trees in its own task, from one broadcast table of the model's nodes. Columns of
    those names are replaced. An empty table gives no rows.
    """
    spark = df.sparkSession
    found = ensemble(spark, model.stages[-1])
    nodes = spark.sparkContext.broadcast(found.groups)
    keep = [c for c in df.columns if c not in (name, base)]
    width, mean = found.width, found.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            each = Ensemble(nodes.value, mean, width).contributions(rows)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(each.reshape(-1))), pa.array(np.full(len(rows), mean))],
                names=[*keep, name, base])

    prepared = PipelineModel(model.stages[:-1]).transform(df).select(*keep, vector_to_array("features").alias("_vector"))
    schema = df.select(*keep).schema.add(name, T.ArrayType(T.DoubleType())).add(base, T.DoubleType())
    return prepared.mapInArrow(run, schema)


def mean_contributions(scored: DataFrame, columns, name: str = "contributions") -> DataFrame:
    """`feature`, `importance`: mean absolute contribution of each column, largest first."""
    each = [F.avg(F.abs(F.col(name)[i])).alias(f"_{i}") for i in range(len(columns))]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("importance")) for i, c in enumerate(columns)])
    return scored.agg(*each).select(F.inline(rows)).orderBy(F.desc("importance"), "feature")
