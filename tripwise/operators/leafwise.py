"""Boosted trees that grow leaf by leaf, the best split first, up to an exact number of leaves.

Rows stay in the executors as a written table of bin numbers. A step sends the grown part of the tree to the tasks, which add
up gradients per (leaf, feature, bin); the sums, whose number is set by parameters alone, come back and decide the splits.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.operators.staging import materialize

BINS = 255  # of a feature
WAVE = 8  # leaves whose halves are counted in one pass
REWRITE = 10  # trees after which the scores are written anew
LEAST_WEIGHT = 1e-3
SCALE = 1 << 20  # steps of the seeded draw of rows

# What a parameter means that is not given.
DEFAULTS = {"num_leaves": 31, "n_estimators": 100, "max_depth": -1, "learning_rate": 0.1, "feature_fraction": 1.0,
            "bagging_fraction": 1.0, "bagging_freq": 0, "min_child_samples": 20}


@dataclass
class Tree:
    """Node 0 is the root. A node asks whether a row's bin of `feature` is at most `bin`; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, at: int, feature: int, bin: int) -> tuple[int, int]:
        """Turn a leaf into a question and return its two new leaves."""
        first = len(self.feature)
        self.feature[at], self.bin[at], self.left[at], self.right[at] = feature, bin, first, first + 1
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(0.0)
        return first, first + 1

    def copy(self) -> "Tree":
        return Tree(*(list(x) for x in (self.feature, self.bin, self.left, self.right, self.value)))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bin numbers."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            asks = feature[node] >= 0
            if not asks.any():
                return node
            here = node[asks]
            low = bins[rows[asks], feature[here]] <= cut[here]
            node[asks] = np.where(low, left[here], right[here])

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: bin i of a feature holds values above edge i - 1 and up to edge i; NaN falls in the last bin."""
    return np.stack([np.searchsorted(e, values[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.int16)


def _gradients(objective: str, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "binary":
        p = 1 / (1 + np.exp(-score))
        return p - y, p * (1 - p)
    return score - y, np.ones_like(y)


def _table(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return bins, batch.column("y").to_numpy(zero_copy_only=False), batch.column("score").to_numpy(zero_copy_only=False)


def _counted(shared, width: int, objective: str, kept: tuple[int, int, int]):
    """Sums of gradients, curvatures and rows per (slot, feature, bin) of a task. `kept`: seed, limit and whether rows are drawn."""
    seed, limit, drawn = kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, growing, slots, count = shared.value
        slot_of = np.full(len(growing.feature), -1)
        slot_of[list(slots)] = list(slots.values())
        sums = np.zeros((3, count, width, BINS + 1))
        for batch in batches:
            bins, y, score = _table(batch, width)
            for tree in trees:
                score = score + tree.scores(bins)
            slot = slot_of[growing.leaf_of(bins)]
            inside = slot >= 0
            if drawn:
                draw = (batch.column("draw").to_numpy(zero_copy_only=False) * (2 * seed + 1)) % SCALE
                inside &= draw < limit
            if not inside.any():
                continue
            g, h = _gradients(objective, y[inside], score[inside])
            at = slot[inside] * (BINS + 1)
            for f in range(width):
                place = at + bins[inside, f]
                for i, weights in enumerate((g, h, None)):
                    sums[i, :, f] += np.bincount(place, weights, count * (BINS + 1)).reshape(count, -1)
        s, f, b = np.nonzero(sums[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int32)) for x in (s, f, b)] + [pa.array(sums[i, s, f, b]) for i in range(3)],
            names=["slot", "feature", "bin", "g", "h", "n"])

    return run


@dataclass
class _Leaf:
    node: int
    sums: np.ndarray  # [3]: gradient, curvature, rows
    depth: int
    histogram: np.ndarray | None  # [3, features, bins]
    gain: float = 0.0
    feature: int = -1
    bin: int = 0
    lower: np.ndarray | None = None  # sums of the rows up to the bin
    halves: tuple[np.ndarray, np.ndarray] | None = None


def _choose(leaf: _Leaf, features: list[int], least: int, deepest: int) -> None:
    """Find the leaf's best split (ties: the lower feature and bin)."""
    if leaf.histogram is None or (deepest > 0 and leaf.depth >= deepest):
        return
    low = leaf.histogram.cumsum(2)[:, features, :-1]
    high = leaf.sums[:, None, None] - low
    able = (low[2] >= least - 0.5) & (high[2] >= least - 0.5) & (low[1] >= LEAST_WEIGHT) & (high[1] >= LEAST_WEIGHT)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(able, low[0] ** 2 / low[1] + high[0] ** 2 / high[1] - leaf.sums[0] ** 2 / leaf.sums[1], -np.inf)
    best = int(gain.argmax())
    f, b = divmod(best, gain.shape[1])
    if gain[f, b] > 1e-9:
        leaf.gain, leaf.feature, leaf.bin, leaf.lower = float(gain[f, b]), features[f], b, low[:, f, b]


class _Grower:
    """Grows one tree after another on a written table."""

    def __init__(self, table: DataFrame, width: int, objective: str, params: dict, seed: int):
        self.table, self.width, self.objective, self.params = table, width, objective, params
        self.rng = random.Random(seed)
        self.pending: list[Tree] = []

    def _histograms(self, growing: Tree, slots: dict[int, int]) -> np.ndarray:
        spark: SparkSession = self.table.sparkSession
        count = len(slots)
        shared = spark.sparkContext.broadcast((self.pending, growing, slots, count))
        counted = self.table.mapInArrow(_counted(shared, self.width, self.objective, self.kept),
                                        "slot int, feature int, bin int, g double, h double, n double")
        out = np.zeros((3, count, self.width, BINS + 1))
        for r in counted.groupBy("slot", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
            out[:, r["slot"], r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
        shared.destroy()
        return out

    def _halve(self, tree: Tree, leaves: list[_Leaf]) -> None:
        """Count the smaller half of each leaf in one pass; the other half is the difference."""
        tentative, slots, smaller = tree.copy(), {}, []
        for i, leaf in enumerate(leaves):
            pair = tentative.split(leaf.node, leaf.feature, leaf.bin)
            side = 0 if leaf.lower[2] * 2 <= leaf.sums[2] else 1
            slots[pair[side]] = i
            smaller.append(side)
        found = self._histograms(tentative, slots)
        for i, (leaf, side) in enumerate(zip(leaves, smaller)):
            pair = (found[:, i], leaf.histogram - found[:, i])
            leaf.halves = pair if side == 0 else pair[::-1]

    def grow(self, number: int) -> Tree:
        p = self.params
        share = p["bagging_fraction"] if p["bagging_freq"] > 0 else 1.0
        self.kept = (number // max(1, p["bagging_freq"]), int(share * SCALE), share < 1)
        features = sorted(self.rng.sample(range(self.width), max(1, math.ceil(p["feature_fraction"] * self.width))))
        tree = Tree()
        whole = self._histograms(tree, {0: 0})[:, 0]
        leaves = [_Leaf(0, whole[:, 0].sum(1), 0, whole)]
        _choose(leaves[0], features, p["min_child_samples"], p["max_depth"])
        while len(leaves) < p["num_leaves"]:
            able = sorted((x for x in leaves if x.feature >= 0), key=lambda x: (-x.gain, x.node))
            if not able:
                break
            best, more = able[0], p["num_leaves"] - len(leaves) - 1
            if more and best.halves is None:
                self._halve(tree, [x for x in able if x.halves is None][:min(WAVE, more)])
            pair = tree.split(best.node, best.feature, best.bin)
            halves = best.halves or (None, None)
            children = [_Leaf(node, sums, best.depth + 1, histogram)
                        for node, sums, histogram in zip(pair, (best.lower, best.sums - best.lower), halves)]
            for child in children:
                _choose(child, features, p["min_child_samples"], p["max_depth"])
            leaves = [x for x in leaves if x is not best] + children
        for leaf in leaves:
            tree.value[leaf.node] = float(-p["learning_rate"] * leaf.sums[0] / leaf.sums[1]) if leaf.sums[1] else 0.0
        self.pending.append(tree)
        if len(self.pending) == REWRITE:
            self._rewrite()
        return tree

    def _rewrite(self) -> None:
        """Write the scores with the pending trees added, so that a pass never applies more than REWRITE trees."""
        shared = self.table.sparkSession.sparkContext.broadcast(self.pending)
        width, names = self.width, self.table.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, _, score = _table(batch, width)
                for tree in shared.value:
                    score = score + tree.scores(bins)
                yield pa.RecordBatch.from_arrays([pa.array(score) if n == "score" else batch.column(n) for n in names], names=names)

        self.table, self.pending = materialize(self.table.mapInArrow(run, self.table.schema), "leafwise-scores"), []
        shared.destroy()


@dataclass
class LeafwiseModel:
    """Trees over binned features; `transform` adds `prediction` (for a classifier the class, with the margin as `margin`)."""

    prepared: PipelineModel
    edges: list[np.ndarray]
    trees: list[Tree]
    start: float
    objective: str

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            out += tree.scores(bins)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c not in ("prediction", "margin")]
        kept = self.prepared.transform(df).select(*names, vector_to_array("features").alias("_vector"))
        shared = df.sparkSession.sparkContext.broadcast((self.edges, self.trees, self.start, self.objective))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, trees, start, objective = shared.value
            for batch in batches:
                rows = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
                margin = LeafwiseModel(None, edges, trees, start, objective).margins(to_bins(rows, edges))
                prediction = (margin > 0).astype(float) if objective == "binary" else margin
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prediction), pa.array(margin)], names=[*names, "prediction", "margin"])

        schema = df.select(*names).schema.add("prediction", T.DoubleType()).add("margin", T.DoubleType())
        return kept.mapInArrow(run, schema)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.prepared.write().overwrite().save(f"{path}/prepared")
        state = {"edges": [e.tolist() for e in self.edges], "start": self.start, "objective": self.objective}
        spark.createDataFrame([(json.dumps(state),)], "value string").write.mode("overwrite").text(f"{path}/state")
        rows = [(i, json.dumps(vars(t))) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "number int, tree string").write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, path: str) -> "LeafwiseModel":
        spark = SparkSession.getActiveSession()
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        trees = [Tree(**json.loads(r["tree"])) for r in spark.read.parquet(f"{path}/trees").orderBy("number").collect()]
        return cls(PipelineModel.load(f"{path}/prepared"), [np.array(e) for e in state["edges"]], trees, state["start"], state["objective"])


def _edges(values: DataFrame, width: int) -> list[np.ndarray]:
    """Upper edges of bins of about equal numbers of rows; a feature with few values gets a bin for each."""
    ranks = [i / BINS for i in range(1, BINS)]
    found = values.agg(*[F.percentile_approx(F.col("v")[f], ranks, 100 * BINS) for f in range(width)]).first()
    return [np.unique(np.array(e if e is not None else [], float)) for e in found]


def fit(train: DataFrame, prepare: Pipeline, label: str, params: dict | None = None, objective: str = "regression", seed: int = 0) -> LeafwiseModel:
    """Boost trees of at most `num_leaves` leaves; every tree has exactly as many unless no further split is allowed.

    `prepare` makes the vector column `features`. The first score is the mean of the label (its log odds for `binary`). A
    split needs `min_child_samples` rows on both sides and a gain; `max_depth` below one is no limit. Without rows the
    model is the constant zero.
    """
    settings = DEFAULTS | {k: v for k, v in (params or {}).items() if k in DEFAULTS}
    for name in ("num_leaves", "n_estimators", "max_depth", "min_child_samples", "bagging_freq"):
        settings[name] = int(settings[name])
    prepared = prepare.fit(train)
    values = materialize(prepared.transform(train).select(vector_to_array("features").alias("v"), F.col(label).cast("double").alias("y")), "leafwise-values")
    rows, mean = values.agg(F.count("y"), F.avg("y")).first()
    if not rows:
        return LeafwiseModel(prepared, [], [], 0.0, objective)
    width = len(values.first()["v"])
    edges = _edges(values, width)
    share = min(max(mean, 1e-9), 1 - 1e-9)
    start = math.log(share / (1 - share)) if objective == "binary" else float(mean)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = to_bins(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), edges)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * width), pa.array(bins.reshape(-1)))
            yield pa.RecordBatch.from_arrays([lists, batch.column("y"), pa.array(np.full(len(bins), start)), batch.column("draw")],
                                             names=["bins", "y", "score", "draw"])

    drawn = values.filter("y is not null").withColumn("draw", F.pmod(F.xxhash64("v", "y"), F.lit(SCALE)))
    table = materialize(drawn.mapInArrow(binned, "bins array<smallint>, y double, score double, draw bigint"), "leafwise-bins")
    grower = _Grower(table, width, objective, settings, seed)
    return LeafwiseModel(prepared, edges, [grower.grow(i) for i in range(settings["n_estimators"])], start, objective)
