"""Vector code compression: codebooks by dual-tree Lloyd over exact integers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm.centroids import component_digest
from tripwise.llm.vectors import Batches, finite, integers, matrix, sums_by
from tripwise.operators.staging import as_lookup, lookup_join, materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 4096
LEAF = 16


@dataclass
class Trees:
    """One balanced tree for each part position over the same number of points, all of one shape.

    `points` [parts, n, dim] are in tree order, `order` [parts, n] says where each came from. Level l has 2^l nodes; node i
    covers the points from n*i >> l up to n*(i+1) >> l. The node arrays are flat, part after part and level after level.
    """

    points: np.ndarray
    order: np.ndarray
    depth: int
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]

    @staticmethod
    def cuts(n: int, level: int) -> np.ndarray:
        return (n * np.arange((1 << level) + 1)) >> level

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> "Trees":
        """Each node is halved at the median of its widest component until leaves hold at most `leaf` points."""
        parts, n, _ = points.shape
        depth = 0
        while n >> depth > leaf and n >> (depth + 1) > 0:
            depth += 1
        order = np.tile(np.arange(n), (parts, 1))
        for level in range(depth):
            starts = cls.cuts(n, level)
            sizes = np.diff(starts)
            node = np.repeat(np.arange(1 << level), sizes)
            for p in range(parts):
                here = points[p, order[p]]
                widest = (np.maximum.reduceat(here, starts[:-1]) - np.minimum.reduceat(here, starts[:-1])).argmax(1)
                along = here[np.arange(n), widest[node]]
                order[p] = order[p][np.lexsort((along, node))]
        sorted_points = np.take_along_axis(points, order[:, :, None], 1)
        return cls.over(sorted_points, order, depth)

    @classmethod
    def over(cls, points: np.ndarray, order: np.ndarray, depth: int) -> "Trees":
        """The node boxes and sums of points that are in tree order."""
        low, high, total = [], [], []
        for level in range(depth + 1):
            starts = cls.cuts(points.shape[1], level)[:-1]
            low.append(np.minimum.reduceat(points, starts, axis=1))
            high.append(np.maximum.reduceat(points, starts, axis=1))
            total.append(np.add.reduceat(points, starts, axis=1))
        return cls(points, order, depth, low, high, total)


def _least_lead(low, high, entry, other_low, other_high) -> np.ndarray:
    """Row by row, how much farther than `entry` the points of the other box are from the points of the first box, at
    least (in squared distance). Negative if some point of the other box may be nearer.

    Along one component, the squared distance to `entry` less that to the nearest value of the other box is a convex
    function of the point, so its greatest value lies at an end of the first box.
    """
    def ahead(x):
        apart = np.maximum(np.maximum(other_low - x, x - other_high), 0)
        return (x - entry) ** 2 - apart * apart

    return -np.maximum(ahead(low), ahead(high)).sum(-1)


def _segments(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


@dataclass
class Assignment:
    """What a traversal decides: whole nodes with their entry, and single points of uncertain leaves with theirs."""

    node_part: np.ndarray
    node_start: np.ndarray
    node_stop: np.ndarray
    node_total: np.ndarray
    node_entry: np.ndarray
    point_part: np.ndarray
    point_at: np.ndarray
    point_entry: np.ndarray
    compared: int


def assign(trees: Trees, codebook: np.ndarray) -> Assignment:
    """The nearest entry (ties: the lower index) of every point of every part; `codebook` is [parts, entries, dim].

    Pairs of a node of points and a node of entries go down both trees together. For each node of points some entry is
    nearest to the middle of its box; a pair is dropped when all its entries are farther than that one from every point of
    the box, by bounds on the two nodes' distances. A node of points left with one entry is assigned whole. The points of
    leaves with several entries left are compared with those. All bounds are integers, so nothing is rounded.
    """
    parts, n, dim = trees.points.shape
    entries = codebook.shape[1]
    tree = Trees.build(codebook, 1)  # leaves of one or two entries
    whole: list[tuple[np.ndarray, ...]] = []
    part = np.arange(parts)
    node, other = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    level = entry_level = 0
    single = tree.depth + 1  # the level below the leaves of the entry tree: entries themselves, in their own order

    def boxes(l, p, i):
        if l == single:
            return codebook[p, i], codebook[p, i]
        return tree.low[l][p, i], tree.high[l][p, i]

    def narrowed(part, node, other, level, entry_level):
        starts = _segments((part << level) + node)
        p, low, high = part[starts], trees.low[level][part[starts], node[starts]], trees.high[level][part[starts], node[starts]]
        middle = (((low + high)[:, None] - 2 * codebook[p]) ** 2).sum(2).argmin(1)
        of = np.repeat(np.arange(starts.size), np.diff(np.append(starts, part.size)))
        lead = _least_lead(low[of], high[of], codebook[p, middle][of], *boxes(entry_level, part, other))
        return part[lead <= 0], node[lead <= 0], other[lead <= 0]

    while True:
        if entry_level < single:
            entry_level += 1
            if entry_level == single:
                cuts = Trees.cuts(entries, tree.depth)
                sizes = np.diff(cuts)[other]
                first = np.cumsum(sizes) - sizes
                at = np.repeat(cuts[other] - first, sizes) + np.arange(sizes.sum())
                part, node = np.repeat(part, sizes), np.repeat(node, sizes)
                other = tree.order[part, at]
            else:
                part, node = np.repeat(part, 2), np.repeat(node, 2)
                other = np.stack((2 * other, 2 * other + 1), 1).reshape(-1)
            part, node, other = narrowed(part, node, other, level, entry_level)
        if entry_level == single:
            starts = _segments((part << level) + node)
            alone = np.diff(np.append(starts, part.size)) == 1
            done = starts[alone]
            if done.size:
                p, i = part[done], node[done]
                cuts = Trees.cuts(n, level)
                whole.append((p, cuts[i], cuts[i + 1], trees.total[level][p, i], other[done]))
                keep = np.ones(part.size, bool)
                keep[done] = False
                part, node, other = part[keep], node[keep], other[keep]
        if not part.size or (level == trees.depth and entry_level == single):
            break
        if level < trees.depth:
            # both children of a node of points keep its pairs, which stay together
            level += 1
            key = (part << (level - 1)) + node
            starts = _segments(key)
            sizes = np.diff(np.append(starts, key.size))
            begin = np.repeat(starts, 2)
            length = np.repeat(sizes, 2)
            offset = np.cumsum(length) - length
            at = np.repeat(begin - offset, length) + np.arange(length.sum())
            side = np.repeat(np.tile([0, 1], starts.size), length)
            part, node, other = part[at], 2 * node[at] + side, other[at]
            if part.size:
                part, node, other = narrowed(part, node, other, level, entry_level)

    cuts = Trees.cuts(n, level)
    point_part = point_at = point_entry = np.empty(0, np.int64)
    compared = 0
    if part.size:
        sizes = cuts[node + 1] - cuts[node]
        compared = int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        at = np.repeat(cuts[node] - first, sizes) + np.arange(compared)
        p, e = np.repeat(part, sizes), np.repeat(other, sizes)
        apart = trees.points[p, at] - codebook[p, e]
        # one number to compare: the distance, then the index
        best = np.full(parts * n, np.iinfo(np.int64).max)
        np.minimum.at(best, p * n + at, (apart * apart).sum(1) * entries + e)
        flat = np.flatnonzero(best != np.iinfo(np.int64).max)
        point_part, point_at, point_entry = flat // n, flat % n, best[flat] % entries
    joined = [np.concatenate(x) for x in zip(*whole)] if whole else [
        np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dim), np.int64), np.empty(0, np.int64)]
    return Assignment(*joined, point_part, point_at, point_entry, compared)


def entry_sums(trees: Trees, found: Assignment, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts [parts, entries] and sums [parts, entries, dim]: cached sums of whole nodes, points of uncertain leaves."""
    parts, _, dim = trees.points.shape
    counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dim), np.int64)
    np.add.at(counts, (found.node_part, found.node_entry), found.node_stop - found.node_start)
    np.add.at(totals, (found.node_part, found.node_entry), found.node_total)
    np.add.at(counts, (found.point_part, found.point_entry), 1)
    np.add.at(totals, (found.point_part, found.point_entry), trees.points[found.point_part, found.point_at])
    return counts, totals


def codes(trees: Trees, found: Assignment) -> np.ndarray:
    """The entry of each point [parts, n], in the order the points came in."""
    entry = np.empty(trees.order.shape, np.int64)
    for p, a, b, e in zip(found.node_part.tolist(), found.node_start.tolist(), found.node_stop.tolist(), found.node_entry.tolist()):
        entry[p, a:b] = e
    entry[found.point_part, found.point_at] = found.point_entry
    out = np.empty_like(entry)
    np.put_along_axis(out, trees.order, entry, 1)
    return out


def _blocks(parts: int, width: int, block: int, leaf: int):
    """Vectors to blocks with a tree for each part position; a row for each block."""

    def row(ids: pa.Array, labels: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        trees = Trees.build(vectors.reshape(len(vectors), parts, width // parts).transpose(1, 0, 2), leaf)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        binary = lambda a, kind: pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())
        boxes = [np.concatenate(levels, axis=1) for levels in (trees.low, trees.high, trees.total)]
        return pa.RecordBatch.from_arrays(
            [one(ids), one(labels), pa.array([trees.depth], pa.int32()), binary(trees.points, "<i4"), binary(trees.order, "<u2"),
             binary(boxes[0], "<i4"), binary(boxes[1], "<i4"), binary(boxes[2], "<i8")],
            names=["ids", "labels", "depth", "points", "places", "low", "high", "total"])

    def run(batches: Batches) -> Batches:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            while waiting.num_rows >= block:
                yield of(waiting.slice(0, block))
                waiting = waiting.slice(block)
        if waiting is not None and waiting.num_rows:
            yield of(waiting)

    def of(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, labels, vectors = (table.column(c).combine_chunks() for c in ("vec_id", "label", "vector"))
        return row(ids, labels, matrix(vectors, width).astype(np.int64))

    return run


def _trees(batch: pa.RecordBatch, i: int, parts: int, dim: int) -> Trees:
    def stored(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(batch.column(name)[i].as_py(), kind).astype(np.int64).reshape(parts, -1, dim)

    depth = batch.column("depth")[i].as_py()
    levels = [1 << d for d in range(depth)]
    split = lambda name, kind: np.split(stored(name, kind), np.cumsum(levels), axis=1)
    order = np.frombuffer(batch.column("places")[i].as_py(), "<u2").astype(np.int64).reshape(parts, -1)
    return Trees(stored("points", "<i4"), order, depth, split("low", "<i4"), split("high", "<i4"), split("total", "<i8"))


def _summed(codebook: np.ndarray):
    parts, entries, dim = codebook.shape

    def run(batches: Batches) -> Batches:
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dim), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                trees = _trees(batch, i, parts, dim)
                n, total = entry_sums(trees, assign(trees, codebook), entries)
                counts, totals = counts + n, totals + total
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
             pa.array(totals[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "members", "total"])

    return run


def _coded(codebook: np.ndarray):
    parts, _, dim = codebook.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                trees = _trees(batch, i, parts, dim)
                entry = codes(trees, assign(trees, codebook))
                back = np.empty_like(trees.points)
                np.put_along_axis(back, trees.order[:, :, None], trees.points, 1)
                apart = back - codebook[np.arange(parts)[:, None], entry]
                code = ["".join(c) for c in digits[entry.T]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(code, pa.string()),
                     pa.array((apart * apart).sum((0, 2)))], names=["vec_id", "label", "code", "error"])

    return run


def _width(kept: DataFrame, parts: int) -> int:
    """The length of most vectors among those that the number of parts divides (ties: the shorter); 0 if there is none."""
    lengths = kept.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).groupBy(F.size("embedding").alias("length"))
    first = lengths.count().orderBy(F.desc("count"), "length").first()
    return first["length"] if first else 0


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Product codes of integer vectors; one row for each kept vector.

    `vec_id`, `code` (index of the entry of each part, two hexadecimal digits each), `error` (squared distances to the
    entries, summed over parts), `label_error` (errors summed over equal labels, nulls together), `codebooks_sha256` (all
    final entries' decimal components by part, entry and position, joined by commas).

    Vectors that are null or hold null, NaN or infinite components are dropped; components become floor(scale * x). A
    codebook covers one length, that of most kept vectors (among lengths that `parts` divides); others have no parts
    and are dropped too. Each codebook starts as that part of the `entries` vectors with the smallest ids (ties by
    components, null ids last); with fewer vectors there are fewer entries, and an empty table gives no rows. Repeated
    rows are vectors of their own. Ties go to the lower index; unused entries stay. Further columns are ignored. A component
    whose integer is beyond 2^26 is an error, as squared distances must fit a long.

    Vectors are put into blocks of BLOCK as they are read, and each block's trees are written once with their boxes and
    sums. A round sends the codebooks to the tasks, which go down the trees of points and entries together and return
    counts and sums; parts times entries rows come back to the driver, however large the table. Nothing is shuffled but
    those sums. Labels are joined by their measured table, so one label may hold any share of the rows.
    """
    spark: SparkSession = embeddings.sparkSession
    id_type, label_type = (embeddings.schema[c].dataType.simpleString() for c in (id_col, label_col))
    result = f"vec_id {id_type}, code string, error bigint, label_error bigint, codebooks_sha256 string"
    kept = embeddings.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    kept = kept.filter(finite(F.col("embedding")))
    width = _width(kept, parts)
    if not width:
        return spark.createDataFrame([], result)
    kept = kept.filter(F.size("embedding") == width).select("vec_id", "label", integers(F.col("embedding"), scale).alias("vector"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    codebook = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    blocks = materialize(kept.mapInArrow(
        _blocks(parts, width, BLOCK, LEAF),
        f"ids array<{id_type}>, labels array<{label_type}>, depth int, points binary, places binary, low binary, high binary, total binary"), "blocks")
    for _ in range(rounds):
        after = codebook.copy()
        summed = blocks.mapInArrow(_summed(codebook), "part int, entry int, members bigint, total array<bigint>")
        for row in sums_by(summed, ["part", "entry"], "total", width // parts, F.sum("members").alias("members")):
            after[row["part"], row["entry"]] = [t // row["members"] for t in row["total"]]
        if (after == codebook).all():
            break
        codebook = after
    coded = materialize(blocks.mapInArrow(_coded(codebook), f"vec_id {id_type}, label {label_type}, code string, error bigint"), "codes")
    # a null label is a label of its own: text that no other label has
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    errors = as_lookup(coded.groupBy(key).agg(F.sum("error").alias("label_error")), stage="label-errors")
    joined = lookup_join(coded.select(key, "vec_id", "code", "error"), errors, "key", "inner")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(component_digest(codebook.reshape(-1).tolist())).alias("codebooks_sha256"))
