"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tripwise.llm.common import tidy
from tripwise.operators.staging import fresh_path, materialize

STRETCH = 200_000  # edges that are joined up at once


def _forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node that is not the lowest of its component, with that lowest node."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        at = x
        while at in above:
            at = above[at]
        while x in above:
            above[x], x = at, above[x]
        return at

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(above)}


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a task's edges as stars around their lowest nodes: as many edges as nodes hang on others."""
    def star(waiting: list) -> pa.RecordBatch:
        hung = _forest(waiting)
        return pa.RecordBatch.from_arrays([pa.array(list(hung), pa.int64()), pa.array(list(hung.values()), pa.int64())], names=["u", "v"])

    waiting: list[tuple[int, int]] = []
    for batch in batches:
        waiting.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if len(waiting) >= STRETCH:
            yield star(waiting)
            waiting = []
    if waiting:
        yield star(waiting)


def _lowest(edges: DataFrame) -> DataFrame:
    """Each `u` next to its lowest neighbour; counted before the join, so a node of great degree is no task of its own."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every `u` and all its neighbours hang on the lowest of them; edges lead from a node to a lower one."""
    joined = edges.join(_lowest(edges), "u")
    hung = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return joined.select(F.inline(hung)).filter("u != v").distinct()


def _written(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and a digest of them all, taken while they are written."""
    path, seen = fresh_path(edges.sparkSession, label), Observation()
    digest = F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0).cast("bigint"))
    edges.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")).write.parquet(path)
    counted = seen.get["n"], seen.get["digest"]
    tidy(edges.sparkSession)
    return edges.sparkSession.read.schema("u bigint, v bigint").parquet(path), counted


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `root` (lowest node of its component) for every node that has an edge to another node.

    Each task first joins up its own edges, so that what many tasks found of one group is a star each. Then large-star
    and small-star steps alternate: every step hangs neighbours on the lowest one, which shortens long chains by a power
    each time. Each step is written to the shared folder, so that no plan holds more than one join; a round is counted on
    the way, and the rounds end when one changes nothing. Null ends, loops and repeated edges are ignored; a table without
    edges gives no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v and u is not null and v is not null")
    edges, state = _written(pairs.mapInArrow(_joined_up, "u bigint, v bigint").distinct(), "edges")
    before = None
    while state != before and state[0]:
        before = state
        edges, state = _written(_small_star(materialize(_large_star(edges), "large-stars")), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
