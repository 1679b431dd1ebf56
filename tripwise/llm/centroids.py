"""Centroid clustering over exact integers with an incremental distance matrix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm.vectors import Batches, Generations, finite, integers, lists, matrix, sums_by

SCALE = 256
WIDTH = 64
CLUSTERS = 40
ROUNDS = 5
SEED = "2"
CHUNK = 4096
EXACT = 1 << 52  # whole numbers up to here are exact in doubles


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each centroid that moved: its number, the components that changed, and by how much."""
    moved = new - old
    return [(k, at, moved[k, at]) for k in range(len(new)) if (at := np.flatnonzero(moved[k])).size]


def update_dots(vectors: np.ndarray, dots: np.ndarray, moved: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Bring the dot products of the vectors with the centroids up to date, from the changed components alone.

    Products are taken in doubles where every sum is a whole number below 2^52, else in long integers: exact either way.
    """
    largest = int(np.abs(vectors).max(initial=0))
    floats = vectors.astype(np.float64)
    for k, at, by in moved:
        if largest * int(np.abs(by).sum()) < EXACT:
            dots[:, k] += (floats[:, at] @ by.astype(np.float64)).astype(np.int64)
        else:
            dots[:, k] += (vectors[:, at] * by).sum(1)


def nearest(vectors: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance, from the dot products."""
    beyond = (centroids * centroids).sum(1) - 2 * dots
    cluster = beyond.argmin(1)
    return cluster, (vectors * vectors).sum(1) + beyond[np.arange(len(vectors)), cluster]


def _reassigned(moved: list, centroids: np.ndarray, first: bool):
    def run(batches: Batches) -> Batches:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                vectors = matrix(batch.column("vector"), centroids.shape[1]).astype(np.int64)
                dots = (np.zeros((len(vectors), len(centroids)), np.int64) if first
                        else matrix(batch.column("dots"), len(centroids)).astype(np.int64))
                update_dots(vectors, dots, moved)
                cluster, distance = nearest(vectors, dots, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), lists(vectors), lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "vector", "dots", "cluster", "distance"])

    return run


def _moved_centroids(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays."""
    after = centroids.copy()
    for row in sums_by(assigned, ["cluster"], "vector", centroids.shape[1]):
        after[row["cluster"]] = [t // row["n"] for t in row["total"]]
    return after


def _starting(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    return np.array([r["vector"] for r in rows], np.int64)


def component_digest(values) -> str:
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


RESULT = "vec_id {}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """Lloyd's clustering of integer vectors; one row for each kept vector.

    `vec_id`, `cluster`, `distance` (squared), `cluster_inertia` and `inertia` (distances summed over the cluster and over
    all), `centroid_sha256` (of the cluster's final centroid, decimal components joined by commas).

    Vectors of exactly `width` components, none null, NaN or infinite, become floor(scale * x); all others are dropped.
    The starting centroids are the vectors with the lowest sha-256 of `seed:id`. Each vector's dot products with all
    centroids are kept in a written table next to it. After each of `rounds` updates they are corrected by the centroid
    components that changed, and the nearest centroid is found from them; nothing is computed anew from whole
    centroids. Only centroids, counts and sums pass through the driver: clusters times width numbers, however large the
    table. Sums are taken in each task first, so a cluster with most vectors is no task of its own.

    Ties go to the lower number; empty clusters keep their centroid. Repeated rows are vectors of their own, and count
    as often among the starting ones, by components where their ids tie; null ids come last. With fewer vectors than
    clusters there are as many clusters as vectors; an empty table gives no rows. Further columns are ignored. A
    component whose integer is beyond 2^26 is an error, as squared distances must fit a long.
    """
    spark: SparkSession = embeddings.sparkSession
    schema = RESULT.format(embeddings.schema[id_col].dataType.simpleString())
    kept = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    kept = kept.filter(finite(F.col("vector")) & (F.size("vector") == width)).select("vec_id", integers(F.col("vector"), scale).alias("vector"))
    centroids = _starting(kept, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    state = f"{schema.split(',')[0]}, vector array<bigint>, dots array<bigint>, cluster int, distance bigint"
    table = Generations(spark, "dot-products")
    assigned = table.replace(kept.mapInArrow(_reassigned(changes(np.zeros_like(centroids), centroids), centroids, True), state))
    for _ in range(rounds):
        after = _moved_centroids(assigned, centroids)
        moved = changes(centroids, after)
        if not moved:
            break  # nothing would change any more
        centroids = after
        assigned = table.replace(assigned.mapInArrow(_reassigned(moved, centroids, False), state))
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    of_cluster = spark.createDataFrame(
        [(k, inertia[k], sum(inertia.values()), component_digest(centroids[k])) for k in sorted(inertia)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.select("vec_id", "cluster", "distance").join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
