"""SimHash near-duplicate detection with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.llm.common import packed, tidy
from tripwise.llm.graph import components
from tripwise.operators.staging import as_lookup, lookup_join, materialize

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
CHUNK = 1 << 15


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the lower-cased word shingles; null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    last = max(1, len(words) - shingle + 1)
    spans = zip(starts[:last].tolist(), (ends[min(shingle, len(words)) - 1:] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, last)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, CHUNK):
        part = hashes[at:at + CHUNK].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > last, bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprint_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), BITS // 4, "0")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks, as signed 64-bit numbers, such that any two values that differ in at most `radius` bits are
    equal under at least one mask.

    Every bit position gets a non-zero vector of radius + 1 binary digits; mask v keeps the positions whose vector has an
    odd overlap with v. The vectors of `radius` positions cannot span all radius + 1 dimensions, so some v has an even
    overlap with each of them and its mask hides all of them. Vectors are dealt round-robin, so each keeps about half.
    """
    vectors = (1 << (radius + 1)) - 1
    of = [1 + i % vectors for i in range(bits)]
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(bits) if (of[i] & v).bit_count() % 2)
        masks.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return masks


def _differing(a: np.ndarray, b) -> np.ndarray:
    """How many bits differ; the counts are taken unsigned, as those of negative numbers are of their absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning_edges(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what links within `radius` connect, at most one for each value.

    Values are reached from one another breadth first; each is compared only with those not reached yet, so a group of
    mutual near-copies, however large, is done after a few steps.
    """
    edges, left = [], values
    while left.size > 1:
        first, left = int(left[0]), left[1:]
        queue = [first]
        while queue and left.size:
            near = _differing(left, np.int64(queue.pop())) <= radius
            if near.any():
                hit = left[near].tolist()
                left = left[~near]
                edges.extend((first, h) for h in hit)
                queue.extend(hit)
    return edges


def _bucket_edges(radius: int):
    def edges_of(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [keys.size]))
        sizes = ends - starts
        two = starts[sizes == 2]
        a, b = values[two], values[two + 1]
        near = _differing(a, b) <= radius
        out = list(zip(a[near].tolist(), b[near].tolist()))
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            out.extend(spanning_edges(values[s:e], radius))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            values = np.concatenate((values, batch.column(1).to_numpy(zero_copy_only=False)))
            # the last bucket may go on in the next batch
            whole = int(np.searchsorted(keys, keys[-1])) if keys.size else 0
            if whole:
                yield _edge_batch(edges_of(keys[:whole], values[:whole]))
            keys, values = keys[whole:], values[whole:]
        if keys.size:
            yield _edge_batch(edges_of(keys, values))

    return run


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def near_links(values: DataFrame, column: str, radius: int = RADIUS) -> DataFrame:
    """`a`, `b`: a spanning set of the links between distinct values that differ in at most `radius` bits; a link may be
    there more than once.

    Each distinct value goes into one bucket for each mask. Buckets are dealt out by their key and read in sorted order,
    one bucket at a time.
    """
    distinct = values.select(F.col(column).alias("value")).filter("value is not null").distinct()
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("value").bitwiseAND(F.lit(m).cast("bigint")))
                     for i, m in enumerate(covering_masks(radius))])
    buckets = distinct.select(F.explode(keys).alias("key"), "value")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = buckets.repartition(parts, "key").sortWithinPartitions("key", "value")
    return dealt.mapInArrow(_bucket_edges(radius), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each document: `doc_id`, `fingerprint` (16 hex digits), `component_id` (smallest id reachable).

    Documents are linked when their fingerprints differ in at most `radius` bits. Equal fingerprints are one node of the
    graph, so copies, however many, cost one row. Null and empty texts have fingerprint zero and are linked like any
    other. A null id counts for no component id; a component of null ids alone has a null component id. Repeated rows
    stay. An empty table gives no rows; further columns are ignored.
    """
    marked = materialize(documents.select(F.col(id_col).alias("doc_id"), simhash_udf(F.col(text_col)).alias("value")), "simhash")
    return _with_components(marked, radius).select("doc_id", fingerprint_hex(F.col("value")).alias("fingerprint"), "component_id")


def _with_components(marked: DataFrame, radius: int) -> DataFrame:
    """Add `root` and `component_id` to rows of `doc_id` and `value`.

    Only values that are linked to another one meet by their root, in a join with a measured table, so that a group with
    a large part of all values is dealt out.
    """
    nodes = marked.groupBy("value").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(marked, "value", radius), "a", "b")
    linked = materialize(nodes.join(roots, nodes["value"] == roots["node"]).select("value", "least", "root"), "simhash-linked")
    tidy(marked.sparkSession)
    lowest = as_lookup(linked.groupBy("root").agg(F.min("least").alias("component_id")), stage="simhash-roots")
    of_linked = lookup_join(linked, lowest, "root", "inner").select("value", "root", "component_id", F.lit(True).alias("linked"))
    of_value = nodes.join(of_linked, "value", "left").select(
        "value", F.coalesce("root", "value").alias("root"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return marked.join(materialize(of_value, "simhash-components"), "value")


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id, with all its columns.

    Of rows that repeat the kept id one stays, chosen by a hash of the row. A row without an id is kept only if its whole
    group has no id, and then one of them. The choice is made on narrow rows; texts are shuffled once.
    """
    row = packed(documents)
    rows = documents.select(row, F.col(id_col).alias("doc_id"), F.xxhash64(row).alias("row_hash"))
    marked = materialize(rows.select("doc_id", "row_hash", simhash_udf(F.col(f"_row.`{text_col}`")).alias("value")), "simhash")
    placed = _with_components(marked, radius).filter("doc_id <=> component_id")
    # null ids of several groups have no component id in common, so those are told apart by their lowest value
    group = F.when(F.col("component_id").isNull(), F.col("root"))
    kept = placed.groupBy("component_id", group.alias("root")).agg(F.min("row_hash").alias("row_hash"))
    at = F.coalesce("doc_id", F.lit(-1)).alias("at")
    kept = kept.select(F.coalesce("component_id", F.lit(-1)).alias("at"), "row_hash")
    return rows.select(at, "row_hash", "_row").join(kept, ["at", "row_hash"], "left_semi").dropDuplicates(["at", "row_hash"]).select("_row.*")
