"""Sharding by proportional stratified interleaving, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.llm.common import KEY_BITS, packed, seeded_key, whole
from tripwise.operators.staging import as_lookup, lookup_join, materialize

SEED = "shard-1"
ROWS_PER_BUCKET = 5_000
ROWS_PER_RANGE = 500_000  # the table of ranges has a row for each so many rows
ROW_BITS = 33  # of Spark's increasing ids, below the number of the partition
OVERHEAD = 16


def payload_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none) plus a fixed overhead for each row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def _numbered(rows: DataFrame, keys: list[str], order: list[Column], number: str) -> DataFrame:
    """Row numbers from 1 inside each group of `keys`."""
    return rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def interleaved(rows: DataFrame, stratum: str, key: str, ties: list[str]) -> tuple[DataFrame, int]:
    """Add `_place`, the position from 0 in the interleaved order; also returns the number of rows.

    Within a stratum rows are ranked by their seeded key. Row r of n has the fractional rank (r - 1/2) / n, and all rows
    are ordered by it (ties by stratum, null last, then key and `ties`), so that every stretch of the order holds the
    strata in their proportions.

    Both rankings are made in two steps. In a stratum, rows are counted by slices of the key, running counts over the
    slices give each slice its offset, and rows are numbered inside a slice; a stratum with a third of all rows is as
    many slices as its rows need. The whole order is cut into ranges of it, ties and all, so strata of one row, which all
    have the rank 1/2, spread over ranges like any others; rows are numbered in the sorted ranges, which are written, and
    a range starts where those before it end.
    """
    total = rows.count()
    slices = max(1, -(-total // ROWS_PER_BUCKET))
    within = [F.col(key), *[F.col(c) for c in ties]]

    name = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))  # a null stratum has a name of its own
    sliced = rows.withColumns({"_of": name, "_at": (F.col(key) / F.lit(float(1 << KEY_BITS)) * slices).cast("bigint")})
    counts = sliced.groupBy("_of", "_at").agg(F.count(F.lit(1)).alias("_n"))
    to_here = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_of", "_at", F.coalesce(F.sum("_n").over(to_here), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_of")).alias("_all"))
    # measured first, so that the rows and their texts are never shuffled for this join while its other side is counted
    offsets = as_lookup(offsets, stage="slice-offsets")
    ranked = lookup_join(_numbered(sliced, ["_of", "_at"], within, "_rank"), offsets, ["_of", "_at"], "inner")
    fraction = (2 * (F.col("_before") + F.col("_rank")) - 1) / (2 * F.col("_all"))
    ranked = materialize(ranked.withColumn("_fraction", fraction).drop("_rank", "_of", "_at", "_before", "_all"), "ranks")

    order = [F.col("_fraction"), F.col(stratum).asc_nulls_last(), *within]
    parts = max(1, -(-total // ROWS_PER_RANGE), min(slices, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = ranked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("_at"), F.monotonically_increasing_id().alias("_nth")), "places")
    to_here = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = placed.groupBy(F.col("_at").alias("_of")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_of", F.coalesce(F.sum("_n").over(to_here), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), F.col("_at") == F.col("_of"))
    in_range = F.col("_nth").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return joined.withColumn("_place", F.col("_before") + in_range).drop("_at", "_nth", "_of", "_before", "_fraction"), total


def cut(place: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a position: contiguous runs, whose lengths differ by one at most."""
    shard = F.floor(place * shards / F.lit(max(total, 1))).cast("bigint")
    # exact in integers: the quotient above may be off by one where it rounds
    shard = F.when(shard * total > place * shards, shard - 1).when((shard + 1) * total <= place * shards, shard + 1).otherwise(shard)
    start = F.floor((shard * total + shards - 1) / F.lit(shards)).cast("bigint")
    return shard.cast("int"), (place - start).cast("bigint")


def assign_shards(documents: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", seed: str = SEED) -> DataFrame:
    """All columns of the documents and `shard` (int, from 0) and `slot` (bigint, gapless from 0 in each shard).

    Row counts of shards differ by one at most, and every shard holds the sources in the proportions of the whole.
    The order is fixed by seed, id and text: reruns agree, and only rows that are equal in both can swap places.
    Null sources are a stratum of their own; null ids and texts are values like any other; repeated rows all get a slot;
    with fewer rows than shards some shards stay empty; an empty table gives no rows. Columns named shard or slot in
    the input are replaced.
    """
    rest = documents.drop("shard", "slot")
    rows = rest.select(
        packed(rest), F.col(source_col).alias("_stratum"), F.col(id_col).alias("_id"), F.crc32(whole(F.col(text_col))).alias("_crc"),
        seeded_key(seed, F.col(id_col), F.md5(whole(F.col(text_col)))).alias("_key"))
    placed, total = interleaved(rows, "_stratum", "_key", ["_id", "_crc"])
    shard, slot = cut(F.col("_place"), total, shards)
    return placed.select("_row.*", shard.alias("shard"), slot.alias("slot"))


def shard_table(documents: DataFrame, shards: int) -> DataFrame:
    """The assignment without the texts: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`; a grown shard is defined for laws by key only and is null here.
    """
    text = F.col("text")
    narrow = materialize(documents.select(
        "doc_id", "source", F.crc32(whole(text)).alias("text_crc32"), payload_size(text).alias("size"),
        seeded_key(SEED, F.col("doc_id"), F.md5(whole(text))).alias("key")), "shard-rows")
    placed, total = interleaved(narrow, "source", "key", ["doc_id", "text_crc32"])
    shard, slot = cut(F.col("_place"), total, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                         slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
