"""Small helpers that several corpus operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage. Spark removes the shuffle files and broadcasts of a finished plan only then, and a
    driver that runs many short jobs may not come to it for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def whole(text: Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(text, F.lit(""))


def seeded_key(seed: str, *columns: Column) -> Column:
    """A repeatable 60-bit number for a row: equal rows get equal keys on every cluster and in every run."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no fit may see the labels of."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0, F.lit(False))


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of the input in one struct, so that working columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def drawn(rows: DataFrame, key: str, most: int) -> list:
    """At most `most` rows with the lowest seeded keys, on the driver: a uniform, repeatable draw.

    Rows that cannot be among them are filtered out first, so that tasks send little more than what is kept.
    """
    total = rows.count()
    if total > 2 * most:
        rows = rows.filter(F.col(key) < int((1 << KEY_BITS) * min(1.0, (most + 8 * most ** 0.5) / total)))
    return rows.orderBy(key).limit(most).collect()
