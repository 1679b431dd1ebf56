"""Written intermediate tables and joins to lookup tables whose size is measured first."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="tripwise-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a machine-local folder only in local mode, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_scratch()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative fits cut their lineage with reliable checkpoints; give them the shared folder if none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(spark))


@dataclass(frozen=True)
class Lookup:
    """A lookup table together with the result of the size check."""

    frame: DataFrame
    small: bool

    def derive(self, change) -> "Lookup":
        """Filter or project the table; a subset of a small table is small."""
        return Lookup(change(self.frame), self.small)


def as_lookup(df: DataFrame, stage: str | None = None, max_rows: int = MAX_BROADCAST_ROWS,
              max_bytes: int = MAX_BROADCAST_BYTES) -> Lookup:
    """Measure rows and bytes (one row comes back to the driver). `stage` writes a derived table first,
    so that measuring and joining do not compute it twice."""
    table = materialize(df, stage) if stage else df
    width = F.lit(0)
    for field in table.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)  # nested values weigh about what they take as text
        measured = isinstance(field.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        width = width + (F.coalesce(F.octet_length(value), F.lit(0)) if measured else F.lit(0)) + F.lit(16)
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return Lookup(table, rows <= max_rows and size <= max_bytes)


def lookup_join(left: DataFrame, lookup: Lookup, on, how: str = "left") -> DataFrame:
    """Left, inner, semi or anti join to a lookup: map-side when it is small, with hot keys spread otherwise."""
    keys = [on] if isinstance(on, str) else list(on)
    if lookup.small:
        return left.join(F.broadcast(lookup.frame), keys, how)
    return salted_join(left, lookup.frame, keys, how)


def salted_join(left: DataFrame, right: DataFrame, on, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Shuffle join in which no key of the left side meets in one task with more than about `hot_rows` rows.

    Each left row meets each right row of its key exactly once.
    """
    keys = [on] if isinstance(on, str) else list(on)
    spread, repeated = spread_hot_keys(left, right, keys, hot_rows)
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def spread_hot_keys(left: DataFrame, right: DataFrame, keys, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Add `_salt` to both sides: 0 for ordinary keys; a hot key of the left side gets as many salts as it
    needs, its left rows are dealt out and its right rows are repeated once per salt.

    Hot keys are counted first (a map-side combined aggregate). There are at most rows / hot_rows of them,
    and their table is measured before it is broadcast. The salt depends on the row and on the partition it
    is read from, so copies in different partitions are dealt out too and a repeated task makes the same choice; copies
    in one partition share a salt.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    salts = F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")
    hot = as_lookup(counts.select(*keys, salts), stage="hot-keys")
    table = F.broadcast(hot.frame) if hot.small else hot.frame
    # Rows without a key match nothing; they only have to be dealt out, over as many salts as their number needs.
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    without = hot.frame.filter(no_key).agg(F.coalesce(F.sum("_salts"), F.lit(1))).scalar()
    width = F.when(no_key, without).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    plain = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    place = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), width.cast("bigint")).cast("int")
    dealt = left.join(table, keys, "left").withColumn("_salt", place).drop("_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    repeated = right.join(table, keys, "left").withColumn("_salt", each).drop("_salts")
    return dealt.select(*left.columns, "_salt"), repeated.select(*right.columns, "_salt")
