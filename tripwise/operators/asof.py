"""As-of join: the latest right row at or before each left row, not older than a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwise.operators.staging import HOT_ROWS, spread_hot_keys


def asof_join_backward(left: DataFrame, right: DataFrame, on: str = "time", tolerance_seconds: float = 60.0,
                       by=(), hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Backward as-of left join, exact matches allowed, without emitting candidate pairs.

    Time is cut into buckets as long as the tolerance. Every right row is entered in its own bucket and the
    next one; then one window per bucket carries the last right row forward, so each side is shuffled once.
    The right side is first reduced to one row per moment. Buckets with more than `hot_rows` left rows are
    dealt out over several windows, each with the right rows of the bucket; None skips that check, for left
    sides with few rows per bucket, such as an hourly table.
    """
    by = list(by)
    micros = F.lit(int(tolerance_seconds * 1_000_000))
    payload = [c for c in right.columns if c not in by and c != on]
    rest = [c for c in left.columns if c not in by and c != on]
    at = F.unix_micros(F.col(on))
    bucket = F.floor(F.col("_at") / micros)

    # Equal moments on the right: the greatest payload, so that the result is repeatable.
    facts = right.groupBy(*by, on).agg(F.max(F.struct(*payload)).alias("_fact")).filter(F.col(on).isNotNull())
    entered = facts.select(*by, at.alias("_at"), "_fact").withColumn(
        "_bucket", F.explode(F.array(bucket, bucket + 1))
    )
    asked = left.withColumn("_at", at).withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    if hot_rows is not None:
        asked, entered = spread_hot_keys(asked, entered, keys, hot_rows)
        keys.append("_salt")

    rows = asked.select(*keys, "_at", F.lit(1).alias("_side"), F.struct(on, *rest).alias("_left"))
    marks = entered.select(
        *keys, "_at", F.lit(0).alias("_side"), F.struct(F.col("_at").alias("at"), F.col("_fact").alias("fact")).alias("_right")
    )
    # Right rows come first at equal times, so an exact match is seen.
    seen = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        marks.unionByName(rows, allowMissingColumns=True)
        .withColumn("_seen", F.last("_right", ignorenulls=True).over(seen))
        .filter(F.col("_side") == 1)
        .withColumn("_seen", F.when(F.col("_at") - F.col("_seen.at") <= micros, F.col("_seen.fact")))
    )
    return matched.select(
        *by, *[F.col(f"_left.{c}").alias(c) for c in (on, *rest)], *[F.col(f"_seen.{c}").alias(c) for c in payload]
    ).select(*left.columns, *payload)
