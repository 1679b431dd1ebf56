"""Exact quantiles and ranks that never bring a whole column into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def _sliced(counts: DataFrame, value: str, slices: int = SLICES) -> DataFrame:
    """Tag distinct values with a slice number, so that slices are ordered and of similar size.

    The cut points come from a mergeable sketch, so their quality affects balance only, never results.
    """
    cuts = counts.agg(
        F.approx_percentile(F.col(value).cast("double"), [i / slices for i in range(1, slices)], 10 * slices).alias("c")
    ).scalar()
    below = F.size(F.filter(F.col("_cuts"), lambda cut: cut < F.col(value)))
    return counts.withColumn("_cuts", cuts).withColumn("_slice", below).drop("_cuts")


def with_running_count(counts: DataFrame, value: str, weight: str, slices: int = SLICES, tie=(),
                       descending: bool = False) -> DataFrame:
    """Add `_before`, the weight of all rows that come earlier in the order of (value, tie), and `_all`.

    Rows are summed inside slices; the slice totals (at most `slices` rows) are added up and broadcast.
    """
    tagged = _sliced(counts, value, slices)
    if descending:
        tagged = tagged.withColumn("_slice", -F.col("_slice"))
    totals = tagged.groupBy("_slice").agg(F.sum(weight).alias("_slice_total"))
    across = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice",
        F.coalesce(F.sum("_slice_total").over(across), F.lit(0)).alias("_offset"),
        F.sum("_slice_total").over(Window.partitionBy()).alias("_all"),
    )
    order = [F.desc(value) if descending else F.asc(value), *[F.col(t) for t in tie]]
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = tagged.join(F.broadcast(offsets), "_slice")
    running = F.sum(weight).over(inside)
    return placed.withColumn("_before", F.col("_offset") + running - F.col(weight)).drop("_slice", "_offset")


def exact_percentiles(df: DataFrame, column: str, probabilities, slices: int = SLICES) -> DataFrame:
    """One row with an array `quantiles`, linearly interpolated between order statistics.

    Rows are first reduced to (value, count), so repeated values cost nothing after the partial aggregate.
    """
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = with_running_count(counts, "_v", "_n", slices)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v")))

    picks = []
    for p in probabilities:
        position = F.lit(float(p)) * (F.col("_all") - 1)
        picks += [at(F.floor(position)), at(F.ceil(position)), F.max(position - F.floor(position))]
    row = ranked.agg(*[c.alias(f"_q{i}") for i, c in enumerate(picks)])
    values = [
        F.col(f"_q{3 * i}") + F.col(f"_q{3 * i + 2}") * (F.col(f"_q{3 * i + 1}") - F.col(f"_q{3 * i}"))
        for i in range(len(list(probabilities)))
    ]
    return row.select(F.array(*values).alias("quantiles"))


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max as (statistic, value) rows."""
    x = F.col(column).cast("double")
    basic = df.agg(
        F.count(x).cast("double").alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ).unpivot([], ["count", "mean", "std", "min", "max"], "statistic", "value")
    quartiles = exact_percentiles(df, column, (0.25, 0.5, 0.75))
    middle = quartiles.select(
        *[F.element_at("quantiles", i).alias(name) for i, name in enumerate(("25%", "50%", "75%"), 1)]
    ).unpivot([], ["25%", "50%", "75%"], "statistic", "value")
    return basic.unionByName(middle)


def usage_quartile(df: DataFrame, column: str = "total_trips", name: str = "usage_quartile") -> DataFrame:
    """Quartile label 0..3, intervals closed on the right. Fails when two edges coincide."""
    edges = exact_percentiles(df, column, (0.0, 0.25, 0.5, 0.75, 1.0)).scalar()
    tagged = df.withColumn("_e", edges)
    e = [F.col("_e")[i] for i in range(5)]
    distinct_edges = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3]) & (e[3] < e[4])
    x = F.col(column)
    label = (
        F.when(~distinct_edges, F.raise_error(F.lit("quartile edges are not unique")).cast("int"))
        .when(x <= e[1], 0)
        .when(x <= e[2], 1)
        .when(x <= e[3], 2)
        .when(x.isNotNull(), 3)
    )
    return tagged.withColumn(name, label).drop("_e")


def rank_rows(df: DataFrame, value: str, tie: str, name: str = "rank", slices: int = SLICES) -> DataFrame:
    """1-based position by falling value, ties by rising key, without one global window."""
    ranked = with_running_count(df.withColumn("_one", F.lit(1)), value, "_one", slices, tie=(tie,), descending=True)
    return ranked.withColumn(name, (F.col("_before") + 1).cast("bigint")).drop("_before", "_all", "_one")
