"""Distributions: histograms, shares, correlations, point densities."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bounds(df: DataFrame, column: str) -> Column:
    return df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("b")).scalar()


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 1..bins; the last bin is closed on the right. A single distinct value fills bin 1."""
    return F.when(lo == hi, F.lit(1)).otherwise(F.least(F.width_bucket(x, lo, hi, F.lit(bins)), F.lit(bins))).cast("int")


def _with_empty_bins(counted: DataFrame, groups: DataFrame, keys, bins: int) -> DataFrame:
    full = groups.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return full.join(counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") - 1) / bins).alias("bin_start"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Counts in bins of equal width between minimum and maximum, empty bins included."""
    x = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    bounds = _bounds(x, "x")
    counted = (
        x.withColumn("b", bounds)
        .groupBy(equal_width_bin(F.col("x"), F.col("b.lo"), F.col("b.hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The same scalar subquery again, so Spark runs it once.
    edges = df.sparkSession.range(1).select(bounds.alias("b")).select("b.*")
    return _with_empty_bins(counted, edges, [], bins)


def histogram_by_cutoff(df: DataFrame, column: str = "duration", time: str = "departure", cutoff_year: int = 2024,
                        below: float = 60.0, bins: int = 50) -> DataFrame:
    """Two histograms, before and from a year on, each over its own range, of values below a limit."""
    x = df.select(
        F.col(column).cast("double").alias("x"), (F.year(time) >= cutoff_year).alias("from_cutoff")
    ).filter((F.col("x") < below) & F.col("from_cutoff").isNotNull())
    edges = x.groupBy("from_cutoff").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # Two rows at most, one per side of the cutoff.
    counted = (
        x.join(F.broadcast(edges), "from_cutoff")
        .groupBy("from_cutoff", equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _with_empty_bins(counted, edges, ["from_cutoff"], bins)


def share_over_threshold(df: DataFrame, column: str, threshold: float, time: str | None = None,
                         cutoff_year: int = 2024) -> DataFrame:
    """Share of rows above a threshold, rounded to 3; with `time`, before and from the cutoff year."""
    share = F.round(F.avg((F.coalesce(F.col(column) > threshold, F.lit(False))).cast("double")), 3).alias("share")
    if time is None:
        return df.agg(share)
    return df.groupBy((F.year(time) >= cutoff_year).alias("from_cutoff")).agg(share)


def count_over_thresholds(df: DataFrame, column: str = "speed", thresholds=(20, 30, 40)) -> DataFrame:
    over = [F.count_if(F.col(column) > t).alias(f"over_{t}") for t in thresholds]
    return df.agg(F.count(F.lit(1)).alias("rides"), *over)


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Pearson coefficients of all column pairs as rows (a, b, r); a pair uses the rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    once = x.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = [
        F.struct(
            F.initcap(F.lit(a)).alias("a"),
            F.initcap(F.lit(b)).alias("b"),
            F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`").alias("r"),
        )
        for a, b in product(columns, columns)
    ]
    return once.select(F.inline(F.array(*rows)))


def pair_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))


def scatter_density(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Points of a scatter plot counted per cell of a regular grid; only cells that hold points."""
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop("any")
    b = points.agg(
        F.struct(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        ).alias("b")
    ).scalar()
    placed = points.withColumn("b", b)
    return placed.groupBy(
        equal_width_bin(F.col("x"), F.col("b.x0"), F.col("b.x1"), bins).alias("x_bin"),
        equal_width_bin(F.col("y"), F.col("b.y0"), F.col("b.y1"), bins).alias("y_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))


def hexbin_counts(df: DataFrame, x: str, y: str, gridsize: int = 50) -> DataFrame:
    """Hexagonal binning: each point goes to the nearer centre of two lattices shifted by half a cell.

    The lattice is `gridsize` cells wide and gridsize / sqrt(3) cells high over the range of the data.
    """
    wide, high = gridsize, int(gridsize / 3**0.5)
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop("any")
    b = points.agg(
        F.struct(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        ).alias("b")
    ).scalar()

    def scale(lo: Column, hi: Column, cells: int) -> Column:
        return F.when(hi > lo, (hi - lo) / cells).otherwise(F.lit(1.0))

    unit = points.withColumn("b", b).select(
        ((F.col("x") - F.col("b.x0")) / scale(F.col("b.x0"), F.col("b.x1"), wide)).alias("u"),
        ((F.col("y") - F.col("b.y0")) / scale(F.col("b.y0"), F.col("b.y1"), high)).alias("v"),
    )
    i0, j0 = F.rint("u"), F.rint("v")
    i1, j1 = F.floor("u") + 0.5, F.floor("v") + 0.5

    def distance(i: Column, j: Column) -> Column:
        return (F.col("u") - i) * (F.col("u") - i) + 3 * (F.col("v") - j) * (F.col("v") - j)

    on_first = distance(i0, j0) < distance(i1, j1)
    centre = unit.select(F.when(on_first, i0).otherwise(i1).alias("i"), F.when(on_first, j0).otherwise(j1).alias("j"))
    return (
        centre.groupBy("i", "j")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("log10_n", F.log10(F.col("n").cast("double")))
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_rows(df: DataFrame, columns) -> DataFrame:
    return df.select(*columns).distinct()
