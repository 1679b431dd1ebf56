"""Unify station ids and names over all trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise.operators.staging import Lookup, as_lookup, lookup_join, materialize

# A departure without a time sorts after every other one.
_LAST = "9999-12-31 23:59:59"


def station_usage_counts(trips: DataFrame) -> DataFrame:
    """Trips per (id, name), departures and returns together, from one scan."""
    ends = F.array(
        F.struct(F.col("departure_id").alias("id"), F.col("departure_name").alias("name")),
        F.struct(F.col("return_id").alias("id"), F.col("return_name").alias("name")),
    )
    return (
        trips.select(F.inline(ends))
        .na.drop("any")
        .groupBy("id", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def main_id_per_name(usage: DataFrame) -> DataFrame:
    """The id used most under each name; equal use goes to the smallest id."""
    return usage.groupBy("name").agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("main_id"))


def join_usage_main_id(usage: DataFrame, main_ids: DataFrame) -> DataFrame:
    return usage.join(main_ids, "name", "inner")


def id_merge_map(usage_with_main: DataFrame) -> DataFrame:
    """One target id per id. An id seen under several names follows its greatest name."""
    return usage_with_main.groupBy("id").agg(F.max_by("main_id", "name").alias("main_id"))


def remap_ids(trips: DataFrame, id_map: Lookup, columns=("departure_id", "return_id")) -> DataFrame:
    """One-step replacement; ids outside the map stay."""
    out = trips
    for column in columns:
        step = id_map.derive(
            lambda m, c=column: m.select(F.col("id").alias(c), F.col("main_id").alias("_main"))
        )
        out = lookup_join(out, step, column).withColumn(column, F.coalesce("_main", column)).drop("_main")
    return out.select(*trips.columns)


def station_sightings(trips: DataFrame) -> DataFrame:
    """One row per (id, name, side) with the number of trips and the last moment it was seen.

    Plain counts and maxima over one scan: a hash aggregate with map-side combine. Everything about ids and
    names follows from this small table. `priority` is 1 for departures and 0 for returns.
    """
    when = F.coalesce(F.col("departure"), F.lit(_LAST).cast("timestamp"))

    def end(side: str, priority: int) -> Column:
        return F.struct(
            F.col(f"{side}_id").alias("id"), F.col(f"{side}_name").alias("name"), F.lit(priority).alias("priority"),
            when.alias("when"),
        )

    return (
        trips.select(F.inline(F.array(end("departure", 1), end("return", 0))))
        .filter(F.col("id").isNotNull() & F.col("name").isNotNull())
        .groupBy("id", "name", "priority")
        .agg(F.count(F.lit(1)).alias("n"), F.max("when").alias("when"))
    )


def _newest_name(sightings: DataFrame) -> DataFrame:
    """Names at departure beat names at return, later beats earlier, and of equal moments the greater name wins."""
    return sightings.groupBy("id").agg(F.max_by("name", F.struct("priority", "when", "name")).alias("name"))


def latest_name_per_id(trips: DataFrame) -> DataFrame:
    """The newest known name of each id."""
    return _newest_name(station_sightings(trips))


def remap_names(trips: DataFrame, names: Lookup) -> DataFrame:
    """Both name columns come from the map; an id outside it gets null."""
    out = trips
    for side in ("departure", "return"):
        step = names.derive(lambda m, s=side: m.select(F.col("id").alias(f"{s}_id"), F.col("name").alias("_name")))
        out = lookup_join(out, step, f"{side}_id").withColumn(f"{side}_name", F.col("_name")).drop("_name")
    return out.select(*trips.columns)


def merge_station_ids(trips: DataFrame) -> DataFrame:
    """Stations that share a name share the id used most for it."""
    usage = station_usage_counts(trips)
    id_map = id_merge_map(join_usage_main_id(usage, main_id_per_name(usage)))
    return remap_ids(trips, as_lookup(id_map, stage="id-map"))


def update_station_names(trips: DataFrame) -> DataFrame:
    names = latest_name_per_id(trips)
    return remap_names(trips, as_lookup(names, stage="station-names"))


def unify_stations(trips: DataFrame) -> DataFrame:
    """Ids merged by name, then the newest name of each merged id: the two steps above in one go.

    The sightings hold all that both steps need, so trips are read twice (once to count, once to replace)
    and each end of a trip is looked up once, for its id and its name together.
    """
    sightings = materialize(station_sightings(trips), "station-sightings")
    counts = sightings.groupBy("id", "name").agg(F.sum("n").alias("n"))
    id_map = id_merge_map(join_usage_main_id(counts, main_id_per_name(counts)))
    merged = sightings.join(id_map, "id").select(F.col("main_id").alias("id"), "name", "priority", "when")
    names = _newest_name(merged).select(F.col("id").alias("main_id"), "name")
    lookup = as_lookup(id_map.join(names, "main_id", "left").select("id", "main_id", "name"), stage="stations")
    out = trips
    for side in ("departure", "return"):
        key = f"{side}_id"
        step = lookup.derive(
            lambda m, k=key: m.select(F.col("id").alias(k), F.col("main_id").alias("_id"), F.col("name").alias("_name"))
        )
        out = lookup_join(out, step, key).withColumns({key: F.coalesce("_id", key), f"{side}_name": F.col("_name")})
        out = out.drop("_id", "_name")
    return out.select(*trips.columns)


def ordered_lookup(ranked: DataFrame, stations: Lookup, key: str = "station_id") -> DataFrame:
    """Names for ranked station ids, in rank order; an unknown id keeps a null name."""
    names = stations.derive(lambda s: s.select(F.col("id").alias(key), "name"))
    return lookup_join(ranked, names, key).orderBy("rank")
