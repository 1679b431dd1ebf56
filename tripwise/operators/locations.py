"""Station locations: combine two sources and attach them to trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.functions.columns import tag_source, zero_pad_id
from tripwise.operators.staging import Lookup, as_lookup, lookup_join

DETAILS = ("lat", "lon", "capacity")


def anti_join_by_name(extra: DataFrame, known: DataFrame) -> DataFrame:
    """Stations of `extra` whose name does not occur in `known`."""
    return extra.join(known.select("name").distinct(), "name", "left_anti").select(*extra.columns)


def combine_stations(community: DataFrame, official: DataFrame | None = None) -> DataFrame:
    """Official stations plus the community-mapped ones missing there; without official data the latter only."""
    community = tag_source(community, "OSM", blank_id=True)
    if official is None:
        return community
    return tag_source(official, "HSL").unionByName(
        anti_join_by_name(community, official), allowMissingColumns=True
    )


def prepare_stations(stations: DataFrame) -> Lookup:
    """Pad the ids and measure the table once for all joins that use it."""
    return as_lookup(stations.withColumn("id", zero_pad_id(F.col("id"))))


def join_station_by_id(trips: DataFrame, stations: Lookup, side: str) -> DataFrame:
    """Location columns of official stations, matched on the station id."""
    official = stations.derive(
        lambda s: s.filter(F.col("source") == "HSL").select(
            F.col("id").alias(f"{side}_id"), *[F.col(c).cast("double").alias(f"{side}_{c}") for c in DETAILS]
        )
    )
    return lookup_join(trips, official, f"{side}_id")


def join_station_by_name(trips: DataFrame, stations: Lookup, side: str, dedupe: bool = False) -> DataFrame:
    """Fill locations still missing from community stations of the same name.

    A name that occurs twice among them repeats the trip; `dedupe` keeps the smallest location instead.
    """

    def community(s: DataFrame) -> DataFrame:
        rows = s.filter(F.col("source") == "OSM").select(
            F.col("name").alias(f"{side}_name"), *[F.col(c).cast("double").alias(f"_{c}") for c in DETAILS]
        )
        if not dedupe:
            return rows
        first = F.min(F.struct(*[f"_{c}" for c in DETAILS])).alias("first")
        return rows.groupBy(f"{side}_name").agg(first).select(f"{side}_name", "first.*")

    joined = lookup_join(trips, stations.derive(community), f"{side}_name")
    filled = {f"{side}_{c}": F.coalesce(f"{side}_{c}", f"_{c}") for c in DETAILS}
    return joined.withColumns(filled).select(*trips.columns)


def merge_station_info(trips: DataFrame, stations: Lookup, side: str, dedupe: bool = False) -> DataFrame:
    """Latitude, longitude and capacity for one side ('departure' or 'return') of every trip."""
    return join_station_by_name(join_station_by_id(trips, stations, side), stations, side, dedupe)


def first_location_per_id(trips: DataFrame) -> DataFrame:
    """One location per departure station: that of its first trip. Equal moments go to the smaller location.

    As with the names, a hash aggregate over (station, location) comes first.
    """
    places = trips.groupBy(
        F.col("departure_id").alias("station_id"), *[F.col(f"departure_{c}").alias(c) for c in DETAILS]
    ).agg(F.min("departure").alias("_first"))
    at = F.struct(*DETAILS)
    return places.groupBy("station_id").agg(F.min_by(at, F.struct("_first", at)).alias("at")).select("station_id", "at.*")


def join_station_coords(hourly: DataFrame, locations: Lookup) -> DataFrame:
    return lookup_join(hourly, locations, "station_id")
