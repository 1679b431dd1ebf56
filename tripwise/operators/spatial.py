"""Usage over space: station totals, station pairs and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.functions.columns import (
    pair_ends,
    pair_key_directed,
    pair_key_undirected,
    quartile_color,
    trips_label,
)
from tripwise.operators.quantiles import usage_quartile


def _side_counts(trips: DataFrame, side: str, name: str) -> DataFrame:
    keys = [F.col(f"{side}_{c}").alias(a) for c, a in (("name", "station"), ("lat", "lat"), ("lon", "lon"))]
    return trips.select(*keys).na.drop("any").groupBy("station", "lat", "lon").agg(F.count(F.lit(1)).alias(name))


def station_departures(trips: DataFrame) -> DataFrame:
    """Departures per (name, lat, lon); trips without a location drop out."""
    return _side_counts(trips, "departure", "departures")


def station_returns(trips: DataFrame) -> DataFrame:
    return _side_counts(trips, "return", "returns")


def full_outer_counts(departures: DataFrame, returns: DataFrame) -> DataFrame:
    joined = departures.join(returns, ["station", "lat", "lon"], "full_outer")
    return joined.na.fill(0, ["departures", "returns"])


def station_total_trips(trips: DataFrame, sort: bool = True) -> DataFrame:
    """Departures, returns and their sum per (name, lat, lon): both ends of a trip are rows of one scan."""
    names = ("station", "lat", "lon")
    ends = [F.struct(*[F.col(f"{side}_{c}").alias(n) for c, n in zip(("name", "lat", "lon"), names)], F.lit(leaves).alias("leaves"))
            for side, leaves in (("departure", True), ("return", False))]
    rows = trips.select(F.inline(F.array(*ends))).na.drop("any", subset=list(names))
    counts = rows.groupBy(*names).agg(F.count_if("leaves").alias("departures"), F.count_if(~F.col("leaves")).alias("returns"))
    total = counts.withColumn("total_trips", F.col("departures") + F.col("returns"))
    return total.orderBy(F.desc("total_trips"), "station", "lat", "lon") if sort else total


def top_stations(totals: DataFrame, n: int = 10) -> DataFrame:
    return totals.orderBy(F.desc("total_trips"), "station", "lat", "lon").limit(n)


def top_station_pairs(trips: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent directed pairs; equal counts in key order."""
    key = pair_key_directed(F.col("departure_name"), F.col("return_name"))
    counted = trips.select(key.alias("station_pair")).filter(F.col("station_pair").isNotNull())
    return (
        counted.groupBy("station_pair")
        .agg(F.count(F.lit(1)).alias("trips"))
        .orderBy(F.desc("trips"), "station_pair")
        .limit(n)
    )


def station_points(trips: DataFrame) -> DataFrame:
    """One location per departure station name: that of its first trip, after a hash aggregate per location."""
    places = trips.groupBy(
        F.col("departure_name").alias("station"), F.col("departure_lat").alias("lat"), F.col("departure_lon").alias("lon")
    ).agg(F.min("departure").alias("_first"))
    at = F.struct("lat", "lon")
    return places.groupBy("station").agg(F.min_by(at, F.struct("_first", at)).alias("at")).select("station", "at.*")


def route_endpoints(routes: DataFrame, points: DataFrame) -> DataFrame:
    """Coordinates of both ends. `routes` is a top-k table, so it is the broadcast side of a semi join that
    cuts the points down to the stations wanted; those are at most 2k rows."""
    ends = routes.select(F.explode(F.array("station_a", "station_b")).alias("station")).distinct()
    wanted = points.join(F.broadcast(ends), "station", "left_semi")
    a = wanted.select(F.col("station").alias("station_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = wanted.select(F.col("station").alias("station_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return routes.join(F.broadcast(a), "station_a", "left").join(F.broadcast(b), "station_b", "left")


def top_route_counts(trips: DataFrame, n: int = 20) -> DataFrame:
    """The n most travelled undirected pairs, both names carried along with the key."""
    a, b = pair_ends(F.col("departure_name"), F.col("return_name"))
    return (
        trips.select(a.alias("station_a"), b.alias("station_b"))
        .filter(F.col("station_a").isNotNull())
        .groupBy("station_a", "station_b")
        .agg(F.count(F.lit(1)).alias("trip_count"))
        .withColumn("pair_key", pair_key_undirected(F.col("station_a"), F.col("station_b")))
        .orderBy(F.desc("trip_count"), "pair_key")
        .limit(n)
    )


def top_routes(trips: DataFrame, n: int = 20) -> DataFrame:
    routes = top_route_counts(trips, n)
    ends = route_endpoints(routes, station_points(trips))
    return ends.withColumn("label", trips_label(F.col("pair_key"), F.col("trip_count")))


def station_map(totals: DataFrame) -> DataFrame:
    """Marker table of a usage map: location, quartile, colour and popup text."""
    return usage_quartile(totals.filter(F.col("lat").isNotNull())).select(
        "*",
        quartile_color(F.col("usage_quartile")).alias("color"),
        trips_label(F.col("station"), F.col("total_trips")).alias("popup"),
    )
