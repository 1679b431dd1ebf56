"""Batch readers: typed CSV, many trip files, zipped trips, API payloads landed as JSON.

Payload files hold one JSON document each; `multi_line=False` reads files with one document per line."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.functions.columns import lowercase_columns
from tripwise.sources.schemas import NODE_PAYLOAD, RAW_TRIPS, STATION_PAYLOAD, WEATHER_PAYLOAD
from tripwise.sources.zipped import ROWS_PER_CHUNK, ZippedCsv


def read_csv_typed(spark: SparkSession, path, schema: T.StructType, mode: str = "FAILFAST", **options) -> DataFrame:
    """CSV with a header and a fixed schema; a missing path fails when the plan is made.

    A value that does not fit its type stops the job; with `mode="PERMISSIVE"` it becomes null.
    """
    return spark.read.schema(schema).options(header=True, enforceSchema=False, mode=mode, **options).csv(path)


def read_trips_multi(spark: SparkSession, paths: Iterable[str], schema: T.StructType = RAW_TRIPS,
                     mode: str = "FAILFAST") -> DataFrame:
    """One scan over the trip files of several years. Headers differ between years, so names go by position.
    A path that does not exist is skipped with a warning; none at all is an error. Unreadable numbers stop the job
    unless `mode` is PERMISSIVE, which makes them null."""

    def scan(p):
        return spark.read.schema(schema).options(header=True, enforceSchema=True, mode=mode).csv(p)

    present = []
    for path in paths:
        try:
            scan(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"no trip files at {path}", stacklevel=2)
            continue
        present.append(path)
    if not present:
        raise FileNotFoundError("no trip files at any of the given paths")
    return scan(present)


def unzip_trips(archives: DataFrame, schema: T.StructType = RAW_TRIPS) -> DataFrame:
    """Rows of the .csv members of zip archives given as (path, content), as Spark's binary reader gives them: below 2 GiB.
    Unzipping runs in the executors, one archive at a time, and gives the rows on in chunks."""
    names = [f.name for f in schema.fields]
    text = {f.name: "string" for f in schema.fields if isinstance(f.dataType, T.StringType)}

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.endswith(".csv"):
                            with archive.open(member) as handle:
                                yield from pd.read_csv(
                                    handle, names=names, header=0, dtype=text, chunksize=ROWS_PER_CHUNK,
                                    float_precision="round_trip",
                                )

    return archives.select("content").mapInPandas(unzip, schema)


def read_trips_zip(spark: SparkSession, path: str, schema: T.StructType = RAW_TRIPS) -> DataFrame:
    """Trips of every zip archive at the path: each .csv member is a task that reads its own bytes of the archive (see
    `zipped`). Archives on a store that only Spark reaches go through `unzip_trips` instead, whole and below 2 GiB."""
    spark.dataSource.register(ZippedCsv)
    return spark.read.format(ZippedCsv.name()).schema(schema).load(path)


def station_rows(payload: DataFrame) -> DataFrame:
    return payload.select(F.inline("data.vehicleRentalStations")).withColumnRenamed("stationId", "ID")


def parse_station_json(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Official station payload to rows (id, name, lat, lon, capacity)."""
    return lowercase_columns(station_rows(spark.read.schema(STATION_PAYLOAD).json(path, multiLine=multi_line)))


def node_rows(payload: DataFrame) -> DataFrame:
    """Community-mapped nodes: unnamed ones are dropped, a missing capacity is 0."""
    node = payload.select(F.explode("elements").alias("node"))
    tags = F.col("node.tags")
    return node.select(
        F.coalesce(tags["name"], F.lit("Unknown")).alias("name"),
        F.col("node.lat").alias("lat"),
        F.col("node.lon").alias("lon"),
        F.coalesce(tags["capacity"].cast("int"), F.lit(0)).alias("capacity"),
    ).filter(F.col("name") != "Unknown")


def parse_osm_nodes(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    return node_rows(spark.read.schema(NODE_PAYLOAD).json(path, multiLine=multi_line))


def weather_rows(payload: DataFrame) -> DataFrame:
    """Parallel arrays to one row per time; times stay UTC."""
    return payload.select(
        F.inline(
            F.arrays_zip(
                F.col("times").alias("time"),
                F.col("t2m").alias("temperature"),
                F.col("ws_10min").alias("wind_speed"),
                F.col("r_1h").alias("precipitation"),
            )
        )
    )


def parse_weather_arrays(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Observation payloads, all of them stacked."""
    return weather_rows(spark.read.schema(WEATHER_PAYLOAD).json(path, multiLine=multi_line))
