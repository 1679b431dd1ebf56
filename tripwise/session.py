"""Spark session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    # Zone-less local hours must never be shifted a second time.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dimension tables read straight from files are broadcast by Spark itself below this size.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tripwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword settings use '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
