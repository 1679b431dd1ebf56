"""Trip-shaped tables derived from the given parquet tables, without random functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.operators.identity import unify_stations
from tripwise.operators.staging import materialize
from tripwise.plans.cleaning import clean_rides
from tripwise.plans.feature_table import build_feature_table

MONTHS = (1,)
TOP = 10
_STAGED: dict[tuple, DataFrame] = {}


class Tables:
    """Inputs of one session and one folder. Tables that many queries share are written once per session,
    the way the cleaned trips are handed from one step to the next in production."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # Local hours carry no zone; the session must not shift them.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df

    def staged(self, label: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, label)
        if key not in _STAGED:
            _STAGED[key] = materialize(build(), label)
        return _STAGED[key]

    @property
    def rides(self) -> DataFrame:
        """Raw trips: null durations and distances, outliers, one name with two ids, ids with two names."""
        e, user = F.col("event_id"), F.col("user_id")
        seconds = F.floor(F.col("value") * 60)

        def digits(x):
            return F.lpad(x.cast("string"), 3, "0")

        back = (user * 7 + e) % 20
        old = F.when((user % 20 < 3) & (e % 3 == 0), "Old ").otherwise("")
        return self.read("events").select(
            e.alias("ride_id"),
            F.col("ts").alias("departure"),
            F.timestamp_micros(F.unix_micros("ts") + (seconds + e % 5) * 1_000_000).alias("return"),
            digits(user % 20).alias("departure_id"),
            F.concat(old, F.lit("S"), digits(F.least(user % 20, F.lit(18)))).alias("departure_name"),
            digits(back).alias("return_id"),
            F.concat(F.lit("S"), digits(F.least(back, F.lit(18)))).alias("return_name"),
            F.when(e % 101 != 0, F.col("value") * 100).alias("distance"),
            F.when(F.col("event_type") != "error", seconds.cast("double")).alias("duration"),
        )

    @property
    def stations(self) -> DataFrame:
        """Twelve stations known by id, five by name, one name twice, two stations without location."""
        k = F.col("n_nationkey")
        return self.read("nation").filter((k < 17) | (k == 23)).select(
            F.when(k < 12, F.lpad(k.cast("string"), 3, "0")).otherwise("").alias("id"),
            F.concat(F.lit("S"), F.lpad(F.when(k == 23, 13).otherwise(k).cast("string"), 3, "0")).alias("name"),
            (F.lit(60.1) + k * 0.01).alias("lat"),
            (F.lit(24.8) + k * 0.02).alias("lon"),
            (F.lit(10) + k).alias("capacity"),
            F.when(k < 12, "HSL").otherwise("OSM").alias("source"),
        )

    @property
    def weather(self) -> DataFrame:
        """Hourly observations with gaps over the whole span of the events."""
        value, kind = F.col("value"), F.col("event_type")
        seen = (
            self.read("events")
            .groupBy(F.date_trunc("hour", "ts").alias("time"))
            .agg(
                F.avg(F.when(kind == "view", value)).alias("temperature"),
                F.avg(F.when((kind == "click") & (F.col("user_id") % 8 == 0), value)).alias("wind_speed"),
                F.sum(F.when(kind == "purchase", F.floor(value / 40).cast("double"))).alias("precipitation"),
            )
        )
        hours = self.read("events").agg(
            F.min(F.date_trunc("hour", "ts")).alias("lo"), F.max(F.date_trunc("hour", "ts")).alias("hi")
        )
        spine = hours.select(F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("time"))
        return spine.join(seen, "time", "left")

    @property
    def daily_orders(self) -> DataFrame:
        """Several years of demand at day grain: one row per (station, day)."""
        return (
            self.read("orders")
            .join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").cast("string").alias("station_id"), F.col("o_orderdate").alias("time"))
            .agg(F.count(F.lit(1)).alias("departures"))
        )

    @property
    def unified(self) -> DataFrame:
        return self.staged("unified", lambda: unify_stations(self.rides))

    @property
    def clean(self) -> DataFrame:
        """Cleaned trips with locations."""
        return self.staged("clean-rides", lambda: clean_rides(self.unified, self.stations))

    @property
    def clean_weather(self) -> DataFrame:
        from tripwise.operators.gaps import clean_weather

        return self.staged("clean-weather", lambda: clean_weather(self.weather, chunk="week"))

    @property
    def features(self) -> DataFrame:
        return self.staged(
            "features", lambda: build_feature_table(self.clean, self.clean_weather, TOP, months=MONTHS)
        )
