"""JSON payloads whose fields drift: records stay whole as variants, known fields are taken out by type, and what cannot be
read becomes a row of a table of rejected records instead of a stopped job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A known field of a record: where it lies, its type, whether a record must have it, and what stands in for it."""

    path: str
    kind: str
    required: bool = False
    default: object = None


# Where the published payloads keep their records and fields.
STATION_RECORDS = "$.data.vehicleRentalStations"
STATION_FIELDS = {
    "id": Field("$.stationId", "string", required=True), "name": Field("$.name", "string"), "lat": Field("$.lat", "double"),
    "lon": Field("$.lon", "double"), "capacity": Field("$.capacity", "int"),
}
NODE_RECORDS = "$.elements"
NODE_FIELDS = {
    "name": Field("$.tags.name", "string", default="Unknown"), "lat": Field("$.lat", "double"), "lon": Field("$.lon", "double"),
    "capacity": Field("$.tags.capacity", "int", default=0),
}
WEATHER_TIMES = "$.times"
WEATHER_SERIES = {"temperature": "$.t2m", "wind_speed": "$.ws_10min", "precipitation": "$.r_1h"}


def read_documents(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """`source` (file) and `document` (text) of each payload; `multi_line=False` reads a document per line."""
    return spark.read.text(path, wholetext=multi_line).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("document"))


def _field(record: str, field: Field) -> tuple[Column, Column]:
    """The typed value and whether something is there that is not of the type."""
    raw = F.try_variant_get(record, field.path, "variant")
    there = raw.isNotNull() & ~F.is_variant_null(raw)
    value = F.try_variant_get(record, field.path, field.kind)
    default = F.lit(field.default).cast(field.kind)
    return F.when(there, value).otherwise(default), there & value.isNull()


def _opened(documents: DataFrame) -> DataFrame:
    return documents.withColumn("_doc", F.try_parse_json("document"))


def _rejected_document(reason: str) -> Column:
    return F.array(F.lit(reason))


def records(documents: DataFrame, at: str, fields: dict[str, Field]) -> DataFrame:
    """One row for each record: `source`, `position` (from 0), the fields, `record` (the whole record as a variant, so unknown
    fields are kept) and `reasons` (why it is rejected; empty for a good one).

    A document that is no JSON, or has no array at `at`, is one rejected row without a position, with its text as the
    record. A field that is there but not of its type, or is absent though required, is a reason. Nulls count as absent.
    """
    found = _opened(documents).withColumn("_records", F.try_variant_get("_doc", at, "array<variant>"))
    each = found.select("source", "document", "_doc", "_records", F.posexplode_outer("_records").alias("position", "record"))
    values, reasons = {}, []
    for name, field in fields.items():
        values[name], bad = _field("record", field)
        reasons.append(F.when(bad, F.lit(f"{name} is not {field.kind}")))
        if field.required:
            reasons.append(F.when(values[name].isNull() & ~bad, F.lit(f"{name} is missing")))
    of_document = F.when(F.col("_doc").isNull(), _rejected_document("not JSON")).when(
        F.col("_records").isNull(), _rejected_document(f"no records at {at}"))
    whole = F.when(F.col("position").isNull(), F.coalesce("_doc", F.to_variant_object(F.struct("document")))).otherwise(F.col("record"))
    out = each.filter(F.col("position").isNotNull() | of_document.isNotNull())  # an empty array has no records and no fault
    return out.select(
        "source", "position", *[v.alias(n) for n, v in values.items()], whole.alias("record"),
        F.coalesce(of_document, F.array_compact(F.array(*reasons))).alias("reasons"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("reasons") == 0).drop("reasons")


def rejected(rows: DataFrame) -> DataFrame:
    """`source`, `position`, `reasons` and the record as text."""
    return rows.filter(F.size("reasons") > 0).select("source", "position", "reasons", F.to_json("record").alias("record"))


def station_records(documents: DataFrame) -> DataFrame:
    """Stations of official payloads."""
    return records(documents, STATION_RECORDS, STATION_FIELDS)


def node_records(documents: DataFrame) -> DataFrame:
    """Community-mapped nodes; unnamed ones are left out, a missing capacity is 0, one that is no number is rejected."""
    return records(documents, NODE_RECORDS, NODE_FIELDS).filter((F.size("reasons") > 0) | (F.col("name") != "Unknown"))


def weather_records(documents: DataFrame) -> DataFrame:
    """Parallel series to one row for each time; `record` holds the values of that time. A series that is shorter gives nulls,
    one that is absent or new in the payload costs nothing; times and values that cannot be read are rejected by row."""
    found = _opened(documents).withColumn("_times", F.try_variant_get("_doc", WEATHER_TIMES, "array<variant>"))
    series = {n: F.coalesce(F.try_variant_get("_doc", p, "array<variant>"), F.array().cast("array<variant>")) for n, p in WEATHER_SERIES.items()}
    found = found.withColumns({f"_{n}": s for n, s in series.items()})
    each = found.select("source", "document", "_doc", "_times", *[f"_{n}" for n in series], F.posexplode_outer("_times").alias("position", "_time"))
    time = F.try_variant_get("_time", "$", "timestamp")
    fault = F.when(F.col("_doc").isNull(), _rejected_document("not JSON")).when(
        F.col("_times").isNull(), _rejected_document(f"no records at {WEATHER_TIMES}"))
    values, reasons = {}, [F.when(time.isNull(), F.lit("time is not timestamp"))]
    for name in series:
        raw = F.get(F.col(f"_{name}"), F.col("position"))
        values[name] = F.try_variant_get(raw, "$", "double")
        reasons.append(F.when(raw.isNotNull() & ~F.is_variant_null(raw) & values[name].isNull(), F.lit(f"{name} is not double")))
    of_time = F.to_variant_object(F.struct(F.col("_time").alias("time"), *[F.get(F.col(f"_{n}"), F.col("position")).alias(n) for n in series]))
    whole = F.when(F.col("position").isNull(), F.coalesce("_doc", F.to_variant_object(F.struct("document")))).otherwise(of_time)
    out = each.filter(F.col("position").isNotNull() | fault.isNotNull())
    return out.select("source", "position", time.alias("time"), *[v.alias(n) for n, v in values.items()], whole.alias("record"),
                      F.coalesce(fault, F.array_compact(F.array(*reasons))).alias("reasons"))
