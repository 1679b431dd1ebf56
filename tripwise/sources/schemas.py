"""Explicit schemas. Ids are text everywhere, so leading zeros survive."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _NUMBER, _TIME, _INT = T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_ENDS = {"departure_id": _TEXT, "departure_name": _TEXT, "return_id": _TEXT, "return_name": _TEXT}

# Times as text: unparsable ones are turned into nulls later, not into failed reads.
RAW_TRIPS = _schema(**{"departure": _TEXT, "return": _TEXT, **_ENDS, "distance": _NUMBER, "duration": _NUMBER})
TRIPS = _schema(**{"departure": _TIME, "return": _TIME, **_ENDS, "distance": _NUMBER, "duration": _NUMBER})
CLEAN_TRIPS = T.StructType(
    TRIPS.fields
    + [T.StructField(f"{s}_{c}", _NUMBER) for s in ("departure", "return") for c in ("lat", "lon", "capacity")]
)
STATIONS = _schema(id=_TEXT, name=_TEXT, lat=_NUMBER, lon=_NUMBER, capacity=_INT, source=_TEXT)
WEATHER = _schema(time=_TIME, temperature=_NUMBER, wind_speed=_NUMBER, precipitation=_NUMBER)

STATION_PAYLOAD = _schema(
    data=_schema(
        vehicleRentalStations=T.ArrayType(
            _schema(stationId=_TEXT, name=_TEXT, lat=_NUMBER, lon=_NUMBER, capacity=_INT)
        )
    )
)
NODE_PAYLOAD = _schema(elements=T.ArrayType(_schema(lat=_NUMBER, lon=_NUMBER, tags=T.MapType(_TEXT, _TEXT))))
WEATHER_PAYLOAD = _schema(
    times=T.ArrayType(_TIME), t2m=T.ArrayType(_NUMBER), ws_10min=T.ArrayType(_NUMBER), r_1h=T.ArrayType(_NUMBER)
)
