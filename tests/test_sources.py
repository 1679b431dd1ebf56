import json
import zipfile
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tripwise.operators.learning import fit_regressor
from tripwise.sources import readers, schemas, writers

HEADER = "Departure,Return,Departure station id,Departure station name,Return station id,Return station name,Covered distance (m),Duration (sec.)"
ROW = "2021-05-01T00:00:11,2021-05-01T00:04:34,021,Käpylä,004,Market,1057.0,262"


def test_typed_csv_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,name,lat,lon,capacity,source\n007,A,60.1,24.9,10,HSL\n,B,60.2,24.8,5,OSM\n")
    rows = readers.read_csv_typed(spark, str(tmp_path / "s.csv"), schemas.STATIONS).orderBy("name").collect()
    assert [(r.id, r.capacity) for r in rows] == [("007", 10), (None, 5)]


def test_missing_file_fails_at_once(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_csv_typed(spark, str(tmp_path / "none.csv"), schemas.STATIONS)


def test_years_are_stacked_and_missing_ones_skipped(spark, tmp_path):
    for year in (2020, 2021):
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / "05.csv").write_text(f"{HEADER if year == 2021 else HEADER.upper()}\n{ROW}\n")
    df = readers.read_trips_multi(spark, [str(tmp_path / str(y)) for y in range(2019, 2023)])
    assert df.columns == [f.name for f in schemas.RAW_TRIPS.fields]
    assert [(r.departure_id, r.duration) for r in df.collect()] == [("021", 262.0)] * 2
    with pytest.raises(FileNotFoundError):
        readers.read_trips_multi(spark, [str(tmp_path / "1999")])


def test_zip_members(spark, tmp_path):
    for i in range(3):
        with zipfile.ZipFile(tmp_path / f"y{i}.zip", "w") as z:
            z.writestr("a.csv", f"{HEADER}\n{ROW}\n{ROW}\n")
            z.writestr("b.csv", f"{HEADER}\n{ROW.replace(',262', ',')}\n")
            z.writestr("notes.txt", "x")
    rows = readers.read_trips_zip(spark, str(tmp_path)).collect()
    assert len(rows) == 9 and {r.departure_id for r in rows} == {"021"}
    assert sum(r.duration is None for r in rows) == 3 and rows[0].departure_name == "Käpylä"


def test_payloads(spark, tmp_path):
    station = {"stationId": "smoove:012", "name": "A", "lat": 60.1, "lon": 24.9, "capacity": 12}
    (tmp_path / "s.json").write_text(json.dumps({"data": {"vehicleRentalStations": [station]}}, indent=1))
    row = readers.parse_station_json(spark, str(tmp_path / "s.json")).first()
    assert (row.id, row.name, row.capacity) == ("smoove:012", "A", 12)

    nodes = [{"lat": 1.0, "lon": 2.0, "tags": {"name": "N", "capacity": "5"}}, {"lat": 1.0, "lon": 2.0, "tags": {"capacity": "5"}},
             {"lat": 3.0, "lon": 4.0, "tags": {"name": "M"}}]
    (tmp_path / "n.json").write_text(json.dumps({"elements": nodes}, indent=1))
    got = sorted(tuple(r) for r in readers.parse_osm_nodes(spark, str(tmp_path / "n.json")).collect())
    assert got == [("M", 3.0, 4.0, 0), ("N", 1.0, 2.0, 5)]

    weather = {"times": ["2024-04-01T00:00:00", "2024-04-01T01:00:00"], "t2m": [1.5, None], "ws_10min": [3.0, 4.0], "r_1h": [None, 0.2]}
    (tmp_path / "w.json").write_text(json.dumps(weather, indent=1))
    got = [tuple(r) for r in readers.parse_weather_arrays(spark, str(tmp_path / "w.json")).orderBy("time").collect()]
    assert got == [(datetime(2024, 4, 1), 1.5, 3.0, None), (datetime(2024, 4, 1, 1), None, 4.0, 0.2)]


def test_bad_capacity_is_an_error(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"elements": [{"lat": 1.0, "lon": 2.0, "tags": {"name": "N", "capacity": "many"}}]}))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.parse_osm_nodes(spark, str(tmp_path / "n.json")).collect()


def test_year_folders_prune(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2023, 5, 1), 1), (datetime(2024, 5, 1), 2)], "departure timestamp, n int")
    writers.write_trips_by_year(df, str(tmp_path / "trips"))
    part = spark.read.parquet(str(tmp_path / "trips")).filter("year < 2024")
    assert [r.n for r in part.collect()] == [1]
    assert "PartitionFilters: [isnotnull(year" in part._jdf.queryExecution().executedPlan().toString()


def test_train_test_folders(spark, tmp_path):
    df = spark.createDataFrame([(2022,), (2023,), (2024,), (2025,)], "year int")
    writers.write_train_test(df, str(tmp_path / "f"))
    got = sorted((r.split, r.year) for r in spark.read.parquet(str(tmp_path / "f")).collect())
    assert got == [("test", 2024), ("train", 2022), ("train", 2023)]


def test_model_round_trip_and_missing_model(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("dep_lag_1")).withColumn("y", F.col("dep_lag_1") * 2)
    model = fit_regressor(df, ("dep_lag_1",), max_iter=2, max_depth=2)
    writers.save_model(model, str(tmp_path / "m"))
    again = writers.load_model(str(tmp_path / "m"))
    assert again.transform(df).exceptAll(model.transform(df).select(again.transform(df).columns)).count() == 0
    with pytest.warns(UserWarning, match="no model"):
        assert writers.load_model(str(tmp_path / "absent")) is None


def test_missing_year_is_told(spark, tmp_path):
    (tmp_path / "2023.csv").write_text("a,b,c,d,e,f,g,h\n2023-01-01 00:00:00,2023-01-01 00:10:00,1,A,2,B,100,600\n")
    with pytest.warns(UserWarning, match="2022"):
        assert readers.read_trips_multi(spark, [str(tmp_path / "2022.csv"), str(tmp_path / "2023.csv")]).count() == 1


def test_unreadable_number_stops_or_becomes_null(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b,c,d,e,f,g,h\n2023-01-01 00:00:00,2023-01-01 00:10:00,1,A,2,B,far,600\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_trips_multi(spark, [str(tmp_path / "bad.csv")]).collect()
    assert readers.read_trips_multi(spark, [str(tmp_path / "bad.csv")], mode="PERMISSIVE").first()["distance"] is None


def test_damaged_model_is_an_error(spark, tmp_path):
    (tmp_path / "m" / "metadata").mkdir(parents=True)
    (tmp_path / "m" / "metadata" / "part-00000").write_text("{}")
    with pytest.raises(Exception):
        writers.load_model(str(tmp_path / "m"))
