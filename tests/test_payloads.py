"""Payloads with new, absent and broken fields."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripwise.sources import payloads, readers


@pytest.fixture
def write(tmp_path):
    def one(name, document):
        path = tmp_path / name
        path.write_text(document if isinstance(document, str) else json.dumps(document, indent=1))
        return str(tmp_path)

    return one


def station(i, **more):
    return {"stationId": f"smoove:{i:03d}", "name": f"S{i}", "lat": 60.0 + i, "lon": 24.5, "capacity": i, **more}


def test_good_payloads_give_what_the_strict_reader_gives(spark, write):
    folder = write("a.json", {"data": {"vehicleRentalStations": [station(i) for i in range(5)]}})
    rows = payloads.accepted(payloads.station_records(payloads.read_documents(spark, folder)))
    strict = readers.parse_station_json(spark, folder)
    assert sorted(map(tuple, rows.select(strict.columns).collect())) == sorted(map(tuple, strict.collect()))


def test_unknown_fields_are_kept_and_bad_ones_rejected(spark, write):
    write("a.json", {"data": {"vehicleRentalStations": [
        station(1, state="open", racks={"left": 3}), station(2, capacity="many"), station(3, capacity=None), {"name": "no id"},
        station(5, lat="north", capacity=2.5), station(6, capacity="12")]}})
    write("b.json", "{ broken")
    write("c.json", {"stations": []})
    folder = write("d.json", {"data": {"vehicleRentalStations": []}})
    rows = payloads.station_records(payloads.read_documents(spark, folder)).cache()
    good = {r.id: r for r in payloads.accepted(rows).withColumn("left", F.try_variant_get("record", "$.racks.left", "int")).collect()}
    assert set(good) == {"smoove:001", "smoove:003", "smoove:006"}
    assert good["smoove:001"].left == 3 and good["smoove:003"].capacity is None and good["smoove:006"].capacity == 12
    bad = {(r.source[-6:], r.position): r for r in payloads.rejected(rows).collect()}
    assert bad[("a.json", 1)].reasons == ["capacity is not int"] and json.loads(bad[("a.json", 1)].record)["capacity"] == "many"
    assert bad[("a.json", 3)].reasons == ["id is missing"] and "lat is not double" in bad[("a.json", 4)].reasons
    assert bad[("b.json", None)].reasons == ["not JSON"] and json.loads(bad[("b.json", None)].record) == {"document": "{ broken"}
    assert bad[("c.json", None)].reasons == ["no records at $.data.vehicleRentalStations"] and len(bad) == 5


def test_nodes_by_name_and_capacity(spark, write):
    nodes = [{"lat": 1.0, "lon": 2.0, "tags": {"name": "N", "capacity": "5", "operator": "x"}}, {"lat": 1.0, "lon": 2.0, "tags": {"capacity": "5"}},
             {"lat": 3.0, "lon": 4.0, "tags": {"name": "M"}}, {"lat": 3.0, "lon": 4.0, "tags": {"name": "B", "capacity": "5-10"}}, {"lat": 3.0, "lon": 4.0}]
    rows = payloads.node_records(payloads.read_documents(spark, write("n.json", {"elements": nodes})))
    assert sorted((r.name, r.lat, r.lon, r.capacity) for r in payloads.accepted(rows).collect()) == [("M", 3.0, 4.0, 0), ("N", 1.0, 2.0, 5)]
    assert [(r.position, r.reasons) for r in payloads.rejected(rows).collect()] == [(3, ["capacity is not int"])]


def test_series_of_unequal_length_and_broken_values(spark, write):
    document = {"times": ["2024-04-01T00:00:00", "2024-04-01T01:00:00", "soon", "2024-04-01T03:00:00"], "t2m": [1.5, None, 2, "warm"],
                "ws_10min": [3.0], "snow": [1, 2, 3, 4]}
    rows = payloads.weather_records(payloads.read_documents(spark, write("w.json", document))).orderBy("position")
    good = [tuple(r) for r in payloads.accepted(rows).select("time", "temperature", "wind_speed", "precipitation").collect()]
    assert good == [(datetime(2024, 4, 1), 1.5, 3.0, None), (datetime(2024, 4, 1, 1), None, None, None)]
    assert [(r.position, r.reasons) for r in payloads.rejected(rows).collect()] == [(2, ["time is not timestamp"]), (3, ["temperature is not double"])]


def test_one_document_per_line(spark, tmp_path):
    lines = [json.dumps({"data": {"vehicleRentalStations": [station(i)]}}) for i in range(3)] + ["oops"]
    (tmp_path / "l.json").write_text("\n".join(lines))
    rows = payloads.station_records(payloads.read_documents(spark, str(tmp_path), multi_line=False))
    assert payloads.accepted(rows).count() == 3 and payloads.rejected(rows).count() == 1
