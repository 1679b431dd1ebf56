"""The zip data source: members as tasks, ranges instead of whole archives, the same rows as plain CSV."""

import os
import zipfile
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripwise.sources import readers, schemas, zipped

HEADER = "Departure,Return,Departure station id,Departure station name,Return station id,Return station name,Covered distance (m),Duration (sec.)"
ROWS = [f"2021-05-01T00:{i:02d}:11,2021-05-01T00:{i:02d}:34,{i:03d},Käpylä {i},004,\"Market, west\",{i}.5,{'' if i % 7 == 0 else i}" for i in range(60)]


def archive(path, members, mode="w"):
    with zipfile.ZipFile(path, mode, zipfile.ZIP_DEFLATED) as z:
        for name, lines in members.items():
            z.writestr(name, "\n".join([HEADER, *lines]) + "\n" if lines is not None else "")


def test_members_are_tasks_and_rows_equal_plain_csv(spark, tmp_path):
    (tmp_path / "zips" / "deep").mkdir(parents=True)
    archive(tmp_path / "zips" / "a.zip", {f"m{k}.csv": ROWS[k::5] for k in range(5)} | {"notes.txt": ["x"]})
    archive(tmp_path / "zips" / "deep" / "b.zip", {"x/y.csv": ROWS})
    (tmp_path / "zips" / "other.dat").write_text("no archive")
    (tmp_path / "plain.csv").write_text("\n".join([HEADER, *ROWS]))
    df = readers.read_trips_zip(spark, str(tmp_path / "zips"))
    assert df.rdd.getNumPartitions() == 6
    plain = [tuple(r) for r in readers.read_trips_multi(spark, [str(tmp_path / "plain.csv")]).collect()]
    assert Counter(tuple(r) for r in df.collect()) == Counter(plain * 2)
    one = spark.read.format("zipped_csv").schema(schemas.RAW_TRIPS).load(f"file://{tmp_path}/zips/a.zip")
    assert Counter(tuple(r) for r in one.collect()) == Counter(plain)


def test_an_archive_above_two_gib(spark, tmp_path):
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.truncate(2_300_000_000)  # a hole: it takes no room on the disk
    archive(path, {"a.csv": ROWS, "b.csv": ROWS[:3]}, "a")
    assert os.path.getsize(path) > 2 << 30
    assert readers.read_trips_zip(spark, str(tmp_path)).count() == 63


def test_types_times_and_empty_members(spark, tmp_path):
    archive(tmp_path / "a.zip", {"a.csv": ROWS[:2], "none.csv": None, "head.csv": []})
    df = spark.read.format("zipped_csv").schema(schemas.TRIPS).load(str(tmp_path)).orderBy("departure")
    rows = df.collect()
    assert [r.departure for r in rows] == [datetime(2021, 5, 1, 0, i, 11) for i in range(2)]
    assert [(r.departure_id, r.return_name, r.distance, r.duration) for r in rows] == [("000", "Market, west", 0.5, None), ("001", "Market, west", 1.5, 1.0)]


def test_options_and_missing_paths(spark, tmp_path):
    archive(tmp_path / "a.zip", {"a.csv": ROWS[:2], "b.csv": ROWS[:5]})
    archive(tmp_path / "b.zip", {"a.csv": ROWS[:1]})
    read = spark.read.format("zipped_csv").schema(schemas.RAW_TRIPS)
    assert read.option("members", "b.csv").load(str(tmp_path)).count() == 5
    assert spark.read.format("zipped_csv").schema(schemas.RAW_TRIPS).option("pathGlobFilter", "b.*").load(str(tmp_path)).count() == 1
    (tmp_path / "empty").mkdir()
    assert readers.read_trips_zip(spark, str(tmp_path / "empty")).agg(F.count("*")).first()[0] == 0
    with pytest.raises(Exception, match="no archives at"):
        readers.read_trips_zip(spark, str(tmp_path / "none")).count()
    with pytest.raises(Exception, match="give the schema"):
        spark.read.format("zipped_csv").load(str(tmp_path)).count()


def test_binary_archives_give_the_same_rows(spark, tmp_path):
    archive(tmp_path / "a.zip", {"a.csv": ROWS, "b.csv": ROWS[:5]})
    binary = readers.unzip_trips(spark.read.format("binaryFile").load(str(tmp_path / "a.zip")))
    direct = readers.read_trips_zip(spark, str(tmp_path))
    assert zipped.ROWS_PER_CHUNK > 0 and binary.exceptAll(direct).isEmpty() and direct.exceptAll(binary).isEmpty()
