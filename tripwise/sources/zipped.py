"""A Spark data source for CSV files inside zip archives: one partition for each member, read by ranges.

    spark.dataSource.register(ZippedCsv)
    spark.read.format("zipped_csv").schema(schema).load("s3://landing/trips")

Executors open the archive where it lies, read its directory and then the bytes of one member only, so an archive may be
of any size and its members are tasks of their own. Stores are reached through Arrow's file systems (local, HDFS, S3,
GCS); a path without a scheme is local. Archives on stores that only Spark reaches are read by `readers.unzip_trips`.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_PER_CHUNK = 50_000
LISTERS = 16
BUFFER = 1 << 20


def open_store(path: str):
    """The Arrow file system of a path and the path inside it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def list_archives(path: str, pattern: str) -> list[str]:
    """The archive itself, or the archives of a folder and its folders whose names match the pattern, in order."""
    from pyarrow import fs

    store, inside = open_store(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no archives at {path}")
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inside, recursive=True))
    scheme = path[:len(path) - len(inside)] if path.endswith(inside) else ""
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), pattern))


def open_archive(path: str) -> zipfile.ZipFile:
    store, inside = open_store(path)
    return zipfile.ZipFile(pa.PythonFile(store.open_input_file(inside), mode="r"))


@dataclass
class Member(InputPartition):
    """One file of one archive."""

    archive: str
    name: str


class ZippedCsvReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*.zip")
        self.members, self.header = options.get("members", "*.csv"), options.get("header", "true") == "true"

    def partitions(self) -> list[Member]:
        """Only names reach the driver; the archives' directories are read side by side."""
        def of(archive: str) -> list[Member]:
            with open_archive(archive) as opened:
                return [Member(archive, n) for n in opened.namelist() if fnmatch.fnmatch(posixpath.basename(n), self.members)]

        archives = list_archives(self.path, self.pattern)
        with ThreadPoolExecutor(LISTERS) as pool:
            found = [m for members in pool.map(of, archives) for m in members]
        return found or [Member("", "")]  # Spark asks for one at least

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        if not partition.archive:
            return
        names = [f.name for f in self.schema.fields]
        text = {f.name: "string" for f in self.schema.fields if isinstance(f.dataType, T.StringType)}
        times = [f.name for f in self.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
        kinds = to_arrow_schema(self.schema)
        with open_archive(partition.archive) as archive, archive.open(partition.name) as handle:
            try:
                chunks = pd.read_csv(handle, names=names, header=0 if self.header else None, dtype=text, chunksize=ROWS_PER_CHUNK,
                                     float_precision="round_trip")
            except pd.errors.EmptyDataError:
                return
            for chunk in chunks:
                for column in times:
                    chunk[column] = pd.to_datetime(chunk[column])
                yield pa.RecordBatch.from_pandas(chunk, schema=kinds, preserve_index=False)


class ZippedCsv(DataSource):
    """Options: `pathGlobFilter` (archives, *.zip), `members` (files in them, *.csv), `header` (true). Names go by position."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        raise ValueError("give the schema of the members: spark.read.format('zipped_csv').schema(...)")

    def reader(self, schema: T.StructType) -> ZippedCsvReader:
        return ZippedCsvReader(schema, self.options)
