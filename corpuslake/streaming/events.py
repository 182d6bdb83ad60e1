"""File events of a folder as a stream: a Python data source over the folder's listing."""

from __future__ import annotations

import fnmatch
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, length long"
#: Events of a partition.
PART = 10_000


class Listing(InputPartition):
    """Files with the time (in microseconds) and length that the listing had."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class EventReader(DataSourceStreamReader):
    """An offset is the (modified, path) up to which events were given: nanoseconds, so a decimal string, and a path.

    Files modified within the last ``settle`` seconds wait, so that all files of one time are there when an offset passes it, also where times
    are whole seconds. A file rewritten before its event was read gives one event, of the later time.
    """

    def __init__(self, folder: str, glob: str, settle: float):
        self.folder, self.glob, self.settle = folder, glob, settle

    def _files(self) -> Iterator[tuple[int, str, int]]:
        with os.scandir(self.folder) as found:
            for entry in found:
                if fnmatch.fnmatchcase(entry.name, self.glob) and entry.is_file():
                    about = entry.stat()
                    yield about.st_mtime_ns, entry.path, about.st_size

    def initialOffset(self) -> dict:
        return {"modified": "0", "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        last = max(((t, path) for t, path, _ in self._files() if t <= until), default=(0, ""))
        return {"modified": str(last[0]), "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((int(o["modified"]), o["path"]) for o in (start, end))
        came = sorted((t, path, length) for t, path, length in self._files() if low < (t, path) <= high)
        return [Listing([(path, t // 1000, length) for t, path, length in came[i : i + PART]]) for i in range(0, len(came), PART)]

    def read(self, partition: Listing) -> Iterator[pa.RecordBatch]:
        if partition.files:
            paths, times, lengths = zip(*partition.files)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(times, pa.timestamp("us", "UTC")), pa.array(lengths, pa.int64())], ["path", "modified", "length"])

    def commit(self, end: dict) -> None:
        pass


class FolderEvents(DataSource):
    """``folder_events``: an event for every file of a folder that is created or modified; contents are not read.

    Options: ``path``, a folder that is mounted where the driver runs; ``glob`` of file names; ``settle`` in seconds. Events are found by
    time of modification: a file moved in with an old time gives none (the next ingestion's listing has it).
    """

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> EventReader:
        return EventReader(local_path(self.options["path"]), self.options.get("glob", "*.[pP][dD][fF]"), float(self.options.get("settle", 1.0)))


def local_path(folder: str) -> str:
    return os.path.normpath("/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith("file:") else os.path.abspath(folder)


def folder_events(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The stream of a folder's events: ``path``, ``modified``, ``length``."""
    spark.dataSource.register(FolderEvents)
    return spark.readStream.format("folder_events").options(path=folder, **options).load()
