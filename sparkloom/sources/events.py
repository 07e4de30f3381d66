"""Logs of server events and folders of manifests as Python data sources, in batch and as streams.

``register(spark)`` makes two formats known:

* ``event_lines``: (file, at, value), each line of the files in a folder with its place in bytes. Files are cut into ranges of
  ``partitionBytes`` that are read apart; a line belongs to the range in which it begins, however long it is.
* ``file_manifests``: (manifest, filename, sha256, url), the entries of each JSON manifest in a folder, a task a manifest.

Names give the order of files, and only the newest one may still grow, as a log that is rolled. A stream's offset is thus one name and one
place, whatever the number of files; it starts again from its checkpoint without repeating or losing a line. Files that come late under an
earlier name are not read by a stream that is past them.

Defined cases: a line counts once its new line is there, and what follows the last one is left for later; hidden files (``.``, ``_``) are
no part of a folder; a folder that is empty or not there has no rows; bytes that are no UTF-8 become replacement characters; manifests that are no
JSON, or hold no list ``docs``, have no rows, nor have entries that are no objects.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range by default, of lines that go to Spark at once, and of a look back for the last new line.
RANGE, SENT, LOOK = 64 << 20, 4 << 20, 64 << 10


@dataclass
class _Range(InputPartition):
    """The lines of a file that begin in [start, end)."""

    file: str
    start: int
    end: int


class _Folder:
    """The files of a folder in order of their names, on any file system that Arrow knows."""

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.step = int(options.get("partitionBytes", RANGE))
        if self.step < 1:
            raise ValueError("partitionBytes must be 1 or more")

    def opened(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path)

    def files(self) -> list[tuple[str, int]]:
        fs, base = self.opened()
        found = fs.get_file_info(FileSelector(base, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.type == FileType.File and f.base_name[0] not in "._")

    def file(self, name: str):
        fs, base = self.opened()
        return fs.open_input_file(f"{base}/{name}")


class _Lines(_Folder):
    def ranges(self, file: str, start: int, end: int) -> list[_Range]:
        return [_Range(file, at, min(at + self.step, end)) for at in range(start, end, self.step)]

    def ended(self, name: str, size: int) -> int:
        """The place after the last new line of a file."""
        with self.file(name) as f:
            while size:
                low = max(0, size - LOOK)
                f.seek(low)
                if (last := f.read(size - low).rfind(b"\n")) >= 0:
                    return low + last + 1
                size = low
        return 0

    def rows(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with self.file(part.file) as raw:
            f, at, found, held = io.BufferedReader(raw, 1 << 20), part.start, [], 0
            if at:  # the rest of a line that began before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < part.end and (line := f.readline()).endswith(b"\n"):
                found.append((at, line[:-1].decode("utf-8", "replace")))
                at, held = at + len(line), held + len(line)
                if held >= SENT:
                    yield self.batch(part.file, found)
                    found, held = [], 0
        if found:
            yield self.batch(part.file, found)

    def batch(self, file: str, found: list[tuple[int, str]]) -> pa.RecordBatch:
        places, lines = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "value"])


class _LineReader(_Lines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [r for name, size in self.files() for r in self.ranges(name, 0, size)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.file else iter(())


class _LineStream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"file": files[-1][0], "at": self.ended(*files[-1])} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for name, size in self.files():
            if start["file"] <= name <= end["file"]:
                parts += self.ranges(name, start["at"] if name == start["file"] else 0, end["at"] if name == end["file"] else size)
        return parts

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class EventLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineStream(self.options)


class _Manifests(_Folder):
    def rows(self, part: _Range) -> Iterator[tuple]:
        with self.file(part.file) as f:
            try:
                found = json.loads(f.read())
            except ValueError:  # unreadable: no rows
                return
        entries = found.get("docs") if isinstance(found, dict) else None
        for entry in entries if isinstance(entries, list) else []:
            if isinstance(entry, dict):
                values = (entry.get(k) for k in ("filename", "sha256", "url"))
                yield (part.file, *(None if v is None else str(v) for v in values))


class _ManifestReader(_Manifests, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_Range(name, 0, size) for name, size in self.files()] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.rows(partition) if partition.file else iter(())


class _ManifestStream(_Manifests, DataSourceStreamReader):
    """A manifest is read once, whole: it must be put in the folder by a rename."""

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max([name for name, _ in self.files()], default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(name, 0, size) for name, size in self.files() if start["file"] < name <= end["file"]]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.rows(partition)


class FileManifests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_manifests"

    def schema(self) -> str:
        return "manifest string, filename string, sha256 string, url string"

    def reader(self, schema) -> DataSourceReader:
        return _ManifestReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ManifestStream(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(EventLines)
    spark.dataSource.register(FileManifests)
