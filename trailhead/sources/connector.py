"""Documents and event lines as data sources of spark.read and spark.readStream.

    connector.register(spark)
    spark.read.format("trailhead_documents").load(root)            # what files.documents() gives
    spark.readStream.format("trailhead_events").load(root)         # value, path: lines for files.event_lines()

Documents: filters on relative_path (equal, in, begins, ends) and media_type (equal, in) are applied to the listing, so that other
files aren't opened; files are dealt to tasks by size. Where a filter isn't pushed (spark.sql.python.filterPushdown.enabled
is off by default), Spark applies it and the rows are the same.

Events: an offset is the time and the name of the last file taken, in order of both, and is all that a checkpoint holds. A file is
taken whole, once it hasn't changed for settle seconds (10 by itself), so that none appears behind an offset; files must
not change after that.

Roots are those that pyarrow.fs can read (folders, file:, hdfs:, s3:, gs:), and every executor has to see them. Defined
results: an empty root gives no rows; empty files are a document of no bytes (files.documents() leaves them out, as
Spark's binaryFile does) and no lines; a root that isn't there stops
the job; a file that goes between listing and reading stops its task.
"""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as DS

from . import files as SF

PART_BYTES = 64 << 20
#: Media types by suffix.
SUFFIXES = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "text": "text/plain", "htm": "text/html", "html": "text/html", "pdf": "application/pdf"}
DOCUMENT = "relative_path string, content binary, length long, media_type string, source_type string"
EVENT_SUFFIXES = (".ndjson", ".jsonl")
LINES = 1 << 13


@dataclass
class Files(DS.InputPartition):
    """Files of a task: (path to open, relative path)."""

    paths: list[tuple[str, str]]


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if re.match(r"\w+:", root) else (pafs.LocalFileSystem(), root)


def _listed(root: str) -> list[tuple[str, str, int, int]]:
    """Path to open, path under the root, bytes, time of change in nanoseconds; of all files below."""
    system, base = _open(root)
    base = base.rstrip("/")
    found = system.get_file_info(pafs.FileSelector(base, recursive=True))
    return [(f.path, f.path[len(base) + 1 :], f.size, f.mtime_ns or 0) for f in found if f.type == pafs.FileType.File]


def _dealt(found: list[tuple[str, str, int, int]], limit: int) -> list[Files]:
    """Files in order, as many to a task as limit bytes allow."""
    out, size = [], 0
    for path, name, n, _ in found:
        if not out or size + n > limit:
            out.append(Files([]))
            size = 0
        out[-1].paths.append((path, name))
        size += n
    return out


def _relative(name: str) -> str:
    return re.sub(r"^(?:\./|/)+", "", unicodedata.normalize("NFC", name).replace("\\", "/"))


def _media(name: str) -> str | None:
    stem, dot, suffix = name.rpartition(".")
    return SUFFIXES.get(suffix.lower()) if dot else None


def _test(f: DS.Filter):
    """What a filter asks of (relative_path, media_type), or None if it isn't for the listing."""
    at = {("relative_path",): 0, ("media_type",): 1}.get(getattr(f, "attribute", None))
    if at is None:
        return None
    if isinstance(f, DS.IsNotNull):
        return lambda row: True
    if isinstance(f, DS.EqualTo):
        return lambda row: row[at] == f.value
    if isinstance(f, DS.In):
        return lambda row: row[at] in f.value
    if isinstance(f, DS.StringStartsWith):
        return lambda row: row[at].startswith(f.value)
    if isinstance(f, DS.StringEndsWith):
        return lambda row: row[at].endswith(f.value)
    return None


class DocumentReader(DS.DataSourceReader):
    def __init__(self, root: str, patterns: list[str], limit: int):
        self.root, self.ignored, self.limit, self.tests = root, SF.ignore_regex(patterns), limit, []

    def pushFilters(self, filters):
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        kept = []
        for path, name, size, at in _listed(self.root):
            name = _relative(name)
            row = (name, _media(name))
            # a folder or file whose name begins with _ or . is hidden, as in Spark's own sources
            hidden = any(p.startswith((".", "_")) for p in name.split("/"))
            if row[1] and not hidden and not re.search(self.ignored, name) and all(t(row) for t in self.tests):
                kept.append((path, name, size, at))
        # without a partition Spark would ask for one of None
        return _dealt(sorted(kept, key=lambda x: x[1]), self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.root)
        for path, name in partition.paths:
            with system.open_input_stream(path, compression=None) as f:
                content = f.read()
            yield pa.RecordBatch.from_pydict({"relative_path": [name], "content": [content], "length": pa.array([len(content)], pa.int64()), "media_type": [_media(name)], "source_type": ["file"]})


class Documents(DS.DataSource):
    """Options: path; ignore (patterns by line, instead of the usual ones); partBytes."""

    @classmethod
    def name(cls) -> str:
        return "trailhead_documents"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> DocumentReader:
        lines = self.options.get("ignore")
        return DocumentReader(self.options["path"], SF.ignore_patterns() if lines is None else lines.splitlines(), int(self.options.get("partBytes", PART_BYTES)))


class EventReader(DS.DataSourceStreamReader):
    def __init__(self, root: str, settle: float, limit: int):
        self.root, self.settle, self.limit = root, settle, limit

    def _between(self, after: list, until: list) -> list[tuple[str, str, int, int]]:
        named = [x for x in _listed(self.root) if x[1].lower().endswith(EVENT_SUFFIXES)]
        return sorted((x for x in named if after < [x[3], x[1]] <= until), key=lambda x: (x[3], x[1]))

    def initialOffset(self) -> dict:
        return {"last": [-1, ""]}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        found = self._between([-1, ""], [until, ""])
        return {"last": [found[-1][3], found[-1][1]]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt(self._between(start["last"], end["last"]), self.limit)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.root)
        for path, name in partition.paths:
            with system.open_input_stream(path, compression=None) as f:
                yield from self._lines(f, name)

    @staticmethod
    def _lines(raw, name: str) -> Iterator[pa.RecordBatch]:
        rest, lines = b"", []
        while block := raw.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            lines += whole
            if len(lines) >= LINES:
                yield EventReader._batch(lines, name)
                lines = []
        lines += [rest] if rest else []
        if lines:
            yield EventReader._batch(lines, name)

    @staticmethod
    def _batch(lines: list[bytes], name: str) -> pa.RecordBatch:
        text = [x.decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_pydict({"value": pa.array(text, pa.string()), "path": pa.array([name] * len(text), pa.string())})


class Events(DS.DataSource):
    """Options: path; settle (seconds); partBytes."""

    @classmethod
    def name(cls) -> str:
        return "trailhead_events"

    def schema(self) -> str:
        return "value string, path string"

    def streamReader(self, schema) -> EventReader:
        return EventReader(self.options["path"], float(self.options.get("settle", 10)), int(self.options.get("partBytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Documents, Events):
        spark.dataSource.register(source)
