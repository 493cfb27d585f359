"""A data source for files of JSON objects that follow each other in any layout: commas, blanks or nothing between them, lines broken anywhere.

A file is read in byte ranges, each by its own task. A range begins anywhere, within a string perhaps, so the source reads in two steps:

* ``object_ranges`` reads every range once and tells how it changes the state of a scan, for either state that it may begin in: outside of strings, or within one. These changes
  compose, so that a running sum over a file's ranges tells each range's own beginning.
* ``object_texts`` reads the ranges again, each from its known beginning, and gives the top-level objects that open in it, reading on beyond its end for the last.

``spark.read.format("json_objects")`` does the first step; ``read_objects`` does both. A condition on path is pushed down, so that other files are not opened.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
_MARKS = re.compile(rb'["\\{}]')
_IN_STRING = re.compile(rb'["\\]')


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Scan:
    """The state of a scan over bytes: within a string or not, behind a backslash or not, and how many braces are open."""

    def __init__(self, quoted: bool = False, escaped: bool = False, depth: int = 0):
        self.quoted, self.escaped, self.depth = quoted, escaped, depth

    def marks(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(place, depth behind it) of the braces of data outside of strings."""
        at = 0
        if self.escaped and data:
            self.escaped, at = False, 1
        while (found := (_IN_STRING if self.quoted else _MARKS).search(data, at)) is not None:
            at, mark = found.end(), found[0]
            if self.quoted:
                if mark == b"\\":
                    if at == len(data):
                        self.escaped = True
                    at += 1
                else:
                    self.quoted = False
            elif mark == b'"':
                self.quoted = True
            elif mark != b"\\":
                self.depth += 1 if mark == b"{" else -1
                yield found.start(), self.depth


def _pieces(path: str, first: int, end: int | None) -> Iterator[bytes]:
    files, where = _opened(path)
    with files.open_input_file(where) as f:
        f.seek(first)
        left = None if end is None else end - first
        while left is None or left > 0:
            piece = f.read(READ_BYTES if left is None else min(READ_BYTES, left))
            if not piece:
                return
            left = None if left is None else left - len(piece)
            yield piece


class _Range(InputPartition):
    def __init__(self, path: str, number: int, first: int, end: int):
        self.path, self.number, self.first, self.end = path, number, first, end


class _Ranges(DataSourceReader):
    def __init__(self, path: str, size: int):
        self._path, self._size, self._kept = path, size, []

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)):
                self._kept.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        tests = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value), StringEndsWith: lambda f: path.endswith(f.value)}
        return all(tests[type(f)](f) for f in self._kept)

    def partitions(self) -> list[InputPartition]:
        files, where = _opened(self._path)
        folder, _, pattern = where.rpartition("/") if any(c in where for c in "*?[") else (where, "", "*")
        info = files.get_file_info(folder)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(folder))
        lead = self._path[: -len(where)] if self._path.endswith(where) else ""
        named = sorted((lead + i.path, i.size) for i in found if i.is_file and (info.is_file or fnmatch.fnmatch(i.base_name, pattern)) and not i.base_name.startswith(("_", ".")))
        return [_Range(p, k, at, min(size, at + self._size)) for p, size in named if self._wanted(p) for k, at in enumerate(range(0, size, self._size))]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if part is None:
            return
        out = []
        for quoted in (False, True):
            # an escape runs over into the next range, so it is a state of its own; whether one begins behind a backslash is told by the range before it
            for escaped in (False, True):
                scan = Scan(quoted, escaped)
                for piece in _pieces(part.path, part.first, part.end):
                    for _ in scan.marks(piece):
                        pass
                out.append((2 * scan.quoted + scan.escaped, scan.depth))
        yield (part.path, part.number, part.first, part.end, [s for s, _ in out], [d for _, d in out])


class JsonObjects(DataSource):
    """Options: path, a file, a folder or a pattern of file names; range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "json_objects"

    def schema(self) -> str:
        return "path string, number int, first long, end long, states array<int>, depths array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Ranges(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def object_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, condition: str | None = None) -> DataFrame:
    """(path, number, first, end, states, depths): the byte ranges of the files that condition, on path, holds of, and the state in which each ends and the braces that it
    opens, for each of the four states in which it may begin: 2 within a string, plus 1 behind a backslash.

    The condition is pushed down here, once for each frame: the engine keeps what was pushed with the loaded source, so that later conditions must not be, and are not.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonObjects)
    ranges = spark.read.format("json_objects").option("range_bytes", str(range_bytes)).load(path)
    ranges = ranges.where(condition) if condition else ranges
    return ranges.withColumn("path", F.concat("path", F.lit("")))


def with_beginnings(ranges: DataFrame) -> DataFrame:
    """ranges with state and depth, those in which each begins: a file's ranges, a few numbers each, are composed in order."""
    before = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    steps = F.collect_list(F.struct("states", "depths")).over(before)  # 16 MB of a file a row: some thousands of rows for 100 GB
    begun = F.aggregate(steps, F.struct(F.lit(0).alias("state"), F.lit(0).alias("depth")), lambda s, r: F.struct(F.element_at(r["states"], s["state"] + 1).alias("state"), (s["depth"] + F.element_at(r["depths"], s["state"] + 1)).alias("depth")))
    return ranges.withColumn("__begun", begun).select(*ranges.columns, "__begun.state", "__begun.depth")


_TEXTS = "path string, at long, text string"


def object_texts(ranges: DataFrame) -> DataFrame:
    """(path, at, text) of the top-level objects that open in each of ranges (path, first, end, state, depth); one that the file ends within is left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                scan, at, began, held, out = Scan(r["state"] >= 2, r["state"] % 2 == 1, r["depth"]), r["first"], None, [], []
                for piece in _pieces(r["path"], r["first"], None):
                    start = 0 if began is not None else None
                    for place, depth in scan.marks(piece):
                        if depth == 1 and piece[place : place + 1] == b"{":
                            if at + place >= r["end"]:
                                break
                            began, start = at + place, place
                        elif depth == 0 and began is not None:
                            out.append((r["path"], began, b"".join([*held, piece[start : place + 1]]).decode()))
                            began, start, held = None, None, []
                            if at + place >= r["end"]:
                                break
                    if began is not None:
                        held.append(piece[start:])
                    at += len(piece)
                    if at >= r["end"] and began is None:
                        break
                for lo in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[lo : lo + 4096], strict=True)], ["path", "at", "text"])

    return ranges.select("path", "first", "end", "state", "depth").repartition("path", "first").mapInArrow(read, _TEXTS)


def read_objects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, condition: str | None = None) -> DataFrame:
    """(path, at, text): every top-level JSON object of the files, by the place where it opens; condition, on path, leaves files out unread."""
    return object_texts(with_beginnings(object_ranges(spark, path, range_bytes, condition)))
