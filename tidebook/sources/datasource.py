"""Raw hours as a data source of its own: spark.read.format("raw_hours") and spark.readStream.format("raw_hours").

Each hour is a partition; its reader numbers the lines (blank ones too) while it reads, so nothing is shuffled or sorted
for it. Filters on date and hour choose the files before any is opened. As a stream, offsets are positions (date, hour,
line): hours come in their order, and an hour that is still written is read up to its last whole line and goes on from there.
Files are opened by their URI through Arrow's file systems.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date as Date

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "date date, hour int, line int, value string"
#: Lines of one Arrow batch.
BATCH_LINES = 8192
_HOUR = re.compile(r"/(\d{4}-\d{2}-\d{2})/(\d{2})\.ndjson(\.gz)?$")
_TYPES = pa.schema([("date", pa.date32()), ("hour", pa.int32()), ("line", pa.int32()), ("value", pa.string())])


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def hours(path: str) -> list[tuple[str, int, str]]:
    """(date, hour, file) under path/raw, oldest first; a gzipped hour wins over a plain twin."""
    fs, root = _filesystem(f"{path.rstrip('/')}/raw")
    found: dict[tuple[str, int], str] = {}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if (m := _HOUR.search(info.path)) and int(m[2]) < 24 and (m[3] or (m[1], int(m[2])) not in found):
            found[m[1], int(m[2])] = info.path
    return [(*key, found[key]) for key in sorted(found)]


@dataclass
class HourPart(InputPartition):
    """Lines [first, last] of one hour's file; last None: to its end."""

    date: str
    hour: int
    file: str
    first: int = 1
    last: int | None = None


def _lines(path: str, file: str, whole: bool = False) -> Iterator[bytes]:
    """Lines of a file without their ends; with whole, a last line that has no end yet is left out."""
    fs, _ = _filesystem(path)
    with fs.open_input_stream(file, compression="gzip" if file.endswith(".gz") else None) as source, io.BufferedReader(source, 1 << 20) as reader:
        for line in reader:
            if line.endswith(b"\n"):
                yield line[:-1].removesuffix(b"\r")
            elif not whole:
                yield line


def _batches(path: str, part: HourPart | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # what a reader without partitions is called with
        return
    day, numbers, values = Date.fromisoformat(part.date), [], []

    def batch() -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays([pa.array([day] * n, pa.date32()), pa.array([part.hour] * n, pa.int32()), pa.array(numbers, pa.int32()), pa.array(values, pa.string())], schema=_TYPES)

    for i, line in enumerate(_lines(path, part.file), 1):
        if part.last is not None and i > part.last:
            break
        if i < part.first:
            continue
        numbers.append(i)
        values.append(line.decode("utf-8", "replace"))
        if len(numbers) >= BATCH_LINES:
            yield batch()
            numbers, values = [], []
    if numbers:
        yield batch()


def _takes(f: Filter, date: Date, hour: int) -> bool | None:
    """Whether an hour passes a filter on its date or number; None for what is not decided here."""
    own = {"date": date, "hour": hour}
    if f.attribute not in (("date",), ("hour",)):
        return None
    x = own[f.attribute[0]]
    tests = {EqualTo: lambda: x == f.value, In: lambda: x in f.value, GreaterThan: lambda: x > f.value, GreaterThanOrEqual: lambda: x >= f.value, LessThan: lambda: x < f.value, LessThanOrEqual: lambda: x <= f.value}
    return tests[type(f)]() if type(f) in tests else None


class HoursReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on date and hour are kept here; the others are Spark's."""
        for f in filters:
            if hasattr(f, "attribute") and _takes(f, Date(2000, 1, 1), 0) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[HourPart]:
        return [HourPart(d, h, file) for d, h, file in hours(self.path) if all(_takes(f, Date.fromisoformat(d), h) for f in self.filters)]

    def read(self, partition: HourPart) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition)


class HoursStream(DataSourceStreamReader):
    """Offsets: date, hour and the last line that is read. Only the newest hour is counted line by line to find them."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"date": "", "hour": -1, "line": 0}

    def latestOffset(self) -> dict:
        there = hours(self.path)
        if not there:
            return self.initialOffset()
        d, h, file = there[-1]
        return {"date": d, "hour": h, "line": sum(1 for _ in _lines(self.path, file, whole=not file.endswith(".gz")))}

    def partitions(self, start: dict, end: dict) -> list[HourPart]:
        """An hour that start stops in goes on after that line; hours between are read to their ends, end's up to its line."""
        key = lambda o: (o["date"], o["hour"])
        out = []
        for d, h, file in hours(self.path):
            if key(start) <= (d, h) <= key(end):
                first = start["line"] + 1 if (d, h) == key(start) else 1
                last = end["line"] if (d, h) == key(end) else None
                if last is None or first <= last:
                    out.append(HourPart(d, h, file, first, last))
        return out

    def read(self, partition: HourPart) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class RawHours(DataSource):
    """Option path: the folder that raw/ lies in."""

    @classmethod
    def name(cls) -> str:
        return "raw_hours"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HoursReader:
        return HoursReader(self.options["path"])

    def streamReader(self, schema) -> HoursStream:
        return HoursStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.dataSource.register(RawHours)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
