"""The raw-hours format against the text reader; pruning by filters; a stream that goes on where it stopped."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_lake import rich, write_raw

from tidebook.sources import datasource, raw


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    return write_raw(tmp_path, rich(), bad=True, plain_last=True)


def key(rows):
    return sorted((str(r["date"]), r["hour"], r["line"], r["value"]) for r in rows)


def test_lines_equal_those_of_the_text_reader(spark, folder):
    got = spark.read.format("raw_hours").load(folder)
    assert key(got.collect()) == key(raw.numbered_lines(spark, [p for *_, p in raw.list_hours(spark, folder)]).collect())
    assert got.rdd.getNumPartitions() == len(raw.list_hours(spark, folder))
    events, _ = raw.read_raw(spark, folder)
    assert raw.digest(raw.events_of(raw.parsed(got))) == raw.digest(events)


def test_filters_choose_hours_before_they_are_opened(spark, folder):
    (d, h, path), *rest = raw.list_hours(spark, folder)
    for _, _, other in rest:
        Path(other.removeprefix("file:")).write_bytes(b"\xff not gzip \xff")
    got = spark.read.format("raw_hours").load(folder).where((F.col("date") == date.fromisoformat(d)) & (F.col("hour") <= h) & (F.col("line") > 2))
    assert {(str(r["date"]), r["hour"]) for r in got.collect()} == {(d, h)} and got.agg(F.min("line")).first()[0] == 3
    reader = datasource.HoursReader(folder)
    left = list(reader.pushFilters([datasource.EqualTo(("hour",), h), datasource.EqualTo(("line",), 3), datasource.In(("date",), (date.fromisoformat(d),))]))
    assert [f.attribute for f in left] == [("line",)] and [p.hour for p in reader.partitions()] == [h]


def test_no_folder_is_no_lines(spark, tmp_path):
    datasource.register(spark)
    assert spark.read.format("raw_hours").load(str(tmp_path)).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    datasource.register(spark)
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")

    def put(hour, text, mode="w"):
        path = folder / "raw" / "2026-01-01" / f"{hour:02}.ndjson"
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open(mode) as f:
            f.write(text)

    def run():
        stream = spark.readStream.format("raw_hours").load(str(folder))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return [(r["hour"], r["line"], r["value"]) for r in spark.read.schema(datasource.SCHEMA).parquet(out).orderBy("hour", "line").collect()]

    put(4, "a\n\nb\n")
    put(5, "c\nhalf")
    assert run() == [(4, 1, "a"), (4, 2, ""), (4, 3, "b"), (5, 1, "c")]
    assert len(run()) == 4
    put(5, " line\nd\n", "a")
    put(6, "e\n")
    want = [(4, 1, "a"), (4, 2, ""), (4, 3, "b"), (5, 1, "c"), (5, 2, "half line"), (5, 3, "d"), (6, 1, "e")]
    assert run() == want and run() == want
