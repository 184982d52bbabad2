"""Closed hours: a stream's hours read back by the rest, redone after a crash without a difference, late lines merged in."""

from __future__ import annotations

import gzip
import shutil
from pathlib import Path

from pyspark.sql import functions as F
from test_lake import rich, write_raw

from tidebook.sources import hours, lake, raw
from tidebook.streaming import market_stream


def contents(folder):
    return {str(p.relative_to(folder)): gzip.decompress(p.read_bytes()) for p in sorted(Path(folder, "raw").rglob("*.gz"))}


def test_a_streams_hours_are_closed_compacted_and_replayed(spark, tmp_path):
    source, out = write_raw(tmp_path / "in", rich()), str(tmp_path / "out")
    events = market_stream.event_stream(spark, source, files_per_batch=1)
    assert market_stream.record_hours(events, out, str(tmp_path / "c"), late_ms=60_000).awaitTermination(180)
    every = [h[:2] for h in raw.list_hours(spark, source)]
    closed = [h[:2] for h in raw.list_hours(spark, out)]
    assert closed and closed == every[: len(closed)] and len(closed) < len(every)  # the last hour is still open
    hours.close_hours(spark, out)
    assert [h[:2] for h in raw.list_hours(spark, out)] == every and not hours.staged(spark, out)
    texts = lambda df: sorted(r["text"] for r in raw.canonical(df).select("text").collect())
    assert texts(lake.replay(spark, out)) == texts(lake.replay(spark, source))
    back = lake.replay(spark, out).select("date", "hour", "line", "recv_ts").collect()
    assert back == sorted(back, key=lambda r: (r["date"], r["hour"], r["recv_ts"], r["line"]))
    lake.compact(spark, out)
    assert raw.digest(lake.replay(spark, out, parquet=True)) == raw.digest(lake.replay(spark, out))
    assert sum(r["lines"] for r in hours.manifest(spark, out).collect()) == len(rich())


def test_closing_again_after_a_crash_and_late_lines(spark, tmp_path):
    out = str(tmp_path)
    lines = raw.encoded(lake.replay(spark, write_raw(tmp_path / "in", rich())))
    for b in range(3):
        hours.stage(lines.where(F.col("line") % 3 == b), out, b)
    shutil.copytree(tmp_path / "stream_raw", tmp_path / "copy")
    hours.close_hours(spark, out)
    first = contents(out)
    assert sum(t.count(b"\n") for t in first.values()) == len(rich())
    # before the batches were set aside: staged ones and those set aside are the same
    shutil.copytree(tmp_path / "copy", tmp_path / "stream_raw", dirs_exist_ok=True)
    hours.close_hours(spark, out)
    assert contents(out) == first
    # after the rename of the file alone
    shutil.rmtree(tmp_path / "stream_done")
    shutil.copytree(tmp_path / "copy", tmp_path / "stream_raw", dirs_exist_ok=True)
    hours.close_hours(spark, out)
    assert contents(out) == first and hours.close_hours(spark, out) == []
    late = lines.orderBy("date", "hour", "line").limit(1).withColumn("value", F.regexp_replace("value", '"recvTs":"[0-9]+"', '"recvTs":"1"'))
    hours.stage(late, out, 3)
    (hour,) = hours.close_hours(spark, out)
    name = f"raw/{hour[0]}/{hour[1]:02}.ndjson.gz"
    assert contents(out)[name].count(b"\n") == first[name].count(b"\n") + 1 and b'"recvTs":"1"' in contents(out)[name].split(b"\n")[0]
    hours.sweep(spark, out, ("9999-01-01", 0))
    assert not hours.staged(spark, out, "stream_done") and hours.manifest(spark, out).count() == len(first)


def test_nothing_staged(spark, tmp_path):
    assert hours.close_hours(spark, str(tmp_path)) == [] and hours.manifest(spark, str(tmp_path)).count() == 0
