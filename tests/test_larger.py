"""Queries against their SQL on made events of which one hour or one market has more than the smallest tables have."""

from __future__ import annotations

import gzip

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import plain

import __spark_entry__ as entry
from tidebook.operators import book
from tidebook.plans import market, rich
from tidebook.session import stored
from tidebook.sources import hours, lake, raw
from tidebook.streaming import market_state


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """12,001 events, all of them in one raw hour, of few markets; the sum of their times is odd and beyond 2**53."""
    out = tmp_path_factory.mktemp("larger")
    n = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, ["view", "click", "error", "purchase", "signup"])), (F.xxhash64("id") % 5 + 5).cast("int") % 5 + 1)
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + n * 120 * 7 + F.when(n == 0, 120).otherwise(0))
    e = spark.range(12_001).select(n.alias("event_id"), at.cast("timestamp_ntz").alias("ts"), (n % 7).alias("user_id"), kind.alias("event_type"), (n % 100 + 0.5).alias("value"), F.concat(F.lit('{"k": '), (n * 31 % 80).cast("string"), F.lit("}")).alias("props"))
    e.coalesce(1).write.parquet(str(out / "events.parquet"))
    return str(out)


def both(spark, folder, name):
    """The rows of a query and of its SQL, in one form."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str), sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_times_of_an_hour_add_up_exactly(spark, folder):
    ours, theirs = both(spark, folder, "raw_hours_scan")
    assert ours == theirs


def test_no_task_parses_a_whole_hour(spark, folder, tmp_path, monkeypatch):
    """An hour is parsed and filed in parts, and what is parsed is not held as one block of a cache."""
    made = stored(rich.lines(market.stream(spark, folder)), "lines")
    hours.stage(made, str(tmp_path), 0)
    hours.close_hours(spark, str(tmp_path))
    most, parsed = [], raw.parsed

    def seen(lines):
        most.append(lines.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return parsed(lines)

    monkeypatch.setattr(raw, "parsed", seen)
    monkeypatch.setattr(lake, "PARSED_LINES", 500, raising=False)
    monkeypatch.setattr(lake, "FILE_LINES", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        report = lake.compact(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    per_hour = [r["lines"] for r in report]
    assert sum(per_hour) == 12_001 and max(most) <= max(per_hour) / 2
    assert sum(r["n"] for r in lake.rows_filed(spark, str(tmp_path)).collect() if r["table_name"] == "trades") == made.where("value like '%\"kind\":\"trade\"%'").count()


def test_lines_of_one_file_are_parsed_by_many_tasks(spark, folder):
    """books_verified and the replays: events that come in one file are spread before their lines are written and parsed."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert all(found(spark, folder).rdd.getNumPartitions() >= 4 for found in (market.recorded, rich.recorded))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_recorded_stream_has_files_of_its_stretches_for_one_trigger(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(rich, "scratch", lambda spark, name: str(tmp_path / name))
    rich._streamed(spark, folder)
    spans = sorted((r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "lines")).groupBy(F.input_file_name()).agg(F.min("line").alias("a"), F.max("line").alias("b")).collect())
    assert 8 <= len(spans) <= 64 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_the_fold_gets_only_what_it_reads(spark, folder):
    held = rich.recorded(spark, folder).select(book.folded_fields()).schema["payload"].dataType.names
    assert len(held) == 8 and {"changes", "bids", "asks", "windowEnd"} < set(held)


def test_a_feeds_one_task_gets_slices(spark):
    frame = pd.DataFrame({"feed": "clob", "ms": range(1000), "reason": [None] * 999 + ["reconnect"], "gap_ms": [None] * 999 + [5.0], "slice": [i // 100 for i in range(1000)]})
    (got,) = market_state._sliced(iter([frame]))
    assert len(got) == 11 and got["n"].sum() == 1000
    assert got[["ms", "last_ms", "n"]].values.tolist()[:2] == [[0, 99, 100], [100, 199, 100]] and got.iloc[-1]["reason"] == "reconnect"


def test_a_replays_events_are_made_once_for_its_summary(spark, folder):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(t):
        made.add(1)
        return t

    events = rich.recorded(spark, folder).where("line < 500")
    one = book.replay_summary(events.withColumn("recv_ts", seen("recv_ts"))).first()
    assert one["events"] == made.value == 500
    assert one["digest"] == book.replay_summary(events.repartition(3)).first()["digest"]


def test_lines_of_one_file_are_numbered_by_many_tasks(spark, tmp_path):
    day = tmp_path / "raw" / "2024-01-01"
    day.mkdir(parents=True)
    texts = {0: [f"line {i}" * (i % 5) for i in range(3000)], 1: ["", "a", "", "b"], 2: [f"{i}" for i in range(50)]}
    for hour, lines in texts.items():
        text = "".join(x + "\n" for x in lines).encode()
        (day / (f"{hour:02}.ndjson" + ".gz" * (hour == 2))).write_bytes(gzip.compress(text) if hour == 2 else text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        numbered = raw.numbered_lines(spark, [p for *_, p in raw.list_hours(spark, str(tmp_path))])
        parts = [[(r["hour"], r["line"], r["value"]) for r in part] for part in numbered.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(x for part in parts for x in part) == [(h, i, x) for h, lines in texts.items() for i, x in enumerate(lines, 1)]
    assert max(map(len, parts)) < 1500


def test_lines_of_one_hour_are_staged_by_many_tasks(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(hours, "STAGED_LINES", 1000, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hours.stage(rich.lines(market.stream(spark, folder)), str(tmp_path), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    busiest = max(len(list(p.glob("*.gz"))) for p in tmp_path.glob("stream_raw/batch=0/date=*/hour=*"))
    assert busiest > 1
    found = 0
    for d, h in hours.close_hours(spark, str(tmp_path)):
        at = [int(r[0]) for r in spark.read.text(f"{tmp_path}/raw/{d}/{h:02}.ndjson.gz").select(F.get_json_object("value", "$.recvTs")).collect()]
        assert at == sorted(at)
        found += len(at)
    assert found == 12_001


def test_a_table_is_filed_from_the_lines_of_its_kind(spark, folder, tmp_path, monkeypatch):
    hours.stage(rich.lines(market.stream(spark, folder)), str(tmp_path), 0)
    hours.close_hours(spark, str(tmp_path))
    rows_for, read = lake.rows_for, {}

    def seen(events, table):
        out = rows_for(events, table)
        read[table] = {r[0] for r in out.select(F.input_file_name()).distinct().collect()}
        return out

    monkeypatch.setattr(lake, "rows_for", seen)
    lake.compact(spark, str(tmp_path))
    assert read["trades"] and all(not (a & b) for x, a in read.items() for y, b in read.items() if x != y)


def test_an_unordered_replay_has_no_sort(spark, folder, tmp_path):
    hours.stage(rich.lines(market.stream(spark, folder)), str(tmp_path), 0)
    hours.close_hours(spark, str(tmp_path))
    lake.compact(spark, str(tmp_path))
    plan = lambda **how: lake.replay(spark, str(tmp_path), parquet=True, **how)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" in plan() and "Sort [" not in plan(ordered=False)


def test_a_line_is_parsed_once_whatever_filters_stand_on_it(spark, folder):
    plan = raw.events_of(raw.parsed(stored(rich.lines(market.stream(spark, folder)), "lines"))).where("line > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_two_replays_are_compared_on_events_parsed_once(spark, folder, monkeypatch):
    calls, parsed = [], raw.parsed
    monkeypatch.setattr(raw, "parsed", lambda lines: (calls.append(1), parsed(lines))[1])
    ours, theirs = both(spark, folder, "replay_first_difference")
    assert ours == theirs and len(ours) == 1 and len(calls) == 1
