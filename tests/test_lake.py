from __future__ import annotations

import gzip
import json
from collections import defaultdict
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidebook import schema as S
from tidebook.operators import book, gaps
from tidebook.operators.health import market_health
from tidebook.sources import lake, normalize, raw
from tidebook.sources.synthetic import LENGTH_MS, WINDOW_START, market_lines
from tidebook.streaming import market_stream

W0 = WINDOW_START


def write_raw(folder, lines, bad=False, plain_last=False):
    hours = defaultdict(list)
    for ns, line in lines:
        hours[datetime.fromtimestamp(ns // 10**9, timezone.utc).strftime("%Y-%m-%d/%H")].append(line)
    for i, (name, own) in enumerate(sorted(hours.items())):
        if bad:
            own[3:3] = ['{"kind":"spot","exch', ""]
        path = folder / "raw" / f"{name}.ndjson"
        path.parent.mkdir(parents=True, exist_ok=True)
        text = "\n".join(own) + "\n"
        if plain_last and i == len(hours) - 1:
            path.write_text(text)
        else:
            (path.parent / (path.name + ".gz")).write_bytes(gzip.compress(text.encode()))
    return str(folder)


def event(kind, ms, payload, market="0xabc", token=None, ns=None):
    e = {"kind": kind, "marketId": market, "token": token, "exchangeTs": ms, "recvTs": str(ns or ms * 10**6), "payload": payload}
    return int(e["recvTs"]), json.dumps({k: v for k, v in e.items() if v is not None})


def rich():
    lines = market_lines()
    t = W0 + 100_000
    more = [
        event("book_snapshot", t, {"bids": [{"price": 0.31, "size": 10}, {"price": 0.3, "size": 20}], "asks": [{"price": 0.33, "size": 5}], "hash": "h"}, token="UP"),
        event("book_snapshot", t, {"bids": [], "asks": [], "hash": "e"}, token="DOWN"),
        event("book_delta", t + 1, {"changes": [{"token": "UP", "side": "SELL", "price": 0.31, "size": 22, "bestBid": None, "bestAsk": 0.31}, {"token": "UP", "side": "BUY", "price": 0.2, "size": 1, "bestBid": 0.2, "bestAsk": 0.31}, {"token": "DOWN", "side": "BUY", "price": 0.6, "size": 0, "bestBid": 0.6, "bestAsk": 0.8}]}),
        event("trade", t + 2, {"price": 0.3, "size": 109.375, "side": "BUY", "feeRateBps": 0, "txHash": "x"}, token="UP"),
        event("spot", t + 3, {"type": "trade", "source": "coinbase", "price": 84000.5, "size": 0.1, "side": "SELL"}, market=None),
        event("spot", W0 + 3_000_000, {"type": "bbo", "source": "coinbase", "bid": 1, "bidSize": 0, "ask": 2, "askSize": 0}, market=None),
        event("feed_gap", W0 + 3_000_000, {"feed": "clob", "gapMs": 5, "reason": "sequence_break"}),
        event("venue_raw", W0 + 3_000_001, {"feed": "clob", "eventType": "odd", "data": "{}"}),
        event("venue_raw", W0 + 3_000_002, {"feed": "clob", "eventType": "odd", "data": "{}"}),
        event("res_price", W0 + 3_333, {"source": "chainlink", "symbol": "btc/usd", "price": 1.5, "backfill": True}, market=None),
        event("feed_gap", t + 4, {"feed": "clob", "gapMs": 12, "reason": "silence"}),
        event("feed_gap", t + 5, {"feed": "spot:x", "gapMs": 12, "reason": "reconnect"}, market=None),
        event("tick_size_change", t + 6, {"oldTickSize": 0.01, "newTickSize": 0.001}, token="UP"),
        event("venue_raw", t + 7, {"feed": "clob", "eventType": "odd", "data": "{}"}),
        event("trade", t + 7, {"price": 0.5, "size": 1, "side": "SELL", "feeRateBps": 0, "txHash": "y"}, market="other", token="DOWN"),
    ]
    return sorted(lines + more, key=lambda x: x[0])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = write_raw(tmp_path_factory.mktemp("lake"), rich(), bad=True, plain_last=True)
    lake.compact(spark, path)
    return path


def test_hours_and_bad_lines(spark, folder):
    hours = raw.list_hours(spark, folder)
    assert [h[:2] for h in hours] == sorted(h[:2] for h in hours) and hours[0][2].endswith(".gz") and not hours[-1][2].endswith(".gz")
    events, bad = raw.read_raw(spark, folder)
    assert events.count() == len(rich())
    assert {(r["hour"], r["line"]) for r in bad.collect()} == {(h, 4) for _, h, _ in hours}
    assert lake.compacted(spark, folder) == {h[:2] for h in hours}
    assert lake.compact(spark, folder).count() == 0


def test_redo_gives_the_same_tables(spark, tmp_path):
    path = write_raw(tmp_path, rich())
    first = lake.compact(spark, path).collect()
    counts = {t: lake.read_table(spark, path, t).count() for t in S.TABLES}
    assert sorted(lake.compact(spark, path, force=True).collect()) == sorted(first)
    assert counts == {t: lake.read_table(spark, path, t).count() for t in S.TABLES} and counts["book_levels"] == 4
    assert sum(r["events"] for r in first) == len(rich())


def test_tables_replay_what_was_recorded(spark, folder):
    text = lambda df: [(str(r["date"]), r["hour"], r["line"], r["text"]) for r in raw.canonical(df).collect()]
    a, b = text(lake.replay(spark, folder)), text(lake.replay(spark, folder, parquet=True))
    assert a == b and len(a) == len(rich()) and a == sorted(a)
    assert raw.digest(lake.replay(spark, folder)) == raw.digest(lake.replay(spark, folder, parquet=True))
    start, end = (W0 + 100_000) * 10**6, (W0 + 101_000) * 10**6
    for parquet in (False, True):
        got = lake.replay(spark, folder, start, end, ["0xabc"], parquet).collect()
        assert {r["market_id"] for r in got} == {"0xabc", None} and all(start <= r["recv_ts"] < end for r in got)
    assert text(lake.replay(spark, folder, start, end)) == text(lake.replay(spark, folder, start, end, parquet=True))


def test_hours_are_pruned_before_they_are_read(spark, tmp_path):
    path = write_raw(tmp_path, rich())
    hours = raw.list_hours(spark, path)
    lake.compact(spark, path, closed_before=hours[1][:2])
    every = [r["line"] for r in raw.canonical(lake.replay(spark, path)).collect()]
    mixed = lake.replay(spark, path, parquet=None)
    assert [r["line"] for r in mixed.collect()] == every and raw.digest(mixed) == raw.digest(lake.replay(spark, path))
    plain, filed = lake.planned_hours(spark, path)
    assert filed == {hours[0][:2]} and [h[:2] for h in plain] == [h[:2] for h in hours[1:]]
    read = {f.rsplit("raw/", 1)[1] for f in mixed.inputFiles() if "/raw/" in f}
    assert read == {h[2].rsplit("raw/", 1)[1] for h in hours[1:]}
    day = hours[0][0]
    assert raw.digest(lake.day_events(spark, path, day, parquet=False)) == raw.digest(lake.day_events(spark, path, day))
    assert lake.day_events(spark, path, "2001-01-01").count() == 0


def test_compaction_reports_and_leaves_no_side_folders(spark, tmp_path):
    path = write_raw(tmp_path, rich(), bad=True)
    done = lake.compact(spark, path, force=True).collect()
    assert all(r["first_bad"] == 4 for r in done if r["bad"]) and sum(r["bad"] for r in done) > 0
    assert not [p.name for p in Path(path, "parquet").iterdir() if p.name.startswith("_new")]
    rows = {(r["table_name"], str(r["date"]), r["hour"]): r["n"] for r in lake.rows_filed(spark, path).collect()}
    assert sum(n for (t, *_), n in rows.items() if t == "market_opens") == lake.read_table(spark, path, "market_opens").count() > 0


def test_a_busy_hour_is_filed_in_parts_and_days_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "FILE_LINES", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be put together again
    day = 86_400_000
    path = write_raw(tmp_path, sorted(rich() + [(ns + day * 10**6, line) for ns, line in market_lines()], key=lambda x: x[0]))
    marked, calls = [], lake._compact_day
    monkeypatch.setattr(lake, "_compact_day", lambda *a: (marked.append(len(lake.compacted(spark, path))), calls(*a))[1])
    lake.compact(spark, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(marked) == 2 and marked[0] == 0 < marked[1]
    files = [len(list(p.glob("*.parquet"))) for p in Path(path, "parquet", "spot").glob("date=*/hour=*")]
    assert max(files) > 2 and raw.digest(lake.replay(spark, path)) == raw.digest(lake.replay(spark, path, parquet=True))


def test_replay_summary(spark, folder):
    events = lake.replay(spark, folder)
    one = book.replay_summary(events).first()
    assert one["events"] == len(rich()) and one["digest"] == book.replay_summary(lake.replay(spark, folder, parquet=True)).first()["digest"]
    stats = book.verified_books(events).collect()
    assert sum(one["kinds"].values()) == one["events"] and one["first_ts"] == min(x[0] for x in rich()) and one["late"] == 0
    assert one["markets"] == len(stats) and one["changes"] == sum(r["changes"] for r in stats)
    assert book.replay_summary(events.where("kind <> 'book_snapshot'")).first()["digest"] != one["digest"]


def test_encoding_round_trip(spark, folder):
    events = lake.replay(spark, folder)
    again = raw.events_of(raw.parsed(raw.encoded(events)))
    assert raw.digest(again) == raw.digest(events)


def test_views_and_ad_hoc_sql(spark, folder, tmp_path):
    got = lake.sql(spark, folder, "SELECT market_id, outcome, excluded, window_start_utc FROM markets WHERE market_id = :m OR slug = :m", m="0xabc").collect()
    assert [(r["market_id"], r["outcome"], r["excluded"]) for r in got] == [("0xabc", "UP", True)]
    assert got[0]["window_start_utc"] == datetime(2026, 9, 24, 21, 15)
    assert lake.sql(spark, str(tmp_path), "SELECT count(*) AS n FROM markets").first()["n"] == 0
    assert lake.replay(spark, str(tmp_path)).count() == 0 and lake.replay(spark, str(tmp_path), parquet=True).count() == 0


@pytest.mark.parametrize(
    "line,ok",
    [
        ('{"kind":"trade","exchangeTs":1,"recvTs":"1","token":"UP","payload":{"price":0.5,"size":1,"side":"BUY","feeRateBps":0,"txHash":""}}', True),
        ('{"kind":"trade","exchangeTs":1,"recvTs":"1","payload":{"price":1.5,"size":1,"side":"BUY","feeRateBps":0,"txHash":""}}', False),
        ('{"kind":"trade","exchangeTs":1,"recvTs":"1","token":"LEFT","payload":{"price":0.5,"size":1,"side":"BUY","feeRateBps":0,"txHash":""}}', False),
        ('{"kind":"trade","exchangeTs":1,"recvTs":"x","payload":{"price":0.5,"size":1,"side":"BUY","feeRateBps":0,"txHash":""}}', False),
        ('{"kind":"book_delta","exchangeTs":1,"recvTs":"1","payload":{"changes":[]}}', False),
        ('{"kind":"market_close","exchangeTs":1,"recvTs":"1","payload":{"windowEnd":100.0}}', True),
        ('{"kind":"market_close","exchangeTs":1,"recvTs":"1","payload":{"windowEnd":100.5}}', False),
        ('{"kind":"res_price","exchangeTs":1,"recvTs":"1","payload":{"source":"chainlink","symbol":"s","price":1,"scaled":"1x"}}', False),
        ('{"kind":"what","exchangeTs":1,"recvTs":"1","payload":{}}', False),
        ("null", False),
    ],
)
def test_validation(spark, line, ok):
    lines = spark.createDataFrame([(line,)], "value string").select(F.lit("2026-01-01").cast("date").alias("date"), F.lit(0).alias("hour"), F.lit(1).alias("line"), "value")
    assert raw.parsed(lines).first()["ok"] is ok


HEALTH = [
    ({}, 3_600_000, [""], False),
    ({}, 60_000, ["OPEN"], True),
    ({"holes": [(W0 + 100_000, W0 + 103_500)]}, 3_600_000, ["GAP"], True),
    ({"holes": [(W0 + 100_000, W0 + 101_000)]}, 3_600_000, [""], False),
    ({"holes": [(W0 - 50_000, W0 - 40_000)]}, 3_600_000, [""], None),
    ({"join_late_ms": 60_000}, 3_600_000, ["LATE"], True),
    ({"resolution": None}, 3_600_000, ["NORES"], True),
    ({"resolution": "DOWN"}, 3_600_000, ["SETTLE"], True),
    ({"price_to_beat": 84_000.5}, 3_600_000, [""], False),
    ({"price_to_beat": 84_002.0}, 3_600_000, ["TWAPΔ"], False),
    ({"p0": 84_000.0, "p1": 84_000.0}, 3_600_000, [""], False),
]


@pytest.mark.parametrize("options,after,flags,excluded", HEALTH)
def test_health(spark, options, after, flags, excluded):
    rows = [(n, line) for n, (_, line) in enumerate(market_lines(**options), 1)]
    lines = spark.createDataFrame(rows, "line int, value string").select(F.lit("2026-09-24").cast("date").alias("date"), F.lit(21).alias("hour"), "line", "value")
    got = market_health(raw.events_of(raw.parsed(lines)), W0, W0 + 1, W0 + after).collect()
    assert len(got) == 1
    for f in flags:
        assert (f in got[0]["flags"].split(",")) if f else not got[0]["flags"], got[0]
    if excluded is not None:
        assert got[0]["excluded"] is excluded
    if not options and after == 3_600_000:
        assert (got[0]["cl_ticks"], got[0]["s0"], got[0]["s1"], got[0]["our_outcome"], got[0]["s0_diff"]) == (900, 84_000.0, 84_010.0, "UP", 0.0)
    if options.get("join_late_ms"):
        assert abs(got[0]["late_sec"] - 60) < 0.1
    if "p1" in options and options["p1"] == options["p0"]:
        assert got[0]["our_outcome"] == "UP"


def test_book_fold_cases():
    b = book.Book()
    b.set("UP", "BUY", 0.30, 100)
    b.set("DOWN", "BUY", 0.69, 50)
    assert b.sides == {"BUY": {300_000: 100}, "SELL": {310_000: 50}} and b.best("DOWN") == (690_000, 700_000)
    b.replace("UP", [(0.31, 10), (0.30, 20)], [(0.33, 5)])
    b.set("UP", "SELL", 0.31, 22)
    assert b.prune("UP", 0.30, 0.31) == 1 and b.best() == (300_000, 310_000)
    b.replace("UP", [(0.5, 10), (0.2, 5)], [(0.51, 7)])
    assert b.difference("UP", [(0.5, 11), (0.19, 5)], [(0.51, 7)]) == (3, 1)
    b.replace("UP", [(0.2, 5), (0.5, 10)], [(0.51, 7)])
    assert b.text() == "b[200000:5,500000:10]a[510000:7]"


def test_fold_in_batches_and_streams_agrees(spark, folder, tmp_path):
    batch = {r["market_id"]: r for r in book.verified_books(lake.replay(spark, folder)).collect()}
    assert batch["0xabc"]["snapshots"] == 2 and batch["0xabc"]["closed"] and batch["0xabc"]["outcome"] == "UP"
    events = market_stream.event_stream(spark, folder, files_per_batch=1)
    q = market_stream.verified_books(events).writeStream.format("memory").queryName("books").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = {}
    for r in spark.sql("SELECT * FROM books").collect():
        if r["market_id"] not in last or r["changes"] >= last[r["market_id"]]["changes"]:
            last[r["market_id"]] = r
    for m in batch:
        for c in ("changes", "snapshots", "book", "levels_pruned", "bests_checked"):
            assert batch[m][c] == last[m][c], (m, c)
    q = market_stream.file_tables(market_stream.event_stream(spark, folder), str(tmp_path), str(tmp_path / "d"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "stream/trades")).count() == lake.read_table(spark, folder, "trades").count()


def test_recorded_hours_of_a_stream_hold_its_events(spark, folder, tmp_path):
    q = market_stream.record_hours(market_stream.event_stream(spark, folder, files_per_batch=1), str(tmp_path), str(tmp_path / "c"), late_ms=None)
    assert q.awaitTermination(120)
    texts = lambda events: sorted(r["text"] for r in raw.canonical(events).select("text").collect())
    got = market_stream.recorded_events(spark, str(tmp_path))
    assert texts(got) == texts(lake.replay(spark, folder))
    assert got.where("hour <> hour(timestamp_seconds(recv_ts div 1000000000))").isEmpty()


def messages(spark, texts, market="0xabc"):
    return spark.createDataFrame([(i, market, t, 5 * 10**15) for i, t in enumerate(texts)], "msg long, market_id string, value string, recv_ts long")


def test_order_book_messages(spark):
    markets = spark.createDataFrame([("0xabc", "u", "d")], "market_id string, up_token_id string, down_token_id string")
    change = lambda asset, side, price, size: {"asset_id": asset, "side": side, "price": price, "size": size, "best_bid": "0.3", "best_ask": ""}
    texts = [
        json.dumps([{"event_type": "book", "asset_id": "u", "timestamp": "7", "bids": [{"price": "0.3", "size": "1"}], "asks": [], "hash": "h"}, {"event_type": "book", "asset_id": "d", "timestamp": "7", "bids": [], "asks": [], "hash": "h"}]),
        json.dumps({"event_type": "price_change", "timestamp": "8", "price_changes": [change("d", "SELL", "0.7", "200"), change("u", "BUY", "0.3", "200"), change("x", "BUY", "0.3", "1")]}),
        json.dumps({"event_type": "price_change", "timestamp": "8", "price_changes": [change("d", "SELL", "0.7", "233"), change("u", "BUY", "0.3", "200")]}),
        json.dumps({"event_type": "last_trade_price", "asset_id": "d", "timestamp": "9", "price": "0.7", "size": "2", "side": "BUY"}),
        json.dumps({"event_type": "tick_size_change", "asset_id": "u", "timestamp": "9", "old_tick_size": "0.01", "new_tick_size": "0.001"}),
        json.dumps({"event_type": "novel", "timestamp": "9"}),
        "PONG",
    ]
    got = normalize.book_messages(messages(spark, texts), markets).orderBy("msg", "idx").collect()
    assert [r["kind"] for r in got] == ["book_snapshot", "book_delta", "book_delta", "trade", "tick_size_change", "venue_raw"]
    assert [c["token"] for c in got[1]["payload"]["changes"]] == ["UP"] and [c["token"] for c in got[2]["payload"]["changes"]] == ["UP", "DOWN"]
    assert got[1]["payload"]["changes"][0]["bestAsk"] is None and got[3]["payload"]["feeRateBps"] == 0
    events = normalize.book_messages(messages(spark, texts), markets)
    assert normalize.mirror_mismatches(events).first()["mismatches"] == 1
    assert normalize.book_messages(messages(spark, texts), markets, drop_mirrored=False).where("kind = 'book_snapshot'").count() == 2


def test_other_messages(spark):
    live = json.dumps({"topic": "crypto_prices_chainlink", "type": "update", "payload": {"symbol": "btc/usd", "timestamp": 5, "value": 1.5, "full_accuracy_value": "1500000000000000000"}})
    past = json.dumps({"topic": "crypto_prices", "type": "subscribe", "payload": {"symbol": "btc/usd", "data": [{"timestamp": 1, "value": 1.0}, {"timestamp": 2, "value": 1.1}]}})
    got = normalize.oracle_messages(messages(spark, [live, past, "PONG"], None), "btc/usd").orderBy("msg", "idx").collect()
    assert [(r["exchange_ts"], r["payload"]["scaled"], r["payload"]["backfill"]) for r in got] == [(5, "1500000000000000000", None), (1, None, True), (2, None, True)]
    quote = json.dumps({"stream": "x@bookTicker", "data": {"b": "1", "B": "2", "a": "3", "A": "4"}})
    trade = json.dumps({"stream": "x@aggTrade", "data": {"T": 77, "p": "1.5", "q": "2", "m": True}})
    a, b = normalize.stream_messages(messages(spark, [quote, trade], None)).orderBy("msg").collect()
    assert (a["exchange_ts"], a["payload"]["bidSize"], b["exchange_ts"], b["payload"]["side"]) == (5 * 10**9, 2.0, 77, "SELL")
    ticker = json.dumps({"type": "ticker", "time": "2026-01-01T00:00:00.123Z", "price": "5", "last_size": "1", "side": "buy", "best_bid": "4", "best_bid_size": "1", "best_ask": "6", "best_ask_size": "1"})
    a, b = normalize.ticker_messages(messages(spark, [ticker, '{"type":"x"}'], None)).orderBy("idx").collect()
    assert (a["payload"]["type"], b["payload"]["type"], a["exchange_ts"]) == ("trade", "bbo", 1767225600123)


def test_market_records(spark):
    record = {"slug": "s", "startTime": "2026-09-24T21:00:00Z", "endDate": "2026-09-24T21:15:00Z", "closed": True, "eventMetadata": {"priceToBeat": 84353.9, "finalPrice": 84274.8}, "markets": [{"conditionId": "0x1", "outcomes": '["Up", "Down"]', "clobTokenIds": '["u", "d"]', "outcomePrices": '["0", "1"]'}]}
    df = spark.createDataFrame([(json.dumps(record),), (json.dumps(record | {"closed": False, "endDate": "2026-09-24T21:30:00Z"}),)], "value string")
    assert [(r["market_id"], r["window_end"] - r["window_start"]) for r in normalize.market_records(df).collect()] == [("0x1", LENGTH_MS)]
    assert [r["outcome"] for r in normalize.resolutions(df).collect()] == ["DOWN"]


def test_silences_over_part_borders(spark):
    times = [0, 10, 500, 505, 490, 2000, 2001]
    df = spark.createDataFrame(list(enumerate(times)), "n long, t long")
    for size in (1, 2, 100):
        got = sorted((r["start"], r["end"]) for r in gaps.silences(df, "t", ["n"], F.expr(f"n div {size}"), 100).collect())
        assert got == [(10, 500), (505, 2000)]
