"""Live state: stages by timers, the last row equal to the batch fold, nothing left in the state; feeds' gaps and alerts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidebook.operators import book
from tidebook.sources import raw
from tidebook.sources.synthetic import LENGTH_MS, WINDOW_START, market_lines
from tidebook.streaming import market_state

W0, END = WINDOW_START, WINDOW_START + LENGTH_MS


def parsed(lines):
    return raw.events_of(raw.parsed(lines.select(F.lit("2026-09-24").cast("date").alias("date"), F.lit(21).alias("hour"), "line", "value")))


def streamed(spark, tmp_path, batches, make):
    """Rows that a stream over batches of lines makes, one batch after the other, and its checkpoint."""
    kind, source, out, checkpoint = "line int, value string", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    for lines in batches:
        spark.createDataFrame([(i, x) for i, (_, x) in enumerate(lines, 1)], kind).coalesce(1).write.mode("append").parquet(source)
        found = market_state.run_all(make(parsed(spark.readStream.schema(kind).parquet(source))), out, checkpoint)
    return found.collect(), checkpoint


def left(spark, checkpoint, key):
    with market_state.state_store(spark):
        return {r["key"][key] for r in spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint).collect()}


def later(ms, market="0xlater"):
    e = {"kind": "book_delta", "marketId": market, "exchangeTs": ms, "recvTs": str(ms * 10**6), "payload": {"changes": [{"token": "UP", "side": "BUY", "price": 0.5, "size": 1, "bestBid": 0.5}]}}
    return ms * 10**6, json.dumps(e)


def test_a_resolved_market_is_handed_out_whole_and_forgotten(spark, tmp_path):
    lines = market_lines()
    snapshot = {"kind": "book_snapshot", "marketId": "0xabc", "exchangeTs": W0, "recvTs": str((W0 + 5_001) * 10**6), "payload": {"bids": [{"price": 0.5, "size": 3}, {"price": 0.52, "size": 1}], "asks": [{"price": 0.51, "size": 2}], "hash": "h"}}
    lines = sorted([*lines, ((W0 + 5_001) * 10**6, json.dumps(snapshot))], key=lambda x: x[0])
    half = len(lines) // 2
    rows, checkpoint = streamed(spark, tmp_path, [lines[:half], lines[half:], [later(END + 10**6)], [later(END + 2 * 10**6)]], lambda e: market_state.markets(e, late="1 second"))
    own = [r for r in rows if r["market_id"] == "0xabc"]
    assert sorted({r["event"] for r in own}) == ["resolved", "update"] and sum(r["event"] == "resolved" for r in own) == 1
    last = next(r for r in own if r["event"] == "resolved")
    want = book.verified_books(parsed(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(lines, 1)], "line int, value string"))).first()
    for c in ("book", "synced", "closed", "outcome", *(c.split()[0] for c in book.STATS.split(", "))):
        assert last[c] == want[c], c
    assert last["levels_pruned"] == 1 and last["events"] == sum('"marketId": "0xabc"' in x for _, x in lines)
    assert left(spark, checkpoint, "market_id") == {"0xlater"}


def test_an_unresolved_market_goes_through_its_stages_and_is_given_up(spark, tmp_path):
    steps = [later(END + ms) for ms in (10_000, 40_000, 200_000, 3_700_000, 3_800_000)]
    batches = [[x for x in market_lines(resolution=None) if x[0] < END * 10**6], *[[s] for s in steps]]
    rows, checkpoint = streamed(spark, tmp_path, batches, lambda e: market_state.markets(e, late="1 second"))
    own = [(r["event"], r["at_ms"]) for r in rows if r["market_id"] == "0xabc" and r["event"] != "update"]
    assert sorted(own, key=lambda x: x[1]) == [("closed", END), ("awaiting", END + 30_000), ("given_up", END + 3_600_000)]
    assert left(spark, checkpoint, "market_id") == {"0xlater"}


def test_feeds_report_gaps_once_and_say_when_they_are_silent(spark, tmp_path):
    quote = lambda ms, source: (ms * 10**6, json.dumps({"kind": "spot", "exchangeTs": ms, "recvTs": str(ms * 10**6), "payload": {"type": "bbo", "source": source, "bid": 1, "bidSize": 1, "ask": 2, "askSize": 1}}))
    gap = (W0 * 10**6, json.dumps({"kind": "feed_gap", "exchangeTs": W0, "recvTs": str((W0 + 500) * 10**6), "payload": {"feed": "spot:binance", "gapMs": 700, "reason": "reconnect"}}))
    batches = [[quote(W0, "binance"), gap, quote(W0 + 1_000, "binance"), quote(W0 + 15_000, "binance")], [quote(W0 + 100_000, "coinbase")], [quote(W0 + 101_000, "coinbase")], [quote(W0 + 102_000, "binance")]]
    rows, _ = streamed(spark, tmp_path, batches, lambda e: market_state.feeds(e, late="1 second"))
    own = sorted([(r["at_ms"] - W0, r["event"], r["gap_ms"]) for r in rows if r["feed"] == "spot:binance" and r["event"] != "counters"])
    assert own == [(15_000, "gap", 14_000), (75_000, "silent", 60_000), (102_000, "gap", 87_000), (102_000, "recovered", 87_000)]
    last = max((r for r in rows if r["feed"] == "spot:binance" and r["event"] == "counters"), key=lambda r: r["events"])
    assert (last["events"], last["gaps"], last["reconnects"], last["max_gap_ms"]) == (4, 1, 1, 700.0)
