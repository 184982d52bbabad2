"""Books checked as intervals against the fold, on random streams of every turn a book can take."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import book, verify
from tidebook.sources import raw


def random_lines(seed: int, markets: int, n: int, levels: int) -> list[str]:
    rng, price = random.Random(seed), lambda: rng.randrange(1, levels) / levels
    out = []
    for i in range(n):
        kind = rng.choices(["book_delta", "book_snapshot", "feed_gap", "market_open", "trade", "market_close", "resolution", "tick_size_change"], [60, 5, 2, 2, 3, 1, 1, 1])[0]
        token = rng.choice(["UP", "DOWN", None])
        if kind == "book_delta":
            best = lambda: rng.choice([None, 0.0, 1.0, *[price() for _ in range(6)]])
            payload = {"changes": [{"token": rng.choice(["UP", "DOWN"]), "side": rng.choice(["BUY", "SELL"]), "price": price(), "size": rng.choice([0, 0, 1, 2.5, 1 / 3]), "bestBid": best(), "bestAsk": best()} for _ in range(rng.randrange(1, 4))]}
        elif kind == "book_snapshot":
            side = lambda: [{"price": price(), "size": rng.choice([0, 1, 2.5, 7])} for _ in range(rng.randrange(5))]
            payload = {"bids": side(), "asks": side(), "hash": "h"}
        elif kind == "market_open":
            payload = {"slug": "s", "upTokenId": "u", "downTokenId": "d", "windowStart": 0, "windowEnd": 900000, "tickSize": 0.01, "minOrderSize": 5, "feeSchedule": {"rate": 0.1, "exponent": 1, "takerOnly": True, "rebateRate": 0.2}}
        else:
            payload = {
                "feed_gap": {"feed": "clob", "gapMs": 5, "reason": "silence"}, "trade": {"price": 0.5, "size": 1, "side": "BUY", "feeRateBps": 0, "txHash": ""}, "market_close": {"windowEnd": 1},
                "resolution": {"outcome": rng.choice(["UP", "DOWN"]), "priceToBeat": 1, "finalPrice": 2}, "tick_size_change": {"oldTickSize": 0.01, "newTickSize": 0.001},
            }[kind]
        event = {"kind": kind, "marketId": f"m{rng.randrange(markets)}", "token": token, "exchangeTs": i, "recvTs": str(i * 10**6), "payload": payload}
        out.append(json.dumps({k: v for k, v in event.items() if v is not None}))
    return out


def events(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines, 1)), "line int, value string").select(F.lit("2026-01-01").cast("date").alias("date"), F.expr("line div 300").cast("int").alias("hour"), "line", "value")
    return raw.events_of(raw.parsed(rows))


@pytest.mark.parametrize("seed, markets, n, levels, fan", [(1, 6, 900, 8, 64), (2, 1, 600, 5, 4), (3, 3, 300, 40, 3)])
def test_intervals_equal_the_fold(spark, seed, markets, n, levels, fan, monkeypatch):
    monkeypatch.setattr(verify, "FAN", fan)  # small: ranges over many tiers
    e = events(spark, random_lines(seed, markets, n, levels))
    columns = ["market_id", *(c.split()[0] for c in book.STATS.split(", ")), "book", "synced", "closed", "outcome"]
    want = sorted(tuple(r[c] for c in columns) for r in book.verified_books(e).collect())
    got = sorted(tuple(r[c] for c in columns) for r in verify.verified_books(e).collect())
    assert got == want
    sums = {c: sum(r[i] for r in want) for i, c in enumerate(columns[:10]) if i}
    assert all(sums.values()) and sums["best_mismatches"] < sums["bests_checked"], sums


def test_no_events(spark):
    e = events(spark, random_lines(1, 1, 5, 5)).limit(0)
    assert verify.verified_books(e).count() == 0


def test_a_snapshot_without_a_token_is_of_up_and_a_first_open_keeps_step(spark):
    level = lambda p, s: {"price": p, "size": s}
    lines = [
        {"kind": "book_snapshot", "marketId": "m", "payload": {"bids": [level(0.3, 10)], "asks": [level(0.52, 5)], "hash": "h"}},
        {"kind": "market_open", "marketId": "m", "payload": {"slug": "s", "upTokenId": "u", "downTokenId": "d", "windowStart": 0, "windowEnd": 900000, "tickSize": 0.01, "minOrderSize": 5, "feeSchedule": {"rate": 0.1, "exponent": 1, "takerOnly": True, "rebateRate": 0.2}}},
        {"kind": "book_delta", "marketId": "m", "payload": {"changes": [{"token": "UP", "side": "BUY", "price": 0.4, "size": 1, "bestBid": 0.3, "bestAsk": 0.52}]}},
    ]
    e = events(spark, [json.dumps({**x, "exchangeTs": i, "recvTs": str(i)}) for i, x in enumerate(lines)])
    for found in (book.verified_books(e).first(), verify.verified_books(e).first()):
        assert (found["book"], found["synced"], found["levels_pruned"], found["best_mismatches"], found["unsynced_changes"]) == ("b[300000:10]a[520000:5]", True, 1, 0, 0)
