"""Accounts against plain loops, cut into slices of any length."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import accounts, sketches


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_merged_ledger(spark, size):
    rng = random.Random(size)
    trades = [(rng.randrange(3), i, rng.choice(["UP", "DOWN"]), rng.randrange(-3, 6), rng.randrange(-50, 50), rng.randrange(3)) for i in range(120)]
    df = spark.createDataFrame(trades, "m long, i long, token string, shares long, flow long, fee long")
    got = accounts.merged_ledger(df, ["m"], ["i"], F.expr(f"i div {size}"))
    legs, want = {}, []
    for m, i, token, shares, flow, fee in trades:
        s = legs.setdefault(m, {"UP": 0, "DOWN": 0, "cash": 0, "merged": 0, "fees": 0})
        s[token] += shares
        s["cash"] += flow - fee
        s["fees"] += fee
        pairs = max(0, min(s["UP"], s["DOWN"]))
        s["UP"], s["DOWN"], s["cash"], s["merged"] = s["UP"] - pairs, s["DOWN"] - pairs, s["cash"] + 100 * pairs, s["merged"] + pairs
        want.append((m, i, s["cash"], s["UP"], s["DOWN"], s["merged"], s["fees"]))
    assert sorted(tuple(r) for r in got.select("m", "i", "cash", "up", "down", "merged", "fees").collect()) == sorted(want)
    plain = accounts.merged_ledger(df, ["m"], ["i"], F.expr(f"i div {size}"), merge=False).agg(F.max("merged"), F.max("i")).first()
    assert tuple(plain) == (0, 119)
    outcomes = spark.createDataFrame([(0, "UP"), (1, "DOWN")], "m long, outcome string")
    ends = {r["m"]: r for r in accounts.settled(got, outcomes, ["m"], F.col("i")).collect()}
    assert ends[0]["result"] == legs[0]["cash"] + 100 * legs[0]["UP"] and ends[1]["payout"] == 100 * legs[1]["DOWN"] and ends[2]["result"] is None


@pytest.mark.parametrize("size", [2, 1000])
def test_drawdown_episodes(spark, size):
    rng = random.Random(size)
    pnl = [rng.randrange(-5, 6) for _ in range(200)]
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(pnl)], "k long, i long, p long")
    want, equity, peak, start, high_at, low = [], 0, 0, None, -1, None
    for i, p in enumerate(pnl):
        equity += p
        if equity >= peak:
            if low:
                want.append((start, low[1], i, peak - low[0], low[1] - high_at, i - low[1]))
            peak, start, high_at, low = equity, i, i, None
        elif low is None or equity < low[0]:
            low = (equity, i)
    if low:
        want.append((start, low[1], None, peak - low[0], low[1] - high_at, None))
    got = accounts.drawdown_episodes(df, ["k"], "i", "p", F.expr(f"i div {size}"))
    assert sorted(map(str, (tuple(r) for r in got.drop("k").collect()))) == sorted(map(str, want)) and len(want) > 3
    assert accounts.drawdown_episodes(df.limit(0), ["k"], "i", "p", F.lit(0)).count() == 0


def test_uptime_and_unions(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.randrange(2), a, a + rng.randrange(0, 12)) for a in (rng.randrange(100) for _ in range(n))]
    b, a, e = make(12), make(12), make(9)
    frame = lambda rows: spark.createDataFrame(rows, "k long, s long, t long")
    covered = lambda rows, k: {x for key, s, t in rows if key == k for x in range(s, t)}
    for r in accounts.both_live(frame(b), frame(a), frame(e), ["k"], "s", "t").collect():
        own = covered(e, r["k"])
        assert (r["eligible_ms"], r["live_ms"]) == (len(own), len(own & covered(b, r["k"]) & covered(a, r["k"])))
    union = [tuple(r) for r in accounts.united(frame(b), ["k"], "s", "t").collect()]
    assert all(covered(union, k) == covered(b, k) for k in (0, 1)) and all(not (x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]) for x in union for y in union if x != y)


def test_a_spike_is_told_from_a_plateau(spark):
    rows = [("flat", x, y, 100 - abs(x - 3) - abs(y - 3)) for x in range(7) for y in range(7)] + [("spike", x, y, 100 if (x, y) == (2, 2) else 10) for x in range(5) for y in range(5)] + [("alone", 0, 0, 5), ("alone", 4, 4, 1)]
    got = {r["k"]: r for r in accounts.plateau(spark.createDataFrame(rows, "k string, x long, y long, r long"), ["k"], ["x", "y"], "r").collect()}
    assert (got["flat"]["x"], got["flat"]["spike"], got["flat"]["neighbours"], got["flat"]["tries"]) == (3, False, 8, 49)
    assert got["spike"]["spike"] and got["spike"]["near_mean"] == 10 and got["alone"]["spike"] and got["alone"]["neighbours"] == 0


def test_sketches_of_hours_merge_to_those_of_a_range(spark, tmp_path):
    e = spark.range(40_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 24).alias("hour"), (F.col("id") * 7919 % 10_007).alias("v"))
    stored = sketches.store(e, ["k"], "hour", str(tmp_path / "s"), distinct={"d": F.col("v")}, quantiles={"q": F.col("v")})
    assert stored.count() == 24
    for hours in (range(24), range(3, 9)):
        rows = {r["k"]: r for r in sketches.merged(stored.where(F.col("hour").isin(list(hours))), ["k"], ["d"], {"q": [0.1, 0.5, 0.99]}).collect()}
        for k in (0, 1):
            own = sorted(r["v"] for r in e.where((F.col("k") == k) & F.col("hour").isin(list(hours))).collect())
            assert abs(rows[k]["d"] - len(set(own))) <= sketches.DISTINCT_ERROR * len(set(own))
            for x, q in zip(rows[k]["q"], (0.1, 0.5, 0.99)):
                assert abs(sum(v <= x for v in own) / len(own) - q) <= sketches.RANK_ERROR
