"""The gate of sanity checks, thinned lines, settings and the day's report."""

from __future__ import annotations

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from tidebook import config
from tidebook.operators import checks, lifecycle

SETTINGS = {
    "market": {"coin": "btc", "durationSec": 900, "slugPrefix": "m"},
    "venue": {"tickSize": 0.01, "minOrderSize": 5, "feeSchedule": {"rate": 0.07, "exponent": 1, "takerOnly": True, "rebateRate": 0.2}},
    "settlement": {"tieGoesTo": "down", "twapWindow": {"fromSec": -62, "toSec": -3}, "twapToleranceUsd": 1, "mergePairs": True},
    "recorder": {"dataDir": "data", "postCloseGraceSec": 30, "resolutionGiveUpSec": 3600, "maxGapMs": 2000, "silenceMs": {"clob": 1, "rtds": 2, "binance": 3, "coinbase": 4}, "dropMirrored": True, "spotSources": ["binance"]},
    "fairValue": {"volHalfLivesSec": [60, 600], "spotInput": "spot_mid"},
}


def test_the_gate_names_what_breaks_it(spark):
    rows = spark.createDataFrame([(i, 1.0, -0.5, 0.25, 0.75 if i != 7 else 0.8, i) for i in range(100)], "id long, spread double, adverse double, inventory double, total double, x long")
    every = F.lit(True)
    found = checks.gate([checks.row_checks(rows, F.col("id"), {"identity": checks.identity(rows), "most": (every, F.col("x") > 2, 0.9), "none": (F.col("x") < 0, F.lit(False), 1.0)}), checks.deterministic("same", rows, rows.repartition(3), ["id"]), checks.deterministic("other", rows, rows.where("id <> 4"), ["id"]), checks.zero_strategy(rows, rows.where("id > 1"), ["id"])])
    got = {r["check"]: (r["rows"], r["broken"], r["holds"], r["witness"]) for r in found.collect()}
    assert got == {"identity": (100, 1, False, "7"), "most": (100, 3, True, "0"), "none": (0, 0, True, None), "same": (100, 0, True, None), "other": (100, 1, False, "4"), "zero strategy": (100, 2, False, "0")}
    with pytest.raises(checks.Failed, match="identity: 1 of 100, first 7"):
        checks.enforce(found)
    checks.enforce(found.where("holds"))


def test_a_thinned_line_keeps_each_columns_ends_and_extremes(spark):
    rng = random.Random(1)
    points = [(k, x, rng.randrange(1000)) for k in "ab" for x in range(0, 5000, 3)]
    got = checks.thinned(spark.createDataFrame(points, "k string, x long, y long"), ["k"], "x", "y", 20).collect()
    assert {(r["k"], r["x"], r["y"]) for r in got} <= set(points) and len(got) <= 2 * 20 * 4
    for k in "ab":
        own, high = [p for p in points if p[0] == k], max(p[1] for p in points)
        for c in range(20):
            column = [p[1:] for p in own if min(int(p[1] / (high / 20)), 19) == c]
            kept = [(r["x"], r["y"]) for r in got if r["k"] == k and r["pixel"] == c]
            assert min(column) in kept and max(column) in kept and {min(y for _, y in column), max(y for _, y in column)} <= {y for _, y in kept}
    assert checks.thinned(spark.createDataFrame([(5, 1)], "x long, y long"), [], "x", "y", 3).count() == 1


def test_settings(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps(SETTINGS, indent=1))
    got = config.load(spark, str(path))
    rules = got.health_rules()
    assert (rules.length_ms, rules.twap_first_ms, rules.tie, rules.max_gap_ms) == (900_000, -62_000, "DOWN", 2000)
    assert got.market_processor().give_up_ms == 3_600_000 and got.feed_processor("coinbase").silence_ms == 4
    bad = copy.deepcopy(SETTINGS)
    bad["market"]["durationSec"], bad["settlement"]["tieGoesTo"], bad["recorder"]["spotSources"] = 1.5, "left", []
    del bad["fairValue"]
    with pytest.raises(config.Invalid) as e:
        config.validated(bad)
    assert all(x in str(e.value) for x in ("market.durationSec", "settlement.tieGoesTo", "recorder.spotSources", "fairValue.volHalfLivesSec is missing")) and "venue" not in str(e.value)
    bad = copy.deepcopy(SETTINGS)
    bad["settlement"]["twapWindow"] = {"fromSec": 0, "toSec": -3}
    with pytest.raises(config.Invalid, match="fromSec"):
        config.validated(bad)


def test_the_days_report(spark):
    kind = "window_start long, deltas long, trades long, snapshots long, late_sec double, clob_hole_ms long, rec_hole_ms long, feed_gap_ms double, cl_ticks long, our_outcome string, s0_diff double, s1_diff double, excluded boolean, flags string"
    health = spark.createDataFrame([(900_000, 5, 1, 2, 0.5, 10, 0, 0.0, 900, "UP", 0.1, None, False, ""), (0, 3, 0, 0, None, 0, 0, 0.0, 0, None, None, None, True, "NOCLOB,NORES"), (1_800_000, 1, 0, 0, None, 0, 0, 0.0, 0, None, None, None, True, "OPEN")], kind)
    events = spark.createDataFrame([("trade",)] * 2 + [("spot",)], "kind string")
    got = [r["line"] for r in lifecycle.report_text(health, events, "2026-01-01", 900, bad_lines=4).collect()]
    assert got[0] == "2026-01-01: 3 events read, 4 bad lines  spot 1, trade 2" and got[1].split()[0] == "window" and len(got) == 7
    assert [x.split()[0] for x in got[2:5]] == ["00:00", "00:15", "00:30"] and got[5] == "markets: 3/96 recorded, 2 closed, 1 usable" and got[6] == "flags: NOCLOB 1, NORES 1, OPEN 1"
    assert len(lifecycle.report_text(health.limit(0), events.limit(0), "2026-01-01", 900).collect()) == 4
