from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import bands, keyed, lifecycle


def test_calendar_and_stages(spark):
    got = lifecycle.calendar(spark, 1_790_284_500_000, 1_790_284_500_000 + 3 * 900_000).orderBy("window_start").collect()
    assert [r["window_start"] for r in got] == [1_790_284_500_000 + i * 900_000 for i in range(3)] and got[0]["slug"] == "m-1790284500"
    assert lifecycle.calendar(spark, 5, 5).count() == 0
    windows = lifecycle.calendar(spark, 0, 10 * 900_000).withColumn("resolved", F.col("window_start") == 900_000)
    stages = {r["window_start"] // 900_000: r["stage"] for r in lifecycle.standing(windows, 5 * 900_000 + 10_000).collect()}
    assert stages == {0: "given_up" if 4 * 900_000 + 10_000 >= 3_600_000 else "awaiting", 1: "resolved", 2: "awaiting", 3: "awaiting", 4: "closed", 5: "open", 6: "future", 7: "future", 8: "future", 9: "future"}


def test_day_report(spark):
    health = spark.createDataFrame([("a", 10, "", False), ("b", 20, "GAP,NORES", True), ("c", 99, "OPEN", True)], "market_id string, window_end long, flags string, excluded boolean")
    assert {r["item"]: r["n"] for r in lifecycle.day_report(health, 50).collect()} == {"markets": 3, "closed": 2, "usable": 1, "GAP": 1, "NORES": 1, "OPEN": 1}


def test_reference_price_is_exact(spark):
    boundary, price = 1_790_284_500_000, 84_326_699_345_314_850_000_000
    ticks = [(boundary - 62_000 + 1_000 * i, i, str(price + i)) for i in range(76)] + [(boundary - 62_000, 99, "1")]
    df = spark.createDataFrame(ticks, "ts long, ord int, scaled string").withColumn("scaled", F.col("scaled").cast("decimal(38,0)"))
    at = spark.createDataFrame([(boundary,), (boundary + 10**9,)], "boundary long")
    a, b = bands.twap(df, at, -62_000, -3_000).orderBy("boundary").collect()
    assert (a["ticks"], a["expected"], int(a["mean_scaled"])) == (60, 60, price + 29) and abs(a["mean"] - 84326.69934531485) < 1e-9
    assert (b["ticks"], b["mean"]) == (0, None)
    assert bands.twap(df.where(F.col("ord") != 5), at, -62_000, -3_000).orderBy("boundary").first()["ticks"] == 59


def test_overlaps_are_met_once(spark):
    a = spark.createDataFrame([(0, 100), (50, 55), (100, 120), (-30, -10)], "s long, e long")
    b = spark.createDataFrame([(1, 40, 60), (2, 100, 110), (3, -20, 200)], "id int, ws long, we long")
    for width in (7, 1_000):
        got = sorted((r["id"], r["s"]) for r in bands.overlaps(a, ("s", "e"), b, ("ws", "we"), width).collect())
        assert got == [(1, 0), (1, 50), (2, 100), (3, -30), (3, 0), (3, 50), (3, 100)]


def test_as_of_and_first_rows(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 3, 30), ("a", 5, 50)], "k string, t long, v long")
    got = {(r["k"], r["t"]): r["v"] for r in keyed.asof(left, right, ["k"], "t", "v").collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 5): None}
    assert {(r["k"], r["t"]): r["v"] for r in keyed.asof(left, right, ["k"], "t", "v", tie=1).collect()}[("a", 5)] == 30
    assert keyed.first_per_key(right, ["k"], ["t"]).first()["v"] == 30 and keyed.last_per_key(right, ["k"], ["t"]).first()["v"] == 50


def test_report_lines(spark):
    kind = "window_start long, deltas long, trades long, snapshots long, late_sec double, clob_hole_ms long, rec_hole_ms long, feed_gap_ms double, cl_ticks long, our_outcome string, s0_diff double, s1_diff double, flags string, excluded boolean"
    rows = [(1_790_284_500_000, 1_987, 3, 2, 0.04, 500, 250, 0.0, 900, "UP", 0.0, None, "", False), (1_790_285_400_000, 123_456_789, None, None, None, None, None, None, 0, None, None, None, "GAP,NORES", True)]
    lines = [r["line"] for r in lifecycle.report_lines(spark.createDataFrame(rows, kind), 900).orderBy("window_start").collect()]
    assert lines[0].split() == ["21:15", "1987", "3", "2", "0.0", "500", "250", "0", "900/900", "UP", "0.000000000", "-"]
    assert lines[1].split() == ["21:30", "123456789", *["-"] * 6, "0/900", "-", "-", "-", "yes", "GAP,NORES"]
    assert lifecycle.report_lines(spark.createDataFrame([], kind), 900).count() == 0
