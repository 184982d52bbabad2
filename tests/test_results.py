from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import analytics as A
from tidebook.operators import results as sim


def test_scalars(spark):
    row = spark.range(1).select(
        S.half_up(F.lit(-2.5)).alias("a"), S.taker_fee(F.lit(100.0), F.lit(0.5), F.lit(0.07), F.lit(1.0)).alias("b"), S.taker_fee(F.lit(1.0), F.lit(0.001), F.lit(0.07), F.lit(1.0)).alias("c"),
        S.taker_fee(F.lit(0.01), F.lit(0.001), F.lit(0.07), F.lit(1.0)).alias("d"), S.maker_rebate(F.lit(1.0), F.lit(0.0), F.lit(5.0), F.lit(0.2)).alias("e"), S.maker_rebate(F.lit(1.0), F.lit(1.0), F.lit(1.75), F.lit(0.2)).alias("f"),
        S.same_price(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("g"), S.same_price(F.lit(None).cast("double"), F.lit(1.0)).alias("h"), S.fnv1a(F.lit("foobar")).alias("i"), S.window_start(F.lit(1790284047938), 900_000).alias("j"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"], row["g"], row["h"], row["i"], row["j"]) == (-2, 1.75, 0.00007, 0.0, 0.0, pytest.approx(0.35), True, False, 0xBF9CF968, 1790283600000)


def test_parts_add_up(spark):
    df = spark.createDataFrame([("BUY", 0.4, 10.0, 0.5, 0.45, 1.0), ("SELL", 0.6, 5.0, 0.5, 0.55, 1.0)], "side string, price double, size double, fair double, later double, y double")
    for r in sim.decomposed(df, "later", "y").collect():
        assert abs(r["spread"] + r["adverse"] + r["inventory"] - r["total"]) < 1e-9 and r["spread"] > 0 > r["adverse"]


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, -3, 4)], "pnl double")
    r = sim.core_stats(df, "pnl").first()
    assert (r["markets"], r["net"], r["hit_rate"], r["median"]) == (4, 4.0, 0.75, 1.5) and r["win_loss"] == pytest.approx((7 / 3) / 3)
    stats = spark.createDataFrame([(2_000, 0.1, 3.0, 10.0, 100.0, 0.2, 0.2)], "markets long, low double, t double, drawdown double, bankroll double, brier double, brier_mid double")
    assert all(r["holds"] for r in sim.go_no_go(stats).collect())
    days = spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "day long, pnl double")
    a, b = (A.block_bootstrap(days, "day", "pnl", 500, 7).first() for _ in range(2))
    assert a == b and a["low"] < a["median"] < a["high"] and a["above_zero"] == 1.0
    cdf = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 0.5, 2.0)], "x double").select(A.normal_cdf(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in cdf] == pytest.approx([0.00134990, 0.15865525, 0.5, 0.69146246, 0.97724987], abs=1e-6)


def test_volatility_of_odd_prices_and_long_series(spark):
    """A price that is zero, negative or null gives no return; weights stay finite over thousands of half-lives."""
    prices = [1.0, 2.0, 0.0, 4.0, 8.0, None, -1.0, 3.0, 6.0] + [6.0 * 2 ** (i % 2) for i in range(3_000)]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(prices)], "k int, t int, p double")
    got = {r["t"]: r["vol"] for r in A.ewma_volatility(df, ["k"], "t", "p", 1.0).collect()}
    squares = [None] + [__import__("math").log(b / a) ** 2 if a and b and a > 0 and b > 0 else None for a, b in zip(prices, prices[1:])]
    for t in (0, 1, 2, 4, 6, 8, 399, 400, 401, 900, 3_008):
        own = [(x, 0.5 ** (t - i)) for i, x in enumerate(squares[: t + 1]) if x is not None and t - i < 1_000]
        want = (sum(x * w for x, w in own) / sum(w for _, w in own)) ** 0.5 if own else None
        assert got[t] == (None if want is None else pytest.approx(want, rel=1e-9)), t
