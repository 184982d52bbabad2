"""Results of fills and markets: the parts of each fill's result, statistics over markets, go or no go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decomposed(found: DataFrame, later: str, outcome: str) -> DataFrame:
    """found with the parts of each fill's result: spread + adverse + inventory = total, all times size.

    later names the fair value some seconds after the fill, outcome the settlement (0 or 1).
    """
    d = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0) * F.col("size")
    return found.select(
        "*", (d * (F.col(outcome) - F.col("price"))).alias("total"), (d * (F.col("fair") - F.col("price"))).alias("spread"),
        (d * (F.col(later) - F.col("fair"))).alias("adverse"), (d * (F.col(outcome) - F.col(later))).alias("inventory"),
    )


def core_stats(results: DataFrame, pnl: str, shares: str | None = None) -> DataFrame:
    """One row over markets (one result each): spread of results, hit rate, win to loss, with shares the edge of one.

    What has no rows to stand on, as win to loss without a loss, is null.
    """
    edge = [] if shares is None else [F.try_divide(F.sum(pnl), F.sum(shares)).alias("edge")]
    p = F.percentile(pnl, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    s = results.agg(
        F.count(F.lit(1)).alias("markets"), F.sum(pnl).alias("net"), F.avg(pnl).alias("mean"), F.stddev_samp(pnl).alias("sd"), F.skewness(pnl).alias("skew"), p.alias("p"),
        F.avg((F.col(pnl) > 0).cast("double")).alias("hit_rate"), F.try_divide(F.avg(F.when(F.col(pnl) > 0, F.col(pnl))), -F.avg(F.when(F.col(pnl) < 0, F.col(pnl)))).alias("win_loss"),
        *edge,
    )
    return s.select("markets", "net", "mean", "sd", "skew", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p5", "median", "p95"))], "hit_rate", "win_loss", *(["edge"] if edge else []))


def go_no_go(stats: DataFrame, least_markets: int = 2_000, least_t: float = 2.5) -> DataFrame:
    """(criterion, holds) of one row with markets, low (of the edge's interval), t, drawdown, bankroll, brier, brier_mid."""
    rules = {
        "sample": F.col("markets") >= least_markets, "edge": (F.col("low") > 0) & (F.col("t") >= least_t),
        "drawdown": F.col("drawdown") < 0.2 * F.col("bankroll"), "calibration": F.col("brier") <= 1.01 * F.col("brier_mid"),
    }
    each = F.array(*[F.struct(F.lit(n).alias("criterion"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in rules.items()])
    return stats.select(F.explode(each).alias("c")).select("c.*")
