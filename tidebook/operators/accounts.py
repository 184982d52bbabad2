"""Accounts of a market and results over time: ledgers with merged pairs, settlement, drawdown episodes, quote uptime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], order: list[str], part: Column, how: str, columns: dict[str, Column]) -> DataFrame:
    """rows with the running sum or max (how) of each named column over all rows of the keys so far, its own included.

    part is a whole number that cuts a key's rows, in their order, into slices: windows run inside slices, and what
    earlier slices come to is carried over their borders, so a key of any length is many tasks' work.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    join = (lambda a, b: a + F.coalesce(b, F.lit(0))) if how == "sum" else F.greatest
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = rows.withColumn("_part", part).withColumns({f"_{n}": c for n, c in columns.items()})
    own = own.withColumns({f"_in_{n}": fold(f"_{n}").over(inside) for n in columns})
    totals = own.groupBy(*keys, "_part").agg(*[fold(f"_{n}").alias(f"_all_{n}") for n in columns])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, "_part", *[fold(f"_all_{n}").over(before).alias(f"_carry_{n}") for n in columns])
    met = own.join(carried, [*keys, "_part"])
    return met.select(*rows.columns, *[join(F.col(f"_in_{n}"), F.col(f"_carry_{n}")).alias(n) for n in columns])


def merged_ledger(trades: DataFrame, keys: list[str], order: list[str], part: Column, merge: bool = True) -> DataFrame:
    """trades (keys, order, token, shares, flow, fee) with cash, up, down, merged and fees after each of them.

    shares are bought (above zero) or sold, flow is the cash they bring or cost, in units of which a pair of UP and DOWN
    is worth PAIR. With merge, pairs are turned into cash as soon as both legs are held: all that were ever merged are
    the largest of the smaller legs so far, counted without merging; what they free is in the cash from there on.
    """
    leg = lambda t: F.when(F.col("token") == t, F.col("shares")).otherwise(0)
    legs = running(trades, keys, order, part, "sum", {"_up": leg("UP"), "_down": leg("DOWN"), "_flow": F.col("flow"), "fees": F.col("fee")})
    if merge:
        legs = running(legs, keys, order, part, "max", {"_most": F.least("_up", "_down")})
    merged = F.greatest(F.col("_most"), F.lit(0)) if merge else F.lit(0)
    out = legs.withColumn("merged", merged.cast("long"))
    return out.select(*trades.columns, (F.col("_flow") - F.col("fees") + F.col("merged") * PAIR).alias("cash"), (F.col("_up") - F.col("merged")).alias("up"), (F.col("_down") - F.col("merged")).alias("down"), "merged", "fees")


#: What a pair is worth in the units of flow: cents.
PAIR = 100


def settled(ledger: DataFrame, outcomes: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """One row for each of the keys: what is left of the ledger's last row (by `last`) at settlement.

    outcomes: (keys, outcome). A share of the outcome pays PAIR, one of the other side nothing; without an outcome the
    payout is null, and the row stays.
    """
    end = ledger.groupBy(*keys).agg(F.max_by(F.struct("cash", "up", "down", "merged", "fees"), last).alias("l")).select(*keys, "l.*")
    pays = F.when(F.col("outcome") == "UP", F.col("up") * PAIR).when(F.col("outcome") == "DOWN", F.col("down") * PAIR)
    return end.join(outcomes.select(*keys, "outcome"), keys, "left").withColumn("payout", pays).withColumn("result", F.col("cash") + F.col("payout"))


def drawdown_episodes(results: DataFrame, keys: list[str], order: str, pnl: str, part: Column) -> DataFrame:
    """(keys, start, trough, recovered, depth, down_rows, up_rows): each time the sum of results lies below its highest so far.

    start is the row of the last high (null: the beginning, at zero), trough the lowest row (the first of equals),
    recovered the row that is back at the high or above (null: not yet); down_rows count from the high to the trough,
    up_rows from there to the recovery.
    """
    equity = running(results.select(*keys, order, pnl), keys, [order], part, "sum", {"equity": F.col(pnl)})
    peaks = running(equity, keys, [order], part, "max", {"_peak": F.col("equity")}).withColumn("peak", F.greatest("_peak", F.lit(0)))
    rows = running(peaks.withColumn("_high", (F.col("equity") == F.col("peak")).cast("long")), keys, [order], part, "sum", {"episode": F.col("_high"), "at": F.lit(1)})
    low = F.col("equity") < F.col("peak")
    found = rows.groupBy(*keys, "episode").agg(
        F.max(F.when(~low, F.col(order))).alias("start"), F.min_by(F.struct(order, "at"), F.struct("equity", "at")).alias("low"), F.max(F.col("peak") - F.col("equity")).alias("depth"),
        F.max(F.when(~low, F.col("at"))).alias("high_at"), F.max("at").alias("last_at"),
    )
    highs = rows.where(~low).select(*keys, (F.col("episode") - 1).alias("episode"), F.col(order).alias("recovered"))
    out = found.where("depth > 0").join(highs, [*keys, "episode"], "left")
    return out.select(
        *keys, "start", F.col("low")[order].alias("trough"), "recovered", "depth", (F.col("low.at") - F.coalesce("high_at", F.lit(0))).cast("long").alias("down_rows"),
        F.when(F.col("recovered").isNotNull(), F.col("last_at") + 1 - F.col("low.at")).cast("long").alias("up_rows"),
    )


def united(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end): intervals [start, end) of a key put together where they overlap or touch; empty ones go."""
    by = W.partitionBy(*keys).orderBy(start, end)
    rows = intervals.where(F.col(end) > F.col(start)).select(*keys, start, end).withColumn("_before", F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.coalesce((F.col(start) > F.col("_before")).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def both_live(bids: DataFrame, asks: DataFrame, eligible: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, eligible_ms, live_ms, uptime): the share of each key's eligible time in which both sides are quoted.

    All three are intervals (keys, start, end) that may overlap. Time is cut at every border: at each the numbers of open
    intervals of the three change, and what lies between two borders counts if none of them is zero. It is one window
    over the borders, whatever overlaps what; no interval is joined with another.
    """
    def borders(rows: DataFrame, name: str) -> DataFrame:
        delta = {n: F.lit(1 if n == name else 0) for n in ("b", "a", "e")}
        edge = lambda at, sign: F.struct(F.col(at).alias("t"), *[(c * sign).alias(n) for n, c in delta.items()])
        return rows.where(F.col(end) > F.col(start)).select(*keys, F.inline(F.array(edge(start, 1), edge(end, -1))))

    every = borders(bids, "b").unionByName(borders(asks, "a")).unionByName(borders(eligible, "e"))
    every = every.groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in ("b", "a", "e")])
    by = W.partitionBy(*keys).orderBy("t")
    cut = every.select(*keys, (F.lead("t").over(by) - F.col("t")).alias("ms"), *[F.sum(n).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(n) for n in ("b", "a", "e")])
    on = F.col("e") > 0
    sums = cut.groupBy(*keys).agg(F.sum(F.when(on, F.col("ms")).otherwise(0)).alias("eligible_ms"), F.sum(F.when(on & (F.col("b") > 0) & (F.col("a") > 0), F.col("ms")).otherwise(0)).alias("live_ms"))
    return sums.where("eligible_ms > 0").withColumn("uptime", F.col("live_ms") / F.col("eligible_ms"))


def plateau(results: DataFrame, keys: list[str], axes: list[str], result: str, share: float = 0.5) -> DataFrame:
    """The best configuration of each of the keys, with tries, neighbours, their mean result and whether it is a spike.

    results: (keys, axes, result), a row for each try; axes are whole numbers, steps of the sweep's lattice. Neighbours
    differ by at most one step on every axis. An optimum is a spike where their mean is below `share` of its result, or
    where it has none: a small change of parameters loses what was found. Each optimum is spread to the places around
    it and meets the tries by an equal join.
    """
    one = results.groupBy(*keys, *axes).agg(F.max(result).alias(result))
    best = one.groupBy(*keys).agg(F.min_by(F.struct(*axes, result), F.struct(-F.col(result), *axes)).alias("b"), F.count(F.lit(1)).alias("tries")).select(*keys, *[F.col("b")[a].alias(a) for a in axes], F.col("b")[result].alias("best"), "tries")
    around = best.select(*keys, *[F.col(a).alias(f"_{a}") for a in axes])
    for a in axes:
        around = around.withColumn(a, F.explode(F.array(*[F.col(f"_{a}") + d for d in (-1, 0, 1)])))
    same = F.lit(True)
    for a in axes:
        same = same & (F.col(a) == F.col(f"_{a}"))
    near = around.where(~same).join(one, [*keys, *axes]).groupBy(*keys).agg(F.count(F.lit(1)).alias("neighbours"), F.avg(result).alias("near_mean"))
    out = best.join(near, keys, "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0).cast("long")))
    return out.withColumn("spike", F.col("near_mean").isNull() | (F.col("near_mean") < share * F.col("best")))
