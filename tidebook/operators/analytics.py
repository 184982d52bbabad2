"""Analytics on ticks, fills and daily results. Written formulas, as DataFrame expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.operators.keyed import asof


#: Half-lives in one block of the exponentially weighted mean.
BLOCK = 400


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function. Spark SQL has no erf: a rational approximation with |error| < 7.5e-8.

    Abramowitz and Stegun 26.2.17; the five coefficients are fixed values.
    """
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def fair_value(spot: Column, start: Column, sigma: Column, seconds_left: Column) -> Column:
    """Probability that the price ends at or above its start: Phi(ln(S / S0) / (sigma sqrt(tau)))."""
    spread = sigma * F.sqrt(F.greatest(seconds_left, F.lit(1e-9)))
    return F.when(spread > 0, normal_cdf(F.log(spot / start) / spread)).otherwise((spot >= start).cast("double"))


def ewma_volatility(prices: DataFrame, keys: list[str], time: str, price: str, half_life: float) -> DataFrame:
    """prices with vol: root of the exponentially weighted mean of squared log returns up to each row.

    A return needs a positive price on both sides; other rows have none and take part in no mean. A null price or a
    row before the first return gives null. Weights are powers of one number, so running sums of values over it give the
    mean without a fold. They are taken in blocks of BLOCK half-lives, and a row sees its own block and the one before;
    older returns weigh less than 2^-BLOCK. A key's rows are one sorted group: a key is one market's window, or one
    series of days.
    """
    w = W.partitionBy(*keys).orderBy(time)
    last = F.lag(price).over(w)
    r = F.when((F.col(price) > 0) & (last > 0), F.log(F.col(price) / last))
    n = prices.withColumn("_r", r).withColumn("_n", F.row_number().over(w))
    n = n.withColumn("_block", F.floor(F.col("_n") / F.lit(BLOCK * half_life)).cast("long"))
    weight = F.when(F.col("_r").isNotNull(), F.pow(F.lit(2.0), F.col("_n") / F.lit(half_life) - F.col("_block") * BLOCK))
    upto = W.partitionBy(*keys, "_block").orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0)) + F.coalesce(F.sum(c).over(before), F.lit(0.0)) * 2.0**-BLOCK
    n = n.withColumn("_top", total(F.col("_r") * F.col("_r") * weight)).withColumn("_all", total(weight))
    return n.withColumn("vol", F.when(F.col("_all") > 0, F.sqrt(F.col("_top") / F.col("_all")))).drop("_r", "_n", "_block", "_top", "_all")


def blended_volatility(ticks: DataFrame, keys: list[str], ms: str, price: str, half_lives: tuple[float, ...]) -> DataFrame:
    """(keys, second, price, vol): the last tick of each second and the plain mean of the volatilities of all half-lives.

    Half-lives count seconds that have a tick; seconds without one are left out, as their return is not known.
    """
    tick = F.struct(F.col(ms).alias("at"), F.col(price).alias("price"))
    out = ticks.groupBy(*keys, F.floor(F.col(ms) / 1000).alias("second")).agg(F.max(tick)["price"].alias("price"))
    for i, half_life in enumerate(half_lives):
        out = ewma_volatility(out, keys, "second", "price", half_life).withColumnRenamed("vol", f"_vol{i}")
    names = [f"_vol{i}" for i in range(len(half_lives))]
    return out.withColumn("vol", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def weighted_markouts(fills: DataFrame, mids: DataFrame, keys: list[str], time: str, horizons: list[int], settled: DataFrame) -> DataFrame:
    """(horizon, fills, shares, markout) of fills (keys, time, direction, price, size): the sum of direction * (mid at
    time plus horizon - price) * size over the sum of sizes. Horizon null is settlement: `mid` of settled (keys, mid).

    A fill without a mid at a horizon stays out of it; where no size is left the markout is null.
    """
    own = fills.select(*keys, time, "direction", "price", "size")
    each = own.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons]))).withColumn(time, F.col(time) + F.col("horizon"))
    known = asof(each, mids, keys, time, "mid").drop(time)
    known = known.unionByName(own.drop(time).withColumn("horizon", F.lit(None).cast("long")).join(settled.select(*keys, "mid"), keys)).where("mid is not null")
    gain, size = F.sum(F.col("direction") * (F.col("mid") - F.col("price")) * F.col("size")), F.sum("size")
    return known.groupBy("horizon").agg(F.count(F.lit(1)).alias("fills"), size.alias("shares"), F.when(size > 0, gain / size).alias("markout"))


def breakdowns(results: DataFrame, slices: dict[str, Column], measures: list[Column]) -> DataFrame:
    """(dimension, slice, measures) over each of several slicings, in one pass and one shuffle of partial sums.

    A row counts once for each dimension; its slice is text, null where the row has none.
    """
    one = [F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("slice")) for d, c in slices.items()]
    return results.select("*", F.inline(F.array(*one))).groupBy("dimension", "slice").agg(*measures)


def markouts(fills: DataFrame, mids: DataFrame, keys: list[str], time: str, horizons: list[int]) -> DataFrame:
    """(horizon, fills, markout): the sum of mid at fill time plus horizon minus the fill's price; fills without a mid stay out."""
    each = fills.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons]))).withColumn(time, F.col(time) + F.col("horizon"))
    known = asof(each, mids, keys, time, "mid").where("mid is not null")
    return known.groupBy("horizon").agg(F.count(F.lit(1)).alias("fills"), F.sum(F.col("mid") - F.col("price")).alias("markout"))


def drawdown(results: DataFrame, keys: list[str], time: str, pnl: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    equity = results.withColumn("_equity", F.sum(pnl).over(w))
    peak = F.greatest(F.lit(0).cast("long"), F.max("_equity").over(w))
    return equity.withColumn("_down", peak - F.col("_equity")).groupBy(*keys).agg(F.max("_down").alias("drawdown"))


def t_statistic(days: DataFrame, pnl: str) -> DataFrame:
    d = days.agg(F.count(F.lit(1)).alias("days"), F.avg(pnl).alias("m"), F.stddev_samp(pnl).alias("s"))
    return d.select("days", F.round("m", 4).alias("mean"), F.round(F.col("m") / (F.col("s") / F.sqrt("days")), 6).alias("t"))


def brier(forecasts: DataFrame, by: list[str], p: str, hit: str) -> DataFrame:
    return forecasts.groupBy(*by).agg(F.round(F.avg(F.pow(F.col(p) - F.col(hit).cast("int"), 2)), 8).alias("brier"))


def reliability(forecasts: DataFrame, p: str, hit: str, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, n, predicted, observed): forecasts by their probability, in one panel for each value of `by`."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1).cast("long"))
    return forecasts.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 8).alias("predicted"), F.round(F.avg(F.col(hit).cast("double")), 8).alias("observed"))


def block_bootstrap(days: DataFrame, day: str, pnl: str, draws: int, seed: int) -> DataFrame:
    """(draws, low, median, high, above_zero) of the mean over days drawn with replacement, the same for one seed.

    Days are numbered; each draw picks as many numbers by a seeded hash and joins them: draws are spread over the
    cluster, and the days, one row each, are the small side.
    """
    n = days.count()
    numbered = days.select((F.row_number().over(W.orderBy(day)) - 1).cast("long").alias("_i"), F.col(pnl).alias("_pnl"))
    picks = days.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(max(n, 1)))).alias("slot"))
    picks = picks.withColumn("_i", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("draw").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1)).cast("long")))
    means = picks.join(numbered, "_i").groupBy("draw").agg(F.avg("_pnl").alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = means.agg(F.count(F.lit(1)).alias("draws"), q.alias("q"), F.avg((F.col("mean") > 0).cast("double")).alias("above_zero"))
    return out.select("draws", *[F.round(F.get("q", F.lit(i)), 4).alias(k) for i, k in enumerate(("low", "median", "high"))], "above_zero")


def ledger(trades: DataFrame, keys: list[str], time: str, shares: str, flow: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    return trades.select(time, *keys, F.sum(shares).over(w).alias("position"), F.sum(flow).over(w).alias("cash"))


def lead_lag(series: DataFrame, time: str, a: str, b: str, most: int) -> DataFrame:
    """(lag, xcorr, n): correlation of a at t with b at t + lag."""
    shifted = series.select(F.col(a), F.explode(F.sequence(F.lit(-most).cast("long"), F.lit(most).cast("long"))).alias("lag"), F.col(time).alias("_t")).withColumn(time, F.col("_t") + F.col("lag"))
    met = shifted.join(series.select(time, b), time)
    return met.groupBy("lag").agg(F.round(F.corr(a, b), 6).alias("xcorr"), F.count(F.lit(1)).alias("n"))


def best_on_fit(results: DataFrame, keys: list[str], config: str, fitting: str, pnl: str) -> DataFrame:
    """The configuration of each key with the best result on the fitting days, and its result on the held days."""
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col(pnl))), F.lit(0).cast("long"))
    each = results.groupBy(*keys, config).agg(of(F.col(fitting)).alias("fit"), of(~F.col(fitting)).alias("held"))
    best = F.min_by(F.struct(config, "fit", "held"), F.struct(-F.col("fit"), F.col(config).isNull(), config))
    return each.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b")[config].alias(config), "b.fit", "b.held")
