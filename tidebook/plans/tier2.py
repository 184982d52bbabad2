"""Analytics that the domain specifies: volatility, fair value, markouts, statistics, calibration, breakdowns.

Built from the written formulas. Sums of doubles are rounded, or kept as integers, so that two engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.operators import analytics as A
from tidebook.operators.accounts import running
from tidebook.operators.results import core_stats
from tidebook.plans.market import _E, stream, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""
WITH s AS (SELECT user_id, ms // 86400000 AS day, arg_max(value, event_id) AS price FROM {_E} GROUP BY ALL),
l AS (SELECT user_id, day, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / CASE WHEN lag(price) OVER w > 0 THEN lag(price) OVER w END) END AS r, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT a.user_id, a.day, round(sqrt(sum(b.r * b.r * pow(0.5, (a.n - b.n) / 5.0)) / sum(pow(0.5, (a.n - b.n) / 5.0))), 6) AS vol
FROM l a JOIN l b ON a.user_id = b.user_id AND b.n <= a.n AND b.r IS NOT NULL GROUP BY a.user_id, a.day""")
def ewma_vol(spark, sf_dir):
    s = stream(spark, sf_dir).groupBy("user_id", F.expr("ms div 86400000").alias("day")).agg(F.max_by("value", "event_id").alias("price"))
    return A.ewma_volatility(s, ["user_id"], "day", "price", 5.0).where("vol is not null").select("user_id", "day", F.round("vol", 6).alias("vol"))


_CDF = """CASE WHEN x >= 0 THEN 1 - upper ELSE upper END"""


@query(f"""
WITH c AS (SELECT event_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS start, 0.05 * sqrt(greatest(900.0 - (ms / 1000.0 % 900), 1e-9)) AS spread FROM {_E} WHERE event_type = 'click'),
z AS (SELECT event_id, CASE WHEN value > 0 AND start > 0 THEN ln(CASE WHEN value > 0 AND start > 0 THEN value / start END) / spread END AS x FROM c),
t AS (SELECT event_id, x, 1 / (1 + 0.2316419 * abs(x)) AS t FROM z),
u AS (SELECT event_id, x, exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS upper FROM t)
SELECT event_id, round({_CDF}, 9) AS fair FROM u""")
def fair_value(spark, sf_dir):
    e = stream(spark, sf_dir).where("event_type = 'click'")
    first = F.first("value").over(W.partitionBy("user_id").orderBy("event_id"))
    left = F.lit(900.0) - (F.col("ms") / 1000 % 900)
    e = e.withColumn("start", first)  # no fair value without positive prices
    return e.select("event_id", F.round(A.fair_value(F.when((F.col("value") > 0) & (F.col("start") > 0), F.col("value")), F.col("start"), F.lit(0.05), left), 9).alias("fair"))


_MARK = "(SELECT user_id, ms, max(k) AS mid FROM e WHERE event_type = 'click' GROUP BY ALL)"


@query(f"""
WITH e AS {_E}, q AS {_MARK}, f AS (SELECT event_id, user_id, ms, k, h FROM e, (SELECT unnest([0, 3600000, 21600000, 86400000]) AS h) WHERE event_type = 'purchase'),
m AS (SELECT f.h, f.k, q.mid FROM (SELECT *, ms + h AS at FROM f) f ASOF JOIN q ON f.user_id = q.user_id AND f.at >= q.ms)
SELECT CAST(h AS BIGINT) AS horizon, count(*) AS fills, CAST(sum(mid - k) AS BIGINT) AS markout FROM m GROUP BY h""")
def markout_curve(spark, sf_dir):
    e = stream(spark, sf_dir)
    fills = e.where("event_type = 'purchase'").select("event_id", "user_id", "ms", F.col("k").alias("price"))
    mids = e.where("event_type = 'click'").groupBy("user_id", "ms").agg(F.max("k").alias("mid"))
    return A.markouts(fills, mids, ["user_id"], "ms", [0, 3_600_000, 21_600_000, 86_400_000])


@query(f"""
WITH d AS (SELECT user_id, event_id, sum(CAST(round((value - 35) * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS equity FROM {_E})
SELECT user_id, CAST(max(peak - equity) AS BIGINT) AS drawdown FROM (SELECT user_id, equity, greatest(0, max(equity) OVER (PARTITION BY user_id ORDER BY event_id)) AS peak FROM d) GROUP BY user_id""")
def drawdown(spark, sf_dir):
    e = stream(spark, sf_dir).select("user_id", "event_id", F.round((F.col("value") - 35) * 100).cast("long").alias("pnl"))
    return A.drawdown(e, ["user_id"], "event_id", "pnl")


@query(f"""
WITH d AS (SELECT ms // 86400000 AS day, CAST(sum(CAST(round((value - 35) * 100) AS BIGINT)) AS DOUBLE) AS pnl FROM {_E} GROUP BY 1)
SELECT count(*) AS days, round(avg(pnl), 4) AS mean, round(avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))), 6) AS t FROM d""")
def tstat(spark, sf_dir):
    e = stream(spark, sf_dir).groupBy(F.expr("ms div 86400000").alias("day")).agg(F.sum(F.round((F.col("value") - 35) * 100).cast("long")).cast("double").alias("pnl"))
    return A.t_statistic(e, "pnl")


@query(f"SELECT event_type, round(avg(pow(k / 80.0 - CASE WHEN value > 35 THEN 1 ELSE 0 END, 2)), 8) AS brier FROM {_E} WHERE k IS NOT NULL GROUP BY event_type")
def brier(spark, sf_dir):
    e = stream(spark, sf_dir).where("k is not null").select("event_type", (F.col("k") / 80).alias("p"), (F.col("value") > 35).alias("hit"))
    return A.brier(e, ["event_type"], "p", "hit")


@query(f"""
SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 8) AS predicted, round(avg(hit), 8) AS observed FROM (SELECT k / 80.0 AS p, CASE WHEN value > 35 THEN 1.0 ELSE 0.0 END AS hit FROM {_E} WHERE k IS NOT NULL) GROUP BY 1""")
def reliability_bins(spark, sf_dir):
    e = stream(spark, sf_dir).where("k is not null").select((F.col("k") / 80).alias("p"), (F.col("value") > 35).alias("hit"))
    return A.reliability(e, "p", "hit", 10)


@query(f"SELECT event_type AS kind, ms // 3600000 % 24 AS hour, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM {_E} GROUP BY GROUPING SETS ((event_type), (ms // 3600000 % 24), (event_type, ms // 3600000 % 24))")
def breakdown_grouping_sets(spark, sf_dir):
    e = stream(spark, sf_dir).select(F.col("event_type").alias("kind"), F.expr("ms div 3600000 % 24").alias("hour"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return e.groupingSets([[F.col("kind")], [F.col("hour")], [F.col("kind"), F.col("hour")]], "kind", "hour").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("cents"))


@query(f"""
WITH d AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, pnl FROM (SELECT ms // 86400000 AS day, CAST(sum(CAST(round((value - 35) * 100) AS BIGINT)) AS DOUBLE) AS pnl FROM {_E} GROUP BY 1)),
p AS (SELECT draw, CAST('0x' || substr(md5('7-' || draw || '-' || slot), 1, 8) AS BIGINT) % (SELECT count(*) FROM d) AS i FROM (SELECT unnest(range(10000)) AS draw), (SELECT unnest(range(1, (SELECT count(*) FROM d) + 1)) AS slot)),
m AS (SELECT draw, avg(pnl) AS mean FROM p JOIN d USING (i) GROUP BY draw)
SELECT count(*) AS draws, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.5), 4) AS median, round(quantile_cont(mean, 0.975), 4) AS high, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END) AS above_zero FROM m""")
def block_bootstrap(spark, sf_dir):
    days = stream(spark, sf_dir).groupBy(F.expr("ms div 86400000").alias("day")).agg(F.sum(F.round((F.col("value") - 35) * 100).cast("long")).cast("double").alias("pnl"))
    return A.block_bootstrap(days, "day", "pnl", draws=10_000, seed=7)


@query(f"""
WITH t AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * k AS shares, CAST(round(value * 100) AS BIGINT) * CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS cash FROM {_E} WHERE event_type IN ('purchase', 'click'))
SELECT event_id, user_id, CAST(sum(shares) OVER w AS BIGINT) AS position, CAST(sum(cash) OVER w AS BIGINT) AS cash FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def ledger(spark, sf_dir):
    sell = F.col("event_type") == "purchase"
    e = stream(spark, sf_dir).where("event_type in ('purchase', 'click')").select("event_id", "user_id", F.when(sell, -F.col("k")).otherwise(F.col("k")).alias("shares"), (F.round(F.col("value") * 100).cast("long") * F.when(sell, 1).otherwise(-1)).alias("flow"))
    return A.ledger(e, ["user_id"], "event_id", "shares", "flow")


@query(f"""
WITH d AS (SELECT ms // 86400000 AS day, sum(CAST(round((value - 35) * 100) AS BIGINT)) AS pnl FROM {_E} GROUP BY 1)
SELECT day, CAST(sum(pnl) OVER (ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM d""")
def rolling_week(spark, sf_dir):
    d = stream(spark, sf_dir).groupBy(F.expr("ms div 86400000").alias("day")).agg(F.sum(F.round((F.col("value") - 35) * 100).cast("long")).alias("pnl"))
    return d.select("day", F.sum("pnl").over(W.orderBy("day").rangeBetween(-6, 0)).alias("week"))


@query(f"""
WITH h AS (SELECT ms // 3600000 AS hour, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS a, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS b FROM {_E} GROUP BY 1),
x AS (SELECT l.lag, h.a, g.b FROM h, (SELECT unnest(range(-3, 4)) AS lag) l JOIN h g ON g.hour = h.hour + l.lag)
SELECT CAST(lag AS BIGINT) AS lag, round(corr(a, b), 6) AS xcorr, count(*) AS n FROM x GROUP BY lag""")
def lead_lag(spark, sf_dir):
    of = lambda k: F.count_if(F.col("event_type") == k).cast("double")
    h = stream(spark, sf_dir).groupBy(F.expr("ms div 3600000").alias("hour")).agg(of("click").alias("a"), of("purchase").alias("b"))
    return A.lead_lag(h, "hour", "a", "b", 3)


@query(f"""
WITH p AS (SELECT user_id, k % 4 AS config, CAST(sum(CAST(round((value - 35) * 100) AS BIGINT)) FILTER (ms // 86400000 % 10 < 7) AS BIGINT) AS fit, CAST(sum(CAST(round((value - 35) * 100) AS BIGINT)) FILTER (ms // 86400000 % 10 >= 7) AS BIGINT) AS held FROM {_E} GROUP BY ALL)
SELECT user_id, config, coalesce(fit, 0) AS fit, coalesce(held, 0) AS held FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(fit, 0) DESC, config NULLS LAST) = 1""")
def sweep_holdout(spark, sf_dir):
    e = stream(spark, sf_dir).select("user_id", (F.col("k") % 4).alias("config"), F.expr("ms div 86400000 % 10 < 7").alias("fitting"), F.round((F.col("value") - 35) * 100).cast("long").alias("pnl"))
    return A.best_on_fit(e, ["user_id"], "config", "fitting", "pnl")


@query(f"""
WITH s AS (SELECT user_id, ms // 1000 AS second, arg_max(value, ms) AS price FROM {_E} GROUP BY ALL),
l AS (SELECT user_id, second, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / CASE WHEN lag(price) OVER w > 0 THEN lag(price) OVER w END) END AS r, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY second)),
v AS (SELECT a.user_id, a.second, sqrt(sum(b.r * b.r * pow(0.5, (a.n - b.n) / 60.0)) / sum(pow(0.5, (a.n - b.n) / 60.0))) AS fast, sqrt(sum(b.r * b.r * pow(0.5, (a.n - b.n) / 600.0)) / sum(pow(0.5, (a.n - b.n) / 600.0))) AS slow
FROM l a JOIN l b ON a.user_id = b.user_id AND b.n <= a.n AND b.r IS NOT NULL GROUP BY a.user_id, a.second)
SELECT user_id, second, round((fast + slow) / 2, 6) AS vol FROM v""")
def blended_vol(spark, sf_dir):
    v = A.blended_volatility(stream(spark, sf_dir), ["user_id"], "ms", "value", (60.0, 600.0))
    return v.where("vol is not null").select("user_id", "second", F.round("vol", 6).alias("vol"))


_HORIZONS = [500, 1_000, 2_000, 5_000, 10_000, 30_000, 60_000, 120_000]


@query(f"""
WITH e AS {_E}, q AS {_MARK}, f AS (SELECT user_id, ms, k, event_id % 5 + 1 AS size, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM e WHERE event_type = 'purchase'),
h AS (SELECT f.*, h, ms + h AS at FROM f, (SELECT unnest({_HORIZONS}) AS h)),
m AS (SELECT h.h, h.d, h.k, h.size, q.mid FROM h ASOF JOIN q ON h.user_id = q.user_id AND h.at >= q.ms
UNION ALL SELECT NULL, f.d, f.k, f.size, l.mid FROM f JOIN (SELECT user_id, arg_max(mid, ms) AS mid FROM q WHERE mid IS NOT NULL GROUP BY user_id) l USING (user_id))
SELECT CAST(h AS BIGINT) AS horizon, count(*) AS fills, CAST(sum(size) AS BIGINT) AS shares, round(sum(d * (mid - k) * size) / sum(size), 6) AS markout FROM m WHERE mid IS NOT NULL GROUP BY h""")
def markout_nine_horizons(spark, sf_dir):
    e = stream(spark, sf_dir)
    fills = e.where("event_type = 'purchase'").select("user_id", "ms", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"), F.col("k").alias("price"), (F.col("event_id") % 5 + 1).alias("size"))
    mids = e.where("event_type = 'click'").groupBy("user_id", "ms").agg(F.max("k").alias("mid"))
    settled = mids.where("mid is not null").groupBy("user_id").agg(F.max_by("mid", "ms").alias("mid"))
    return A.weighted_markouts(fills, mids, ["user_id"], "ms", _HORIZONS, settled).withColumn("markout", F.round("markout", 6))


@query(f"""
WITH e AS {_E}, r AS (SELECT user_id, max(c) - min(c) AS r FROM (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS c FROM e) GROUP BY user_id),
t AS (SELECT quantile_disc(r, 1 / 3) AS a, quantile_disc(r, 2 / 3) AS b FROM r),
x AS (SELECT e.*, CAST(round(value * 100) AS BIGINT) AS c, CASE WHEN r.r <= t.a THEN 'low' WHEN r.r <= t.b THEN 'mid' ELSE 'high' END AS vol FROM e JOIN r USING (user_id), t),
s AS (SELECT c, unnest([{{'d': 'minute', 's': CAST(ms // 60000 % 15 AS VARCHAR)}}, {{'d': 'forecast', 's': CAST(least(k // 8, 9) AS VARCHAR)}}, {{'d': 'volatility', 's': vol}}, {{'d': 'hour', 's': CAST(ms // 3600000 % 24 AS VARCHAR)}},
{{'d': 'side', 's': CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END}}, {{'d': 'mode', 's': event_type}}]) AS u FROM x)
SELECT u.d AS dimension, u.s AS slice, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, round(avg(CASE WHEN c > 3500 THEN 1.0 ELSE 0.0 END), 8) AS hit_rate FROM s GROUP BY ALL""")
def breakdown_six(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    ranges = e.groupBy("user_id").agg((F.max("c") - F.min("c")).alias("r"))  # a row for each market
    # how many markets have each range, summed up in slices of ranges: no task holds all markets
    counts = running(ranges.groupBy("r").agg(F.count(F.lit(1)).alias("n")), [], ["r"], F.expr("r div 1024"), "sum", {"upto": F.col("n")})
    cuts = counts.crossJoin(ranges.agg(F.count(F.lit(1)).alias("all"))).agg(*[F.min(F.when(F.col("upto") * 3 >= F.col("all") * third, F.col("r"))).alias(name) for third, name in ((1, "a"), (2, "b"))])  # the count is one row
    of = ranges.join(F.broadcast(cuts), F.lit(True)).select("user_id", F.when(F.col("r") <= F.col("a"), "low").when(F.col("r") <= F.col("b"), "mid").otherwise("high").alias("vol"))  # cuts is one row
    slices = {
        "minute": F.expr("ms div 60000 % 15"), "forecast": F.least(F.expr("k div 8"), F.lit(9)), "volatility": F.col("vol"), "hour": F.expr("ms div 3600000 % 24"),
        "side": F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL"), "mode": F.col("event_type"),
    }
    return A.breakdowns(e.join(of, "user_id"), slices, [F.count(F.lit(1)).alias("n"), F.sum("c").alias("cents"), F.round(F.avg((F.col("c") > 3500).cast("double")), 8).alias("hit_rate")])


@query(f"""
WITH m AS (SELECT user_id, sum(CAST(round((value - 35) * 100) AS BIGINT)) AS pnl, sum(k) AS shares FROM {_E} GROUP BY user_id)
SELECT count(pnl) AS markets, CAST(sum(pnl) AS BIGINT) AS net, round(avg(pnl), 4) AS mean, round(quantile_cont(pnl, 0.5), 4) AS median, round(stddev_samp(pnl), 4) AS sd, round(quantile_cont(pnl, 0.05), 4) AS p5, round(quantile_cont(pnl, 0.95), 4) AS p95,
round(sum(pnl) / sum(shares), 6) AS edge, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(pnl) FILTER (pnl > 0) / -avg(pnl) FILTER (pnl < 0), 6) AS win_loss FROM m""")
def market_result_stats(spark, sf_dir):
    m = stream(spark, sf_dir).groupBy("user_id").agg(F.sum(F.round((F.col("value") - 35) * 100).cast("long")).alias("pnl"), F.sum("k").alias("shares"))
    digits = {"mean": 4, "median": 4, "sd": 4, "p5": 4, "p95": 4, "edge": 6, "hit_rate": 6, "win_loss": 6}
    found = core_stats(m, "pnl", "shares").drop("skew")  # engines define skewness in different ways
    return found.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in found.columns])


@query(f"""
WITH f AS (SELECT k / 80.0 AS p, CASE WHEN value > 35 THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN ms % 900000 < 300000 THEN 'over 10 min' WHEN ms % 900000 <= 600000 THEN '5 to 10 min' ELSE 'under 5 min' END AS panel FROM {_E} WHERE k IS NOT NULL)
SELECT panel, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 8) AS predicted, round(avg(hit), 8) AS observed FROM f GROUP BY ALL""")
def reliability_panels(spark, sf_dir):
    into = F.col("ms") % 900_000
    panel = F.when(into < 300_000, "over 10 min").when(into <= 600_000, "5 to 10 min").otherwise("under 5 min")
    e = stream(spark, sf_dir).where("k is not null").select((F.col("k") / 80).alias("p"), (F.col("value") > 35).alias("hit"), panel.alias("panel"))
    return A.reliability(e, "p", "hit", 10, ("panel",))
