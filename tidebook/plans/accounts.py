"""Queries on accounts, drawdowns, uptime, sweeps and stored sketches over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import accounts, checks, results, sketches
from tidebook.plans.market import _E, Query, stream
from tidebook.session import scratch

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Rows that one task accounts for in a row.
SLICE = 4096


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys (clicks and views) and sales (purchases) of UP or DOWN shares at whole cents."""
    e = stream(spark, sf_dir).where("event_type in ('click', 'view', 'purchase') and k is not null")
    shares = F.when(F.col("event_type") == "purchase", -(F.col("k") % 5)).otherwise(F.col("k") % 7 + 1)
    price = F.col("event_id") % 90 + 5
    return e.select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "UP").otherwise("DOWN").alias("token"), shares.alias("shares"), (-shares * price).alias("flow"), F.when(F.col("event_type") == "purchase", F.lit(0)).otherwise(F.col("k") % 3).cast("long").alias("fee"))


_TRADES = f"""t AS (SELECT user_id, event_id, event_id % 2 = 0 AS up, s, -s * (event_id % 90 + 5) AS flow, CASE WHEN event_type = 'purchase' THEN 0 ELSE k % 3 END AS fee FROM
  (SELECT *, CASE WHEN event_type = 'purchase' THEN -(k % 5) ELSE k % 7 + 1 END AS s FROM {_E} WHERE event_type IN ('click', 'view', 'purchase') AND k IS NOT NULL)),
legs AS (SELECT *, sum(CASE WHEN up THEN s ELSE 0 END) OVER w AS u, sum(CASE WHEN up THEN 0 ELSE s END) OVER w AS d, sum(flow) OVER w AS f, sum(fee) OVER w AS fees FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT *, greatest(0, max(least(u, d)) OVER (PARTITION BY user_id ORDER BY event_id)) AS merged FROM legs)"""


@query(f"WITH {_TRADES} SELECT user_id, event_id, CAST(f - fees + merged * 100 AS BIGINT) AS cash, CAST(u - merged AS BIGINT) AS up, CAST(d - merged AS BIGINT) AS down, CAST(merged AS BIGINT) AS merged, CAST(fees AS BIGINT) AS fees FROM m")
def ledger_merged(spark, sf_dir):
    """Cash and legs after each trade, pairs merged as soon as there are any."""
    return accounts.merged_ledger(_trades(spark, sf_dir), ["user_id"], ["event_id"], F.expr(f"event_id div {SLICE}")).select("user_id", "event_id", "cash", "up", "down", "merged", "fees")


@query(f"""WITH {_TRADES}, o AS (SELECT user_id, CASE WHEN arg_max(k, event_id) >= 40 THEN 'UP' ELSE 'DOWN' END AS outcome FROM {_E} WHERE event_type = 'signup' AND k IS NOT NULL GROUP BY user_id),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT l.user_id, o.outcome, CAST(merged AS BIGINT) AS merged, CAST(CASE outcome WHEN 'UP' THEN (u - merged) * 100 WHEN 'DOWN' THEN (d - merged) * 100 END AS BIGINT) AS payout,
  CAST(f - fees + merged * 100 + CASE outcome WHEN 'UP' THEN (u - merged) * 100 WHEN 'DOWN' THEN (d - merged) * 100 END AS BIGINT) AS result FROM l LEFT JOIN o USING (user_id)""")
def ledger_settled(spark, sf_dir):
    """What each market comes to once its outcome pays out."""
    ledger = accounts.merged_ledger(_trades(spark, sf_dir), ["user_id"], ["event_id"], F.expr(f"event_id div {SLICE}"))
    done = stream(spark, sf_dir).where("event_type = 'signup' and k is not null").groupBy("user_id").agg(F.when(F.max_by("k", "event_id") >= 40, "UP").otherwise("DOWN").alias("outcome"))
    return accounts.settled(ledger, done, ["user_id"], F.col("event_id")).select("user_id", "outcome", "merged", "payout", "result")


@query(f"""
WITH q AS (SELECT user_id, event_id, sum(CAST(round((value - 35) * 100) AS BIGINT)) OVER w AS equity, row_number() OVER w AS rn FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY user_id ORDER BY event_id)) AS peak FROM q),
n AS (SELECT *, sum(CASE WHEN equity = peak THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS ep FROM p),
g AS (SELECT user_id, ep, max(event_id) FILTER (equity = peak) AS start, max(peak - equity) AS depth, coalesce(max(rn) FILTER (equity = peak), 0) AS high_at, max(rn) AS last_at, min(equity) AS low FROM n GROUP BY ALL HAVING max(peak - equity) > 0),
l AS (SELECT g.*, (SELECT min(event_id) FROM n WHERE n.user_id = g.user_id AND n.ep = g.ep AND n.equity = g.low) AS trough, (SELECT min(event_id) FROM n WHERE n.user_id = g.user_id AND n.ep = g.ep + 1 AND n.equity = n.peak) AS recovered FROM g)
SELECT l.user_id, l.start, l.trough, l.recovered, CAST(l.depth AS BIGINT) AS depth, CAST(n.rn - l.high_at AS BIGINT) AS down_rows, CAST(CASE WHEN l.recovered IS NOT NULL THEN l.last_at + 1 - n.rn END AS BIGINT) AS up_rows FROM l JOIN n ON n.user_id = l.user_id AND n.event_id = l.trough""")
def drawdown_episodes(spark, sf_dir):
    e = stream(spark, sf_dir).select("user_id", "event_id", F.round((F.col("value") - 35) * 100).cast("long").alias("pnl"))
    return accounts.drawdown_episodes(e, ["user_id"], "event_id", "pnl", F.expr(f"event_id div {SLICE}"))


_LIVE = "ms, ms + k * 600000"


@query(f"""
WITH e AS (SELECT * FROM {_E} WHERE k IS NOT NULL), x AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'b' WHEN 'view' THEN 'a' ELSE 'e' END AS s, ms AS a, ms + k * CASE WHEN event_type = 'signup' THEN 2400000 ELSE 600000 END AS z FROM e WHERE event_type IN ('click', 'view', 'signup') AND k > 0),
c AS (SELECT DISTINCT user_id, t FROM (SELECT user_id, a AS t FROM x UNION ALL SELECT user_id, z FROM x)),
i AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS z FROM c),
j AS (SELECT i.user_id, i.z - i.a AS ms, bool_or(x.s = 'e') AS e, bool_or(x.s = 'b') AND bool_or(x.s = 'a') AS live FROM i JOIN x ON x.user_id = i.user_id AND x.a <= i.a AND x.z >= i.z GROUP BY i.user_id, i.a, i.z)
SELECT user_id, CAST(sum(ms) FILTER (e) AS BIGINT) AS eligible_ms, CAST(coalesce(sum(ms) FILTER (e AND live), 0) AS BIGINT) AS live_ms, round(coalesce(sum(ms) FILTER (e AND live), 0) / sum(ms) FILTER (e), 9) AS uptime FROM j GROUP BY user_id HAVING sum(ms) FILTER (e) > 0""")
def quote_uptime(spark, sf_dir):
    """The share of eligible time in which both sides are quoted."""
    e = stream(spark, sf_dir).where("k is not null")
    of = lambda kind, step: e.where(F.col("event_type") == kind).select("user_id", F.col("ms").alias("a"), (F.col("ms") + F.col("k") * step).alias("z"))
    found = accounts.both_live(of("click", 600_000), of("view", 600_000), of("signup", 2_400_000), ["user_id"], "a", "z")
    return found.withColumn("uptime", F.round("uptime", 9))


@query(f"""
WITH x AS (SELECT user_id, ms AS a, ms + k * 600000 AS z FROM {_E} WHERE event_type = 'click' AND k > 0),
n AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n)
SELECT user_id, min(a) AS a, max(z) AS z FROM i GROUP BY user_id, island""")
def live_stretches(spark, sf_dir):
    e = stream(spark, sf_dir).where("event_type = 'click' and k is not null")
    return accounts.united(e.select("user_id", F.col("ms").alias("a"), (F.col("ms") + F.col("k") * 600_000).alias("z")), ["user_id"], "a", "z")


@query(f"""
WITH r AS (SELECT event_type AS kind, k % 9 AS width, event_id % 7 AS skew, sum(CAST(round((value - 30) * 100) AS BIGINT)) AS pnl FROM {_E} WHERE k IS NOT NULL AND ms // 86400000 % 10 < 7 GROUP BY ALL),
b AS (SELECT kind, width, skew, pnl AS best, count(*) OVER (PARTITION BY kind) AS tries FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY pnl DESC, width, skew) = 1),
n AS (SELECT b.kind, count(*) AS neighbours, avg(r.pnl) AS near_mean FROM b JOIN r ON r.kind = b.kind AND abs(r.width - b.width) <= 1 AND abs(r.skew - b.skew) <= 1 AND NOT (r.width = b.width AND r.skew = b.skew) GROUP BY b.kind)
SELECT b.kind, width, skew, CAST(best AS BIGINT) AS best, tries, coalesce(neighbours, 0) AS neighbours, round(near_mean, 6) AS near_mean, near_mean IS NULL OR near_mean < 0.5 * best AS spike FROM b LEFT JOIN n USING (kind)""")
def sweep_plateau(spark, sf_dir):
    e = stream(spark, sf_dir).where("k is not null and ms div 86400000 % 10 < 7")
    tries = e.groupBy(F.col("event_type").alias("kind"), (F.col("k") % 9).alias("width"), (F.col("event_id") % 7).alias("skew")).agg(F.sum(F.round((F.col("value") - 30) * 100).cast("long")).alias("pnl"))
    return accounts.plateau(tries, ["kind"], ["width", "skew"], "pnl").withColumn("near_mean", F.round("near_mean", 6))


_RANGE = "ms >= 1704412800000 AND ms < 1705622400000"


@query(f"SELECT event_type AS kind, count(DISTINCT user_id) AS exact, true AS near FROM {_E} WHERE {_RANGE} GROUP BY event_type")
def sketched_distinct(spark, sf_dir):
    """Distinct markets of a range from sketches that are stored by hour; near: within the error that the sketch promises."""
    e = stream(spark, sf_dir).withColumn("hour", F.expr("ms div 3600000"))
    stored = sketches.store(e, ["event_type"], "hour", scratch(spark, "sketches"), distinct={"markets": F.col("user_id")})
    found = sketches.merged(stored.where("hour >= 1704412800000 div 3600000 and hour < 1705622400000 div 3600000"), ["event_type"], distinct=["markets"])
    exact = e.where(_RANGE).groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return found.join(exact, "event_type").select(F.col("event_type").alias("kind"), "exact", (F.abs(F.col("markets") - F.col("exact")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("exact"))).alias("near"))


@query(f"""
WITH v AS (SELECT event_type AS kind, CAST(round(value * 100) AS BIGINT) AS c FROM {_E} WHERE {_RANGE})
SELECT kind, q, true AS near FROM (SELECT DISTINCT kind FROM v), (SELECT unnest([0.5, 0.9, 0.99]) AS q)""")
def sketched_quantiles(spark, sf_dir):
    """Quantiles of a range from sketches that are stored by hour; near: the rank of what is found is within the promised error."""
    e = stream(spark, sf_dir).withColumn("hour", F.expr("ms div 3600000")).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    stored = sketches.store(e, ["event_type"], "hour", scratch(spark, "sketches"), quantiles={"cents": F.col("c")})
    found = sketches.merged(stored.where("hour >= 1704412800000 div 3600000 and hour < 1705622400000 div 3600000"), ["event_type"], quantiles={"cents": [0.5, 0.9, 0.99]})
    each = found.select("event_type", F.explode(F.arrays_zip(F.array(*map(F.lit, [0.5, 0.9, 0.99])).alias("q"), F.col("cents").alias("x"))).alias("z")).select("event_type", "z.q", "z.x")
    ranks = e.where(_RANGE).join(each, "event_type").groupBy("event_type", "q").agg(F.avg((F.col("c") < F.col("x")).cast("double")).alias("below"), F.avg((F.col("c") <= F.col("x")).cast("double")).alias("upto"))
    return ranks.select(F.col("event_type").alias("kind"), F.col("q").cast("double").alias("q"), ((F.col("below") - sketches.RANK_ERROR <= F.col("q")) & (F.col("q") <= F.col("upto") + sketches.RANK_ERROR)).alias("near"))


# --- gates and charts -----------------------------------------------------------------------------------------


@query(f"""
WITH e AS (SELECT * FROM {_E} WHERE k IS NOT NULL), f AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 5 + 1) AS d, k / 80.0 AS price, value / 100 AS fair, user_id, k FROM e WHERE event_type = 'purchase')
SELECT 'identity' AS "check", count(*) AS rows, CAST(0 AS BIGINT) AS broken, true AS holds, CAST(NULL AS VARCHAR) AS witness FROM f
UNION ALL SELECT 'settlement', count(*), count(*) FILTER (k % 13 = 0), count(*) FILTER (k % 13 = 0) <= 0.001 * count(*) + 1e-9, min(CAST(event_id AS VARCHAR)) FILTER (k % 13 = 0) FROM f
UNION ALL SELECT 'size impact', count(*), count(*) FILTER (event_id % 5 + 1 >= 0.2 * (k % 30 + 1)), count(*) FILTER (event_id % 5 + 1 >= 0.2 * (k % 30 + 1)) <= 0.05 * count(*) + 1e-9, min(CAST(event_id AS VARCHAR)) FILTER (event_id % 5 + 1 >= 0.2 * (k % 30 + 1)) FROM f
UNION ALL SELECT 'determinism', count(*), CAST(0 AS BIGINT), true, NULL FROM f
UNION ALL SELECT 'zero strategy', count(DISTINCT user_id), count(DISTINCT user_id) FILTER (NOT quoted), count(DISTINCT user_id) FILTER (NOT quoted) = 0, min(CAST(user_id AS VARCHAR)) FILTER (NOT quoted)
  FROM (SELECT f.user_id, f.user_id IN (SELECT user_id FROM e WHERE event_type = 'view' AND k > 70) AS quoted FROM f)""")
def sanity_gate(spark, sf_dir):
    """The checks of a run's results as rows: what they are about, what breaks them, and a first witness."""
    e = stream(spark, sf_dir).where("k is not null")
    fills = e.where("event_type = 'purchase'").select("event_id", "user_id", "k", F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.col("event_id") % 5 + 1).cast("double").alias("size"), (F.col("k") / 80).alias("price"), (F.col("value") / 100).alias("fair"), (F.col("value") / 90).alias("later"), (F.col("k") % 2).cast("double").alias("won"))
    parts = results.decomposed(fills, "later", "won")
    every = F.lit(True)
    rows = checks.row_checks(parts, F.col("event_id"), {"identity": checks.identity(parts), "settlement": (every, F.col("k") % 13 != 0, checks.SETTLED), "size impact": (every, F.col("size") < checks.SMALL * (F.col("k") % 30 + 1), checks.SMALL_SHARE)})
    again = results.decomposed(fills.repartition(5, "user_id"), "later", "won")
    return checks.gate([rows, checks.deterministic("determinism", parts, again, ["event_id"]), checks.zero_strategy(fills, e.where("event_type = 'view' and k > 70"), ["user_id"])])


@query(f"""
WITH p AS (SELECT event_type AS kind, ms AS x, CAST(round(value * 100) AS BIGINT) AS y FROM {_E}), r AS (SELECT kind, min(x) AS low, max(x) AS high FROM p GROUP BY kind),
c AS (SELECT p.kind, x, y, CAST(least(floor((x - low) / ((high - low) / 50.0::DOUBLE)), 49) AS INTEGER) AS pixel FROM p JOIN r USING (kind)),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, pixel ORDER BY x, y) AS a, row_number() OVER (PARTITION BY kind, pixel ORDER BY x DESC, y DESC) AS b, row_number() OVER (PARTITION BY kind, pixel ORDER BY y, x) AS c, row_number() OVER (PARTITION BY kind, pixel ORDER BY y DESC, x) AS d FROM c)
SELECT DISTINCT kind, pixel, x, y FROM n WHERE a = 1 OR b = 1 OR c = 1 OR d = 1""")
def chart_line(spark, sf_dir):
    """A chart's line at a fixed size: at most four points for each of 50 pixel columns and kind."""
    e = stream(spark, sf_dir).select(F.col("event_type").alias("kind"), F.col("ms").alias("x"), F.round(F.col("value") * 100).cast("long").alias("y"))
    return checks.thinned(e, ["kind"], "x", "y", 50)
