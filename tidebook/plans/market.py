"""Queries of the market domain over the driver's tables, each with the SQL that checks it.

`events` stands for the event stream: user_id for the market, event_id for the total order, ts for the arrival time,
event_type for the kind, value for price or size, and k of props for the level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import bands, book, digest, gaps, keyed, lifecycle
from tidebook.session import stored
from tidebook.sources import lake, raw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms (arrival in milliseconds) and k (level)."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), k.alias("k"))


_E = "(SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) // 1000 AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


# --- views ----------------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{t}' AS view_name, count(*) AS n FROM {t}" for t in TABLES))
def view_row_counts(spark, sf_dir):
    each = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("view_name"), "n") for t in TABLES]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' UNION ALL SELECT CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) WHERE false")
def scan_typed_empty(spark, sf_dir):
    found = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "value")
    return found.unionByName(spark.createDataFrame([], found.schema))


_MARKETS_SQL = f"""
WITH e AS {_E},
o AS (SELECT * FROM e WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) = 1),
r AS (SELECT * FROM e WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) = 1),
h AS (SELECT user_id, count(*) FILTER (event_type = 'error') > 18 AS excluded, count(*) AS n_events FROM e WHERE user_id % 10 <> 0 GROUP BY user_id)
SELECT CAST(o.user_id AS VARCHAR) AS market_id, 'm-' || CAST(o.ms // 1000 AS VARCHAR) AS slug, o.ms - o.ms % 900000 AS window_start, o.ms - o.ms % 900000 + 900000 AS window_end,
  make_timestamp((o.ms - o.ms % 900000) * 1000) AS window_start_utc, CASE WHEN r.k >= 50 THEN 'UP' WHEN r.k < 50 THEN 'DOWN' END AS outcome,
  r.value AS price_to_beat, r.value + r.k AS final_price, coalesce(h.excluded, true) AS excluded, h.n_events AS n_events
FROM o LEFT JOIN r USING (user_id) LEFT JOIN h USING (user_id)
"""


@query(_MARKETS_SQL)
def markets_view(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("market_id", F.col("user_id").cast("string"))
    start = S.window_start(F.col("ms"), 900_000)
    opens = e.where("event_type = 'signup'").select("market_id", S.slug("m", F.col("ms")).alias("slug"), start.alias("window_start"), (start + 900_000).alias("window_end"), F.col("ms").alias("recv_ts"), F.col("event_id").alias("line"))
    done = e.where("event_type = 'purchase'").select("market_id", F.when(F.col("k") >= 50, "UP").when(F.col("k") < 50, "DOWN").alias("outcome"), F.col("value").alias("price_to_beat"), (F.col("value") + F.col("k")).alias("final_price"), F.col("ms").alias("recv_ts"), F.col("event_id").alias("line"))
    health = e.where("user_id % 10 <> 0").groupBy("market_id").agg((F.count_if(F.col("event_type") == "error") > 18).alias("excluded"), F.count(F.lit(1)).alias("n_events"))
    return keyed.markets(opens, done, health)


@query(f"SELECT user_id, event_id, value, k FROM {_E} WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) = 1")
def first_open_per_key(spark, sf_dir):
    return keyed.first_per_key(stream(spark, sf_dir).where("event_type = 'signup'").select("user_id", "event_id", "value", "k", "ms"), ["user_id"], ["ms", "event_id"]).select("user_id", "event_id", "value", "k")


@query(f"SELECT user_id, event_id, value, k FROM {_E} WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) = 1")
def last_resolution_per_key(spark, sf_dir):
    return keyed.last_per_key(stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "event_id", "value", "k", "ms"), ["user_id"], ["ms", "event_id"]).select("user_id", "event_id", "value", "k")


# --- replay ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND (nullif(user_id % 7, 0) IS NULL OR user_id % 7 IN (2, 5))")
def replay_filter_half_open(spark, sf_dir):
    market = F.nullif(F.col("user_id") % 7, F.lit(0))
    e = table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    return e.where(market.isNull() | market.isin(2, 5)).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE), hour(ts) ORDER BY user_id, nullif(k % 5, 0) NULLS FIRST, event_id) AS place, CAST(hour(ts) AS INTEGER) AS hour, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM {_E}")
def replay_order_rank(spark, sf_dir):
    e = stream(spark, sf_dir).select("event_id", "user_id", "k", F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour"))
    w = W.partitionBy("day", "hour").orderBy("user_id", F.asc_nulls_first(F.nullif(F.col("k") % 5, F.lit(0))), "event_id")
    return e.select("event_id", F.row_number().over(w).cast("long").alias("place"), "hour", "day")


@query("SELECT 'orders' AS tag, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS name FROM orders UNION ALL BY NAME SELECT 'part' AS tag, p_partkey AS id, p_name AS name, p_retailprice AS price FROM part UNION ALL BY NAME SELECT 'customer' AS tag, c_custkey AS id, c_name AS name FROM customer")
def union_by_name_tagged(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("tag"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("tag"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("tag"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return o.unionByName(p, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS idx, CAST(embedding[i] AS DOUBLE) AS size FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def explode_levels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "size"))
    return e.select("vec_id", "idx", F.col("size").cast("double").alias("size"))


@query(f"SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY event_id) AS levels, count(*) AS n FROM {_E} WHERE event_type = 'view' GROUP BY user_id")
def regroup_levels(spark, sf_dir):
    e = stream(spark, sf_dir).where("event_type = 'view'")
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "k"))).alias("l"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.array_join(F.transform("l", lambda x: x["k"].cast("string")), ",").alias("levels"), "n")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def kind_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS deltas, count(*) FILTER (event_type = 'purchase') AS trades, count(*) FILTER (event_type = 'signup') AS snapshots FROM events GROUP BY user_id")
def kind_counts_filter(spark, sf_dir):
    of = lambda k, n: F.count_if(F.col("event_type") == k).alias(n)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("click", "deltas"), of("purchase", "trades"), of("signup", "snapshots"))


@query("SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) = '7' OR c_name = 'Customer#000000009' OR c_mktsegment = 'BUILDING'")
def param_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return spark.sql("SELECT c_custkey, c_name FROM {c} WHERE CAST(c_custkey AS STRING) = :m OR c_name = :slug OR c_mktsegment = :segment", args={"m": "7", "slug": "Customer#000000009", "segment": "BUILDING"}, c=c)


# --- ticks, windows, gaps -------------------------------------------------------------------------------------

_HOURS = "(SELECT DISTINCT ms - ms % 3600000 AS boundary FROM e)"


@query(f"""
WITH e AS {_E}, b AS {_HOURS},
t AS (SELECT ms AS ts, CAST(round(value * 100) AS BIGINT) AS cents FROM e WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY ms ORDER BY event_id) = 1)
SELECT b.boundary, count(t.ts) AS ticks, CAST(sum(t.cents) // count(t.ts) AS BIGINT) AS mean_cents FROM b LEFT JOIN t ON t.ts BETWEEN b.boundary - 3720000 AND b.boundary - 180000 GROUP BY b.boundary""")
def twap_boundary(spark, sf_dir):
    e = stream(spark, sf_dir)
    ticks = e.where("event_type = 'click'").select(F.col("ms").alias("ts"), F.col("event_id").alias("ord"), (F.round(F.col("value") * 100).cast("decimal(20,0)")).alias("scaled"))
    hours = e.select(S.window_start(F.col("ms"), 3_600_000).alias("boundary")).distinct()
    return bands.twap(ticks, hours, -3_720_000, -180_000, 60_000).select("boundary", "ticks", F.col("mean_scaled").cast("long").alias("mean_cents"))


@query(f"""
WITH t AS (SELECT ms // 60000 AS minute, event_id AS ord, CAST(round(value * 100) AS BIGINT) AS cents, event_type = 'click' AS live FROM {_E})
SELECT minute, CAST(coalesce(arg_max(cents, ord) FILTER (live), arg_min(cents, ord)) AS BIGINT) AS cents FROM t GROUP BY minute""")
def tick_dedupe_live_wins(spark, sf_dir):
    e = stream(spark, sf_dir)
    exact = F.round(F.col("value") * 100).cast("long").cast("string")
    ticks = e.select(F.expr("ms div 60000").alias("ts"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "click", exact).otherwise("").alias("scaled"), (F.round(F.col("value") * 100) / 1e8).alias("price"))
    one = bands.one_tick_per_time(ticks)
    # a rough price comes back in units of 1e-18: the cents were put 8 decimals down
    live = F.col("scaled") < F.lit(10**10)
    return one.select(F.col("ts").alias("minute"), F.when(live, F.col("scaled")).otherwise(F.floor(F.col("scaled") / F.lit(10**10))).cast("long").alias("cents"))


@query(f"""
WITH e AS {_E}, w AS (SELECT DISTINCT ms - ms % 900000 AS ws FROM e WHERE event_type = 'signup')
SELECT w.ws, count(DISTINCT e.ms // 60000) AS n FROM w LEFT JOIN e ON e.ms >= w.ws AND e.ms < w.ws + 900000 AND e.event_type = 'view' GROUP BY w.ws""")
def ticks_in_window(spark, sf_dir):
    e = stream(spark, sf_dir)
    ws = e.where("event_type = 'signup'").select(S.window_start(F.col("ms"), 900_000).alias("ws")).distinct().withColumn("last", F.col("ws") + 899_999)
    met = bands.points_in_ranges(e.where("event_type = 'view'").select("ms"), "ms", ws, "ws", "last", 900_000).groupBy("ws").agg(F.countDistinct(F.expr("ms div 60000")).alias("n"))
    return ws.select("ws").join(met, "ws", "left").select("ws", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""
WITH e AS {_E}, w AS (SELECT user_id, min(ms) FILTER (event_type = 'signup') AS ws, min(ms) FILTER (event_type = 'signup') + 864000000 AS we FROM e GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup') > 0),
g AS (SELECT e.user_id, least(ms, we) - greatest(coalesce(lag(ms) OVER (PARTITION BY e.user_id ORDER BY event_id), ws), ws) AS gap, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id DESC) AS back, ms FROM e JOIN w USING (user_id))
SELECT w.user_id, w.ws, w.we, greatest(coalesce(max(g.gap), 0), any_value(w.we) - coalesce(max(g.ms) FILTER (back = 1), any_value(w.ws))) AS max_gap FROM w LEFT JOIN g USING (user_id) GROUP BY w.user_id, w.ws, w.we""")
def window_max_gap(spark, sf_dir):
    e = stream(spark, sf_dir).select("user_id", "event_id", "ms", "event_type")
    w = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ms").alias("ws")).withColumn("we", F.col("ws") + 864_000_000)
    return gaps.largest_gap(e.drop("event_type"), "user_id", "ms", ["event_id"], w, "ws", "we")


@query(f"""
SELECT * FROM (SELECT max(ms) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "start", ms AS "end", ms - max(ms) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM {_E} WHERE event_type <> 'view') WHERE gap > 900000""")
def global_silence_gaps(spark, sf_dir):
    e = stream(spark, sf_dir).where("event_type <> 'view'").select("event_id", "ms")
    return gaps.silences(e, "ms", ["event_id"], F.expr("event_id div 512"), 900_000)


_HOLES = "(SELECT ms - CAST(floor(value * 60000) AS BIGINT) AS hs, ms AS he FROM e WHERE event_type = 'error')"


@query(f"""
WITH e AS {_E}, h AS {_HOLES}, w AS (SELECT DISTINCT ms - ms % 3600000 AS ws, ms - ms % 3600000 + 3600000 AS we FROM e)
SELECT w.ws, w.we, coalesce(max(least(h.he, w.we) - greatest(h.hs, w.ws)) FILTER (h.he IS NOT NULL), 0) AS hole_ms FROM w LEFT JOIN h ON h.he > w.ws AND h.hs < w.we GROUP BY w.ws, w.we""")
def gap_overlap_clamped(spark, sf_dir):
    e = stream(spark, sf_dir)
    start = S.window_start(F.col("ms"), 3_600_000)
    w = e.select(start.alias("ws"), (start + 3_600_000).alias("we")).distinct()
    holes = e.where("event_type = 'error'").select((F.col("ms") - F.floor(F.col("value") * 60000)).alias("hs"), F.col("ms").alias("he"))
    return bands.longest_overlap(holes, ("hs", "he"), w, ("ws", "we"), 3_600_000, ["ws", "we"], "hole_ms").select("ws", "we", "hole_ms")


@query(f"""
WITH e AS {_E}, g AS (SELECT user_id, ms - 1800000 AS gs, ms AS ge, k FROM e WHERE event_type = 'error'), w AS (SELECT user_id, event_id, ms AS ws, ms + 3600000 AS we FROM e WHERE event_type = 'signup')
SELECT w.event_id, count(*) AS gaps, max(g.k) AS worst FROM w JOIN g ON g.user_id = w.user_id AND g.ge > w.ws AND g.gs < w.we GROUP BY w.event_id""")
def spot_gap_overlap(spark, sf_dir):
    e = stream(spark, sf_dir)
    g = e.where("event_type = 'error'").select("user_id", (F.col("ms") - 1_800_000).alias("gs"), F.col("ms").alias("ge"), "k")
    w = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("ms").alias("ws"), (F.col("ms") + 3_600_000).alias("we"))
    return bands.overlaps(g, ("gs", "ge"), w, ("ws", "we"), 3_600_000, ["user_id"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("gaps"), F.max("k").alias("worst"))


@query(f"""
WITH o AS (SELECT user_id, ms, ms < max(ms) OVER (PARTITION BY user_id ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM {_E})
SELECT user_id, count(*) AS events, CAST(coalesce(sum(CAST(late AS INTEGER)), 0) AS BIGINT) AS late, min(ms) AS first_t, max(ms) AS last_t FROM o GROUP BY user_id""")
def out_of_order_count(spark, sf_dir):
    return gaps.out_of_order(stream(spark, sf_dir), "ms", ["k", "event_id"], ["user_id"])


@query(f"SELECT event_id, user_id, event_type FROM (SELECT *, min(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id) AS o FROM {_E}) WHERE event_id > o")
def lookup_after_open(spark, sf_dir):
    return keyed.after_first(stream(spark, sf_dir), ["user_id"], F.col("event_id"), F.col("event_type") == "signup").select("event_id", "user_id", "event_type")


_FLAGS_SQL = f"""
WITH e AS {_E}, m AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS opens, count(*) FILTER (event_type = 'purchase') AS closes, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS ticks,
  arg_min(k, event_id) AS s0, arg_max(k, event_id) AS s1 FROM e GROUP BY user_id),
f AS (SELECT user_id, concat_ws(',', CASE WHEN closes < 12 THEN 'OPEN' END, CASE WHEN closes >= 12 AND opens = 0 THEN 'NOCLOB' WHEN closes >= 12 AND opens > 15 THEN 'LATE' END, CASE WHEN errors > 14 THEN 'GAP' END, CASE WHEN ticks < 12 THEN 'CLTICKS' END, CASE WHEN s1 % 5 = 0 THEN 'NORES' END, CASE WHEN s0 <> s1 AND s0 % 3 = 0 THEN 'SETTLE' END) AS flags FROM m)
"""


def _health(spark, sf_dir) -> DataFrame:
    of = lambda k: F.count_if(F.col("event_type") == k)
    m = stream(spark, sf_dir).groupBy("user_id").agg(of("signup").alias("opens"), of("purchase").alias("closes"), of("error").alias("errors"), of("click").alias("ticks"), F.min_by("k", "event_id").alias("s0"), F.max_by("k", "event_id").alias("s1"))
    opened = F.col("closes") >= 12
    flags = S.flag_list(
        (~opened, "OPEN"), (opened & (F.col("opens") == 0), "NOCLOB"), (opened & (F.col("opens") > 15), "LATE"), (F.col("errors") > 14, "GAP"),
        (F.col("ticks") < 12, "CLTICKS"), (F.col("s1") % 5 == 0, "NORES"), ((F.col("s0") != F.col("s1")) & (F.col("s0") % 3 == 0), "SETTLE"),
    )
    return m.select("user_id", flags.alias("flags"))


@query(_FLAGS_SQL + "SELECT user_id, flags, regexp_matches(flags, 'OPEN|NOCLOB|LATE|GAP|NORES|SETTLE') AS excluded FROM f")
def health_flags(spark, sf_dir):
    return _health(spark, sf_dir).select("user_id", "flags", S.excluded(F.col("flags")).alias("excluded"))


@query(_FLAGS_SQL + "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM f WHERE flags <> '') GROUP BY flag")
def flag_histogram(spark, sf_dir):
    return _health(spark, sf_dir).where("flags <> ''").select(F.explode(F.split("flags", ",")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, CASE WHEN s1 > s0 THEN 'UP' WHEN s1 < s0 THEN 'DOWN' ELSE 'UP' END AS outcome FROM (SELECT user_id, arg_min(k, event_id) AS s0, arg_max(k, event_id) AS s1 FROM {_E} GROUP BY user_id)")
def outcome_tie_rule(spark, sf_dir):
    m = stream(spark, sf_dir).groupBy("user_id").agg(F.min_by("k", "event_id").alias("s0"), F.max_by("k", "event_id").alias("s1"))
    return m.select("user_id", S.outcome(F.col("s0"), F.col("s1")).alias("outcome"))


# --- fees -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity * (0.07 * pow(l_discount * (1.0::DOUBLE - l_discount), 1.0)) * 100000 + 0.5) / 100000.0::DOUBLE AS fee FROM lineitem")
def taker_fee(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.taker_fee(F.col("l_quantity"), F.col("l_discount"), F.lit(0.07), F.lit(1.0)).alias("fee"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * (0.07 * pow(l_discount * (1.0::DOUBLE - l_discount), 1.0)), 9) AS fee_eq FROM lineitem")
def maker_fee_equivalent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.maker_fee_equivalent(F.col("l_quantity"), F.col("l_discount"), F.lit(0.07), F.lit(1.0)), 9).alias("fee_eq"))


@query("""
WITH l AS (SELECT l_suppkey, l_partkey % 5 AS maker, CAST(floor(l_quantity * (0.07 * pow(l_discount * (1.0::DOUBLE - l_discount), 1.0)) * 100000 + 0.5) AS BIGINT) AS u FROM lineitem),
g AS (SELECT l_suppkey, maker, sum(u) AS ours FROM l GROUP BY ALL),
t AS (SELECT l_suppkey, sum(ours) AS total FROM g GROUP BY l_suppkey)
SELECT l_suppkey, maker, CASE WHEN total <= 0 THEN 0.0 ELSE round(CAST(ours AS DOUBLE) / CAST(total AS DOUBLE) * 0.2 * (CAST(total AS DOUBLE) / 100000.0::DOUBLE), 6) END AS rebate FROM g JOIN t USING (l_suppkey)""")
def maker_rebate(spark, sf_dir):
    u = S.half_up(F.col("l_quantity") * S.fee_per_share(F.col("l_discount"), F.lit(0.07), F.lit(1.0)) * 100000).cast("long")
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 5).alias("maker")).agg(F.sum(u).alias("ours"))
    total = F.sum("ours").over(W.partitionBy("l_suppkey"))  # at most one row for each maker and supplier
    return g.withColumn("total", total).select("l_suppkey", "maker", F.round(S.maker_rebate(F.col("ours").cast("double"), F.col("total").cast("double"), F.col("total").cast("double") / 1e5, F.lit(0.2)), 6).alias("rebate"))


# --- books ----------------------------------------------------------------------------------------------------

#: events as level changes: even users' even events are DOWN, clicks and views bid, the rest ask.
_CHANGES = f"(SELECT event_id, user_id, event_id // 50 AS msg, CASE WHEN event_id % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS token, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, k * 10000 AS key, floor(value / 100) + 1 AS size FROM {_E} WHERE k BETWEEN 1 AND 99)"


def _changes(spark, sf_dir) -> DataFrame:
    return stream(spark, sf_dir).where(F.col("k").between(1, 99)).select("event_id", "user_id", F.expr("event_id div 50").alias("msg"), F.when(F.col("event_id") % 2 == 0, "UP").otherwise("DOWN").alias("token"), F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.col("k") * 10_000).alias("key"), (F.floor(F.col("value") / 100) + 1).cast("double").alias("size"))


@query(f"""
WITH c AS {_CHANGES},
u AS (SELECT event_id, msg, token, CASE WHEN token = 'UP' THEN side WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END AS s, CASE WHEN token = 'UP' THEN key ELSE 1000000 - key END AS p, size FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY msg, token, s, p, size ORDER BY event_id) AS rn FROM u)
SELECT event_id, token FROM n d WHERE token = 'UP' OR NOT EXISTS (SELECT 1 FROM n x WHERE x.token = 'UP' AND x.msg = d.msg AND x.s = d.s AND x.p = d.p AND x.size = d.size AND x.rn = d.rn)""")
def mirror_dedupe(spark, sf_dir):
    return book.without_mirrors(_changes(spark, sf_dir), ["msg"], "event_id").select("event_id", "token")


@query(f"""
WITH c AS {_CHANGES},
u AS (SELECT user_id, CASE WHEN token = 'UP' THEN side WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN token = 'UP' THEN key ELSE 1000000 - key END AS key FROM c)
SELECT user_id, max(key) FILTER (side = 'BUY') AS bid, min(key) FILTER (side = 'SELL') AS ask FROM u GROUP BY user_id""")
def mirror_book_quote(spark, sf_dir):
    return book.quote(book.mirrored(_changes(spark, sf_dir)), ["user_id"])


@query(f"""
WITH e AS {_E}, r AS (SELECT user_id, max(event_id) AS epoch FROM e WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, k, size FROM (SELECT e.user_id, k, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS size, row_number() OVER (PARTITION BY e.user_id, k ORDER BY event_id DESC) AS rn
  FROM e LEFT JOIN r USING (user_id) WHERE (epoch IS NULL OR event_id >= epoch) AND event_type <> 'purchase') WHERE rn = 1 AND size > 1e-9""")
def book_last_write(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("size", F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")))
    last = book.last_writes(e, ["user_id"], ["k"], "event_id", F.col("event_type") == "signup", F.col("event_type") != "purchase")
    return last.where(F.col("size") > S.NO_SIZE).select("user_id", "k", "size")


@query(f"""
WITH e AS {_E}, r AS (SELECT user_id, max(event_id) AS epoch FROM e WHERE event_type = 'signup' GROUP BY user_id),
s AS (SELECT e.*, epoch FROM e LEFT JOIN r USING (user_id) WHERE epoch IS NULL OR event_id >= epoch),
w AS (SELECT * FROM s WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1)
SELECT user_id, k AS key, value AS size FROM w WHERE event_type <> 'error' AND value > 1e-9
  AND NOT EXISTS (SELECT 1 FROM s x WHERE x.user_id = w.user_id AND x.event_type = 'purchase' AND x.epoch IS NOT NULL AND x.event_id > w.event_id AND x.k < w.k)""")
def book_pruned(spark, sf_dir):
    e = stream(spark, sf_dir).withColumnsRenamed({"k": "key", "value": "size"})
    kind = F.col("event_type")
    return book.pruned_bids(e, ["user_id"], "event_id", kind == "signup", kind.isin("signup", "click", "view"), kind == "error", kind == "purchase")


@query(f"""
WITH a AS (SELECT user_id, k, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS ours FROM {_E} WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, k, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS theirs FROM {_E} WHERE event_type = 'view' GROUP BY ALL)
SELECT user_id, k, coalesce(ours, 0.0) AS ours, coalesce(theirs, 0.0) AS theirs FROM a FULL JOIN b USING (user_id, k) WHERE abs(coalesce(ours, 0.0) - coalesce(theirs, 0.0)) > 1e-9""")
def snapshot_diff(spark, sf_dir):
    e = stream(spark, sf_dir)
    side = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id", "k").agg(F.sum(F.floor("value")).cast("double").alias("size"))
    return book.snapshot_difference(side("click"), side("view"), ["user_id", "k"])


@query(f"""
WITH c AS (SELECT user_id, side, key, max(size)::BIGINT AS size FROM {_CHANGES} GROUP BY ALL)
SELECT user_id, sha256('b[' || coalesce(string_agg(key || ':' || size, ',' ORDER BY key) FILTER (side = 'BUY'), '') || ']a[' || coalesce(string_agg(key || ':' || size, ',' ORDER BY key) FILTER (side = 'SELL'), '') || ']') AS digest FROM c GROUP BY user_id""")
def book_digest(spark, sf_dir):
    levels = _changes(spark, sf_dir).groupBy("user_id", "side", "key").agg(F.max("size").cast("long").alias("size"))
    return book.digest(levels, ["user_id"]).select("user_id", F.col("sha256").alias("digest"))


# --- streams, scalars -----------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def tumbling_15m(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "15 minutes")["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "cents")


@query(f"""
SELECT user_id, ms, missing FROM (SELECT user_id, ms, ms - max(ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 43200000 AS missing FROM {_E}) WHERE missing > 0""")
def sequence_breaks(spark, sf_dir):
    return gaps.sequence_breaks(stream(spark, sf_dir), "ms", ["event_id"], ["user_id"], 43_200_000)


@query(f"""
SELECT user_id, s[len(s) // 2 + 1] AS median_upper, s[least(len(s), CAST(floor(len(s) * 0.9) AS BIGINT) + 1)] AS p90 FROM (SELECT user_id, list_sort(list(k)) AS s FROM {_E} WHERE k IS NOT NULL GROUP BY user_id)""")
def latency_percentile(spark, sf_dir):
    # frequencies per value come first, so that a hot key never gathers its rows
    e = stream(spark, sf_dir).where("k is not null").groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("user_id")
    e = e.withColumn("upto", F.sum("n").over(w.orderBy("k"))).withColumn("total", F.sum("n").over(w))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("k")))
    return e.groupBy("user_id").agg(at(F.expr("total div 2") + 1).alias("median_upper"), at(F.least(F.col("total"), F.floor(F.col("total") * 0.9) + 1)).alias("p90"))


@query(f"""
WITH e AS {_E} SELECT p.event_id, p.user_id, q.k AS quote FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ms, max(k) AS k FROM e WHERE event_type = 'click' GROUP BY ALL) q ON p.user_id = q.user_id AND p.ms >= q.ms""")
def asof_quote(spark, sf_dir):
    e = stream(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ms")
    right = e.where("event_type = 'click'").groupBy("user_id", "ms").agg(F.max("k").alias("quote"))
    return keyed.asof(left, right, ["user_id"], "ms", "quote").select("event_id", "user_id", "quote")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 79, false) AS valid FROM events")
def json_extract_validate(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", "k", F.coalesce(F.col("k").between(0, 79), F.lit(False)).alias("valid"))


@query(f"SELECT event_id, ms - ms % 900000 AS window_start, 'btc-updown-15m-' || CAST((ms - ms % 900000) // 1000 AS VARCHAR) AS slug FROM {_E}")
def window_slug(spark, sf_dir):
    start = S.window_start(F.col("ms"), 900_000)
    return stream(spark, sf_dir).select("event_id", start.alias("window_start"), S.slug("btc-updown-15m", start).alias("slug"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority) AS digest FROM orders")
def event_digest(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").cast("binary"), 256).alias("digest"))


# --- raw lines and lifecycle ----------------------------------------------------------------------------------


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the stream's own kind of event: a market's book changes by two levels, recorded, parsed and validated."""
    e = stream(spark, sf_dir).where("k is not null").repartition("event_id")  # writing and parsing the lines of a file is many tasks' work
    change = lambda side, price, size: F.struct(F.lit("UP").alias("token"), F.lit(side).alias("side"), price.alias("price"), size.alias("size"))
    changes = F.array(change("BUY", F.col("k") / 200, (F.col("event_id") % 7).cast("double")), change("SELL", 1 - F.col("k") / 200, (F.col("event_id") % 5).cast("double")))
    line = F.struct(F.lit("book_delta").alias("kind"), F.col("user_id").cast("string").alias("marketId"), F.col("ms").cast("double").alias("exchangeTs"), (F.col("ms") * 1_000_000).cast("string").alias("recvTs"), F.struct(changes.alias("changes")).alias("payload"))
    lines = e.select(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.col("event_id").cast("int").alias("line"), F.to_json(line).alias("value"))
    return raw.events_of(raw.parsed(stored(lines, "lines")))  # stored: a filter on what was parsed would go below the shuffle, and parse there too


_CHANGES = f"(SELECT event_id, user_id, ms, 0 AS idx, 'BUY' AS side, k / 200.0 AS price, event_id % 7 AS size FROM {_E} WHERE k IS NOT NULL UNION ALL SELECT event_id, user_id, ms, 1, 'SELL', 1 - k / 200.0, event_id % 5 FROM {_E} WHERE k IS NOT NULL)"


@query(f"SELECT CAST(event_id AS INTEGER) AS line, ms * 1000000 AS recv_ts, ms AS exchange_ts, CAST(user_id AS VARCHAR) AS market_id, CAST(idx AS SMALLINT) AS idx, side, CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size FROM {_CHANGES}")
def lake_rows(spark, sf_dir):
    return lake.rows_for(recorded(spark, sf_dir), "book_deltas").select("line", "recv_ts", "exchange_ts", "market_id", "idx", "side", "price", "size")


@query(f"SELECT CAST(event_id AS INTEGER) AS line, CAST(user_id AS VARCHAR) AS market_id, 2 AS changes, CAST(k / 200.0 AS DOUBLE) AS bid, CAST(1 - k / 200.0 AS DOUBLE) AS ask, CAST(event_id % 5 AS DOUBLE) AS ask_size FROM {_E} WHERE k IS NOT NULL")
def lake_round_trip(spark, sf_dir):
    e = lake.events_for(lake.rows_for(recorded(spark, sf_dir), "book_deltas"), "book_deltas")
    c = lambda i: F.col("payload.changes")[i]
    return e.select("line", "market_id", F.size("payload.changes").alias("changes"), c(0)["price"].alias("bid"), c(1)["price"].alias("ask"), c(1)["size"].alias("ask_size"))


@query(f"""
WITH l AS (SELECT user_id, side, CAST(round(price * 1000000) AS BIGINT) AS key, arg_max(size, event_id * 2 + idx) AS size FROM {_CHANGES} GROUP BY ALL),
t AS (SELECT user_id, coalesce(string_agg(key || ':' || size, ',' ORDER BY key) FILTER (side = 'BUY' AND size > 0), '') AS b, coalesce(string_agg(key || ':' || size, ',' ORDER BY key) FILTER (side = 'SELL' AND size > 0), '') AS a FROM l GROUP BY user_id),
n AS (SELECT user_id, count(*) AS changes FROM {_CHANGES} GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS market_id, changes, changes AS unsynced_changes, 'b[' || b || ']a[' || a || ']' AS book, false AS closed FROM t JOIN n USING (user_id)""")
def books_verified(spark, sf_dir):
    return book.verified_books(recorded(spark, sf_dir)).select("market_id", "changes", "unsynced_changes", "book", "closed")


@query(f"""
SELECT CAST(event_id AS INTEGER) AS line, sha256('{{"exchange_ts":' || ms || ',"kind":"book_delta","market_id":"' || user_id || '","payload":{{"changes":[{{"token":"UP","side":"BUY","price":' || CAST(CAST(k / 200.0 AS DOUBLE) AS VARCHAR) || ',"size":' || CAST(CAST(event_id % 7 AS DOUBLE) AS VARCHAR) || '}},{{"token":"UP","side":"SELL","price":' || CAST(CAST(1 - k / 200.0 AS DOUBLE) AS VARCHAR) || ',"size":' || CAST(CAST(event_id % 5 AS DOUBLE) AS VARCHAR) || '}}]}},"recv_ts":' || ms * 1000000 || '}}') AS sha256 FROM {_E} WHERE k IS NOT NULL""")
def canonical_lines(spark, sf_dir):
    return raw.canonical(recorded(spark, sf_dir)).select("line", "sha256")


_LINES = f"""SELECT event_id, ms, sha256('{{"exchange_ts":' || ms || ',"kind":"book_delta","market_id":"' || user_id || '","payload":{{"changes":[{{"token":"UP","side":"BUY","price":' || CAST(CAST(k / 200.0 AS DOUBLE) AS VARCHAR) || ',"size":' || CAST(CAST(event_id % 7 AS DOUBLE) AS VARCHAR) || '}},{{"token":"UP","side":"SELL","price":' || CAST(CAST(1 - k / 200.0 AS DOUBLE) AS VARCHAR) || ',"size":' || CAST(CAST(event_id % 5 AS DOUBLE) AS VARCHAR) || '}}]}},"recv_ts":' || ms * 1000000 || '}}') AS h FROM {_E} WHERE k IS NOT NULL"""


@query(f"""
WITH l AS ({_LINES}), d AS (SELECT CAST(make_timestamp(ms * 1000) AS DATE) AS date, CAST(hour(make_timestamp(ms * 1000)) AS INTEGER) AS hour, event_id, h FROM l),
n AS (SELECT date, hour, event_id // 4096 AS leaf, count(*) AS lines, sha256(string_agg(h, '' ORDER BY event_id)) AS h FROM d GROUP BY ALL)
SELECT date, hour, leaf, lines, h AS sha256 FROM n""")
def replay_leaves(spark, sf_dir):
    """Leaves of the hash tree over a replay."""
    return digest.leaves(raw.canonical(recorded(spark, sf_dir)))


@query(f"""
WITH l AS ({_LINES}), d AS (SELECT epoch_us(make_timestamp(ms * 1000)) // 86400000000 AS day, hour(make_timestamp(ms * 1000)) AS hour, event_id, h FROM l),
n AS (SELECT day, hour, event_id // 4096 AS node, sha256(string_agg(h, '' ORDER BY event_id)) AS h FROM d GROUP BY ALL),
a AS (SELECT day, hour, node // 256 AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM n GROUP BY ALL),
b AS (SELECT day, hour, node // 256 AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM a GROUP BY ALL),
c AS (SELECT day, hour, sha256(string_agg(h, '' ORDER BY node)) AS h FROM b GROUP BY ALL),
t0 AS (SELECT day AS node, sha256(string_agg(h, '' ORDER BY hour)) AS h FROM c GROUP BY ALL),
t1 AS (SELECT node // 256 AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM t0 GROUP BY 1),
t2 AS (SELECT node // 256 AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM t1 GROUP BY 1),
t3 AS (SELECT node // 256 AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM t2 GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY node)) AS sha256 FROM t3""")
def replay_root(spark, sf_dir):
    """One hash of a whole replay in its order."""
    return digest.root(raw.canonical(recorded(spark, sf_dir)))


@query(f"""SELECT CAST(make_timestamp(ms * 1000) AS DATE) AS date, CAST(hour(make_timestamp(ms * 1000)) AS INTEGER) AS hour, CAST(event_id AS INTEGER) AS line, event_id % 2 = 0 AS on_the_right
FROM {_E} WHERE k IS NOT NULL AND event_id % 1009 = 700 ORDER BY ms, event_id LIMIT 1""")
def replay_first_difference(spark, sf_dir):
    """Where a replay first departs from one in which some lines were lost and others changed; found by the trees' descent."""
    events = stored(recorded(spark, sf_dir), "events")  # both replays are made from them, and the leaf that differs is looked up in them
    whole = raw.canonical(events)
    odd = F.col("line") % 1009 == 700
    other = raw.canonical(events.where(~odd | (F.col("line") % 2 == 0)).withColumn("exchange_ts", F.when(odd, F.col("exchange_ts") + 1).otherwise(F.col("exchange_ts"))))
    return digest.first_difference(whole, other).select("date", "hour", "line", F.col("right").isNotNull().alias("on_the_right"))


@query(f"""SELECT event_type AS source_kind, count(*) AS events, CAST(sum(ms % 1000) AS BIGINT) AS ms, count(*) FILTER (value <= 0) AS bad FROM {_E} GROUP BY event_type""")
def replay_events(spark, sf_dir):
    """events as raw lines and back: encoded, parsed, validated; every line must come out as an event."""
    e = stream(spark, sf_dir)
    payload = F.struct(F.lit("chainlink").alias("source"), F.col("event_type").alias("symbol"), F.col("value").alias("price"))
    line = F.struct(F.lit("res_price").alias("kind"), F.col("ms").cast("double").alias("exchangeTs"), (F.col("ms") * 1_000_000).cast("string").alias("recvTs"), payload.alias("payload"))
    lines = e.select(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.col("event_id").cast("int").alias("line"), F.to_json(line).alias("value"))
    parsed = raw.parsed(lines)
    return parsed.groupBy(F.col("payload.symbol").alias("source_kind")).agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("exchangeTs") % 1000).cast("long")).alias("ms"), F.count_if(~F.col("ok")).alias("bad"))


@query(f"""
WITH w AS (SELECT DISTINCT ms - ms % 3600000 AS window_start FROM {_E}), n AS (SELECT 1705500000000 AS now)
SELECT window_start, CASE WHEN now < window_start - 120000 THEN 'future' WHEN now < window_start THEN 'registered' WHEN now < window_start + 3600000 THEN 'open' WHEN window_start // 3600000 % 2 = 0 THEN 'resolved'
  WHEN now < window_start + 3630000 THEN 'closed' WHEN now < window_start + 7200000 THEN 'awaiting' ELSE 'given_up' END AS stage FROM w, n""")
def market_stages(spark, sf_dir):
    w = stream(spark, sf_dir).select(S.window_start(F.col("ms"), 3_600_000).alias("window_start")).distinct()
    w = w.select("window_start", (F.col("window_start") + 3_600_000).alias("window_end"), (F.expr("window_start div 3600000 % 2") == 0).alias("resolved"))
    return lifecycle.standing(w, 1_705_500_000_000).select("window_start", "stage")


@query(f"SELECT user_id, s AS \"start\", ms AS \"end\", ms - s AS gap_ms FROM (SELECT user_id, ms, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS s FROM {_E}) WHERE ms - s > 86400000")
def feed_silences(spark, sf_dir):
    return lifecycle.feed_gaps(stream(spark, sf_dir), ["user_id"], "ms", 86_400_000)
