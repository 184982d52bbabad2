"""Queries on a stream of all eleven kinds of event, made from the driver's events by rule, through the library's own path.

A market is a user. Most events change two levels and report best prices; the rest are snapshots (also of DOWN and without
a token), gaps, second openings, trades, tick sizes, closes, resolutions, quotes and reference ticks. RECORDED is the same
stream in SQL, so each query is checked from the driver's tables on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators import book, verify
from tidebook.operators.book import STATS
from tidebook.plans.market import _E, Query, stream
from tidebook.session import scratch, stored
from tidebook.sources import datasource, hours, lake, raw
from tidebook.streaming import market_state

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Kind of an event by its number, type and k.
_KIND = """CASE WHEN event_id % 41 = 0 THEN 'market_open' WHEN event_type = 'signup' AND k % 4 = 0 THEN 'book_snapshot' WHEN event_type = 'signup' AND k % 4 = 1 THEN 'trade'
  WHEN event_type = 'error' AND k % 10 = 0 THEN 'feed_gap' WHEN event_type = 'error' AND k % 10 = 1 THEN 'tick_size_change' WHEN event_type = 'error' AND k % 10 = 2 THEN 'venue_raw'
  WHEN event_type = 'error' AND k % 10 IN (3, 4) THEN 'spot' WHEN event_type = 'error' AND k % 10 IN (5, 6) THEN 'res_price' WHEN event_type = 'purchase' AND k % 25 = 0 THEN 'resolution'
  WHEN event_type = 'purchase' AND k % 25 = 1 THEN 'market_close' ELSE 'book_delta' END"""


def _twentieth(n: Column) -> Column:
    return n / F.lit(20.0)


def lines(events: DataFrame) -> DataFrame:
    """(date, hour, line, value): events (event_id, user_id, event_type, ms, k) as lines of raw hours."""
    e = events.where("k is not null").withColumn("kind", F.expr(_KIND))
    n, k = F.col("event_id"), F.col("k")
    best = lambda own, empty: F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.lit(empty)).when(n % 5 == 2, own).otherwise(_twentieth((k * 7 + n) % 19 + 1)).cast("double")

    def change(i: int) -> Column:
        price = _twentieth((k + n * i * 3) % 19 + 1)
        token, side = F.when((n + i) % 3 == 0, "DOWN").otherwise("UP"), F.when((k + i) % 2 == 0, "BUY").otherwise("SELL")
        return F.struct(token.alias("token"), side.alias("side"), price.alias("price"), ((n + i) % 4).cast("double").alias("size"), best(price, 0.0).alias("bestBid"), best(price, 1.0).alias("bestAsk"))

    levels = lambda shift: F.array(*[F.struct(_twentieth((k * 3 + shift + i * 4) % 19 + 1).alias("price"), ((n + i) % 4).cast("double").alias("size")) for i in range(3)])
    start = F.col("ms") - F.col("ms") % 900_000
    kind = lambda *names: F.col("kind").isin(*names)
    own = {
        "changes": F.when(kind("book_delta"), F.array(change(0), change(1))), "bids": F.when(kind("book_snapshot"), levels(0)), "asks": F.when(kind("book_snapshot"), levels(2)), "hash": F.when(kind("book_snapshot"), F.lit("h")),
        "price": F.when(kind("trade"), _twentieth(k % 19 + 1)).when(kind("res_price"), F.col("event_id") + 0.5), "size": F.when(kind("trade"), F.lit(1.0) + k), "side": F.when(kind("trade"), F.when(n % 2 == 0, "BUY").otherwise("SELL")),
        "feeRateBps": F.when(kind("trade"), F.lit(0.0)), "txHash": F.when(kind("trade"), n.cast("string")), "type": F.when(kind("spot"), F.lit("bbo")), "source": F.when(kind("spot"), F.when(n % 2 == 0, "binance").otherwise("coinbase")).when(kind("res_price"), "chainlink"),
        "bid": F.when(kind("spot"), k + 1.0), "bidSize": F.when(kind("spot"), F.lit(1.0)), "ask": F.when(kind("spot"), k + 2.0), "askSize": F.when(kind("spot"), F.lit(2.0)), "symbol": F.when(kind("res_price"), F.lit("btc/usd")),
        "slug": F.when(kind("market_open"), F.concat(F.lit("m-"), F.col("user_id").cast("string"))), "upTokenId": F.when(kind("market_open"), F.lit("u")), "downTokenId": F.when(kind("market_open"), F.lit("d")),
        "windowStart": F.when(kind("market_open"), start.cast("double")), "windowEnd": F.when(kind("market_open", "market_close"), (start + 900_000).cast("double")), "tickSize": F.when(kind("market_open"), F.lit(0.01)), "minOrderSize": F.when(kind("market_open"), F.lit(5.0)),
        "feeSchedule": F.when(kind("market_open"), F.struct(F.lit(0.07).alias("rate"), F.lit(1.0).alias("exponent"), F.lit(True).alias("takerOnly"), F.lit(0.2).alias("rebateRate"))),
        "outcome": F.when(kind("resolution"), F.when(n % 2 == 0, "UP").otherwise("DOWN")), "priceToBeat": F.when(kind("resolution"), n + 1.0), "finalPrice": F.when(kind("resolution"), n + 2.0),
        "oldTickSize": F.when(kind("tick_size_change"), F.lit(0.01)), "newTickSize": F.when(kind("tick_size_change"), F.lit(0.001)), "feed": F.when(kind("feed_gap", "venue_raw"), F.lit("clob")),
        "gapMs": F.when(kind("feed_gap"), k * 10.0), "reason": F.when(kind("feed_gap"), F.when(n % 2 == 0, "silence").otherwise("sequence_break")), "eventType": F.when(kind("venue_raw"), F.lit("odd")), "data": F.when(kind("venue_raw"), F.lit("{}")),
    }
    market = F.when(~kind("spot", "res_price"), F.col("user_id").cast("string"))
    token = F.when(kind("book_snapshot", "trade", "tick_size_change"), F.when(n % 3 == 1, "UP").when(n % 3 == 2, "DOWN"))
    line = F.struct("kind", market.alias("marketId"), token.alias("token"), F.col("ms").cast("double").alias("exchangeTs"), (F.col("ms") * 1_000_000).cast("string").alias("recvTs"), F.struct(*[c.alias(name) for name, c in own.items()]).alias("payload"))
    at = F.timestamp_millis("ms")
    return e.select(F.to_date(at).alias("date"), F.hour(at).alias("hour"), F.col("event_id").cast("int").alias("line"), F.to_json(line).alias("value"))


def recorded(spark, sf_dir) -> DataFrame:
    """The stream of tidebook.schema that the lines hold. They are stored first: a plan that writes and parses them at once takes the optimizer long."""
    return raw.events_of(raw.parsed(stored(lines(_spread(stream(spark, sf_dir))), "lines")))


def _spread(events: DataFrame) -> DataFrame:
    """Events over all tasks: those of one file would be made lines, and parsed, by one."""
    return events.repartition("event_id")


#: The stream in SQL: events with their kind; changes and snapshot levels as UP sees them, asks with negative keys.
RECORDED = f"""
e AS (SELECT *, {_KIND} AS kind, CAST(user_id AS VARCHAR) AS m FROM {_E} WHERE k IS NOT NULL),
c0 AS (SELECT event_id, m, event_id * 2 + i AS pos, (event_id + i) % 3 = 0 AS down, (k + i) % 2 = 0 AS buy, ((k + event_id * i * 3) % 19 + 1) * 50000 AS key, (event_id + i) % 4 AS size,
  CASE event_id % 5 WHEN 2 THEN ((k + event_id * i * 3) % 19 + 1) * 50000 WHEN 3 THEN ((k * 7 + event_id) % 19 + 1) * 50000 WHEN 4 THEN ((k * 7 + event_id) % 19 + 1) * 50000 END AS best
  FROM e, (SELECT unnest([0, 1]) AS i) WHERE kind = 'book_delta'),
changes AS (SELECT event_id, m, pos, size, buy <> down AS buy, (CASE WHEN buy <> down THEN 1 ELSE -1 END) * (CASE WHEN down THEN 1000000 - key ELSE key END) AS key,
  CASE WHEN down THEN 1000000 - best ELSE best END AS bid, -(CASE WHEN down THEN 1000000 - best ELSE best END) AS ask FROM c0),
s0 AS (SELECT event_id, m, event_id * 2 AS pos, event_id % 3 = 2 AS down, b, ((k * 3 + CASE WHEN b THEN 0 ELSE 2 END + i * 4) % 19 + 1) * 50000 AS key, (event_id + i) % 4 AS size
  FROM e, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([true, false]) AS b) WHERE kind = 'book_snapshot'),
snaps AS (SELECT event_id, m, pos, size, b <> down AS buy, (CASE WHEN b <> down THEN 1 ELSE -1 END) * (CASE WHEN down THEN 1000000 - key ELSE key END) AS key FROM s0),
turns AS (SELECT m, event_id, kind = 'book_snapshot' AS up FROM e WHERE kind IN ('book_snapshot', 'feed_gap')
  UNION ALL SELECT m, event_id, false FROM e o WHERE kind = 'market_open' AND EXISTS (SELECT 1 FROM e x WHERE x.m = o.m AND x.kind = 'market_open' AND x.event_id < o.event_id)),
stepped AS (SELECT e.m, e.event_id, coalesce((SELECT arg_max(up, t.event_id) FROM turns t WHERE t.m = e.m AND t.event_id < e.event_id), false) AS synced FROM e WHERE kind IN ('book_delta', 'book_snapshot'))
"""

#: Lives of levels, and the checks, by comparing each with all reports of its market.
BOOKS = f"""
WITH {RECORDED},
reports AS (SELECT c.m, c.pos, coalesce(bid, -2000000) AS bid, coalesce(ask, -2000000) AS ask FROM changes c JOIN stepped s ON s.m = c.m AND s.event_id = c.event_id AND s.synced),
resets AS (SELECT m, event_id * 2 AS pos, event_id FROM e WHERE kind = 'book_snapshot'),
writes AS (SELECT m, buy, key, pos, size FROM changes UNION ALL SELECT m, buy, key, pos, size FROM snaps),
ended AS (SELECT w.*, lead(pos) OVER (PARTITION BY m, buy, key ORDER BY pos) AS nxt, (SELECT min(r.pos) FROM resets r WHERE r.m = w.m AND r.pos > w.pos) AS reset FROM writes w),
lives AS (SELECT *, least(coalesce(nxt, 1e15), coalesce(reset, 1e15)) AS fin FROM ended WHERE size > 0),
stabbed AS (SELECT l.*, EXISTS (SELECT 1 FROM reports r WHERE r.m = l.m AND r.pos >= l.pos AND r.pos < l.fin AND CASE WHEN l.buy THEN r.bid ELSE r.ask END < l.key) AS pruned FROM lives l),
named AS (SELECT m, pos, true AS buy, bid AS key FROM reports WHERE bid > -2000000 UNION ALL SELECT m, pos, false, ask FROM reports WHERE ask > -2000000),
misses AS (SELECT DISTINCT m, pos FROM named n WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.m = n.m AND l.buy = n.buy AND l.key = n.key AND l.pos <= n.pos AND l.fin > n.pos
  AND NOT EXISTS (SELECT 1 FROM reports r WHERE r.m = l.m AND r.pos >= l.pos AND r.pos <= n.pos AND CASE WHEN l.buy THEN r.bid ELSE r.ask END < l.key))),
theirs AS (SELECT n.m, n.event_id, buy, key, size FROM snaps n JOIN stepped s ON s.m = n.m AND s.event_id = n.event_id AND s.synced WHERE size > 0),
ours AS (SELECT l.m, r.event_id, buy, key, size FROM stabbed l JOIN resets r ON r.m = l.m AND r.pos = l.reset JOIN stepped s ON s.m = r.m AND s.event_id = r.event_id AND s.synced WHERE NOT pruned AND (nxt IS NULL OR nxt >= reset)),
tops AS (SELECT m, event_id, buy, max(key) AS top FROM theirs GROUP BY ALL),
differ AS (SELECT m, event_id, top IS NULL OR abs(key - top) <= 50000 AS near FROM (SELECT m, event_id, buy, key, coalesce(o.size, 0) AS a, coalesce(t.size, 0) AS b FROM ours o FULL JOIN theirs t USING (m, event_id, buy, key)) LEFT JOIN tops USING (m, event_id, buy) WHERE a <> b),
last AS (SELECT m, string_agg(key || ':' || size, ',' ORDER BY key) FILTER (buy) AS b, string_agg(-key || ':' || size, ',' ORDER BY -key) FILTER (NOT buy) AS a FROM stabbed WHERE NOT pruned AND fin = 1e15 GROUP BY m),
n AS (SELECT m, count(*) FILTER (kind = 'book_delta') * 2 AS changes, count(*) FILTER (kind = 'book_snapshot') AS snapshots, bool_or(kind = 'market_close') AS closed,
  arg_max(CASE WHEN event_id % 2 = 0 THEN 'UP' ELSE 'DOWN' END, event_id) FILTER (kind = 'resolution') AS outcome FROM e WHERE kind NOT IN ('spot', 'res_price') GROUP BY m)
SELECT n.m AS market_id, CAST(changes AS BIGINT) AS changes, CAST(changes - coalesce(r.n, 0) AS BIGINT) AS unsynced_changes, coalesce(p.n, 0) AS levels_pruned, coalesce(r.n, 0) AS bests_checked, coalesce(x.n, 0) AS best_mismatches, snapshots,
  coalesce(d.s, 0) AS snapshots_differing, coalesce(d.n, 0) AS levels_differing, coalesce(d.near, 0) AS near_top_differing, 'b[' || coalesce(l.b, '') || ']a[' || coalesce(l.a, '') || ']' AS book, coalesce(t.up, false) AS synced, closed, outcome
FROM n LEFT JOIN (SELECT m, count(*) AS n FROM reports GROUP BY m) r USING (m) LEFT JOIN (SELECT m, count(*) AS n FROM stabbed WHERE pruned GROUP BY m) p USING (m) LEFT JOIN (SELECT m, count(*) AS n FROM misses GROUP BY m) x USING (m)
LEFT JOIN (SELECT m, count(DISTINCT event_id) AS s, count(*) AS n, count(*) FILTER (near) AS near FROM differ GROUP BY m) d USING (m) LEFT JOIN last l USING (m) LEFT JOIN (SELECT m, arg_max(up, event_id) AS up FROM turns GROUP BY m) t USING (m)
"""


@query(BOOKS)
def books_as_intervals(spark, sf_dir):
    return verify.verified_books(recorded(spark, sf_dir)).drop("first_wrong")


@query(f"WITH {RECORDED} SELECT kind, count(*) AS n FROM e GROUP BY kind")
def recorded_kinds(spark, sf_dir):
    """All lines of the stream are valid events: none is lost on the way through text."""
    return recorded(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- the same stream as a stream ------------------------------------------------------------------------------


#: Files of the recorded stream; no more than one trigger takes, so that no event comes in a batch before an earlier one.
_STREAM_FILES = 32


def _streamed(spark, sf_dir) -> DataFrame:
    """The recorded stream, read as files of lines appear."""
    path = scratch(spark, "lines")
    made = lines(stream(spark, sf_dir).repartitionByRange(_STREAM_FILES, "event_id"))  # a file has a stretch of the stream
    made.write.parquet(path)
    return raw.events_of(raw.parsed(spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 64).parquet(path)))


@query(BOOKS)
def stream_market_state(spark, sf_dir):
    """Markets in typed state; each market's last row of the stream is its batch result. Nothing is given up meanwhile."""
    processor = market_state.MarketProcessor(give_up_ms=10**12, linger_ms=10**12, grace_ms=10**12, books=True)
    rows = market_state.run_all(market_state.markets(_streamed(spark, sf_dir), processor, "3650 days"), scratch(spark, "stream-markets"), scratch(spark, "checkpoint"))
    last = rows.where("event = 'update'").groupBy("market_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "market_id"]), "events").alias("r")).select("market_id", "r.*")
    columns = ["market_id", *(c.split()[0] for c in STATS.split(", ")), "book", "synced", "closed", "outcome"]
    return last.where("events > 0").select(*columns)


_FEED = "CASE WHEN kind = 'spot' THEN CASE WHEN event_id % 2 = 0 THEN 'spot:binance' ELSE 'spot:coinbase' END WHEN kind = 'res_price' THEN 'oracle' ELSE 'clob' END"


@query(f"""
WITH {RECORDED}, f AS (SELECT {_FEED} AS feed, event_id, ms, kind FROM e),
g AS (SELECT feed, ms, max(ms) OVER (PARTITION BY feed ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_ms FROM f WHERE kind <> 'feed_gap')
SELECT feed, start_ms, ms AS at_ms, ms - start_ms AS gap_ms FROM g WHERE ms - start_ms > 1800000""")
def stream_feed_gaps(spark, sf_dir):
    """Silences of each feed as its stream goes by, each reported once, when data resumes."""
    processor = market_state.FeedProcessor(silence_ms=1_800_000, down_ms=10**12, forget_ms=10**12)
    rows = market_state.run_all(market_state.feeds(_streamed(spark, sf_dir), processor, "3650 days"), scratch(spark, "stream-feeds"), scratch(spark, "checkpoint"))
    return rows.where("event = 'gap'").select("feed", "start_ms", "at_ms", "gap_ms")


@query(f"""
WITH {RECORDED}
SELECT {_FEED} AS feed, count(*) FILTER (kind <> 'feed_gap') AS events, count(*) FILTER (kind = 'feed_gap' AND event_id % 2 = 0) AS gaps, count(*) FILTER (kind = 'feed_gap' AND event_id % 2 = 1) AS sequence_breaks,
  CAST(0 AS BIGINT) AS reconnects, coalesce(max(k * 10.0) FILTER (kind = 'feed_gap'), 0.0) AS max_gap_ms FROM e GROUP BY 1""")
def feed_counters(spark, sf_dir):
    return market_state.feed_counters(recorded(spark, sf_dir))


# --- through the lake -----------------------------------------------------------------------------------------

#: Arrival by event in SQL and in Spark: the month of events in some hours, so that a lake has few of them.
_FAST = "1704067200000 + (ms - 1704067200000) // 120"


def _raw_hours(spark, sf_dir) -> str:
    """A folder with the recorded stream as raw hours, staged in two batches and closed."""
    e = stream(spark, sf_dir).withColumn("ms", F.expr(_FAST.replace("//", "div")))
    made, folder = stored(lines(_spread(e)), "lines"), scratch(spark, "lake")
    for batch in range(2):
        hours.stage(made.where(F.col("line") % 2 == batch), folder, batch)
    hours.close_hours(spark, folder)
    return folder


_HOURS = f"""
WITH {RECORDED}, f AS (SELECT *, {_FAST} AS am FROM e), h AS (SELECT *, CAST(make_timestamp(am * 1000) AS DATE) AS date, CAST(hour(make_timestamp(am * 1000)) AS INTEGER) AS hour FROM f)
"""


@query(_HOURS + "SELECT date, hour, count(*) AS lines, CAST(sum(am) AS BIGINT) AS at_sum FROM h GROUP BY ALL")
def raw_hours_scan(spark, sf_dir):
    """Raw hours that a stream's batches were closed into, read by the data source; each hour's lines are numbered without a gap."""
    datasource.register(spark)
    scan = spark.read.format("raw_hours").load(_raw_hours(spark, sf_dir))
    n = scan.groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"), F.sum(F.get_json_object("value", "$.exchangeTs").cast("double").cast("long")).alias("at_sum"))  # a sum of doubles is exact up to 2**53 only
    return n.select("date", "hour", F.when(F.col("n") == F.col("last"), F.col("n")).alias("lines"), "at_sum")


_ROWS = """CASE kind WHEN 'book_delta' THEN 'book_deltas' WHEN 'book_snapshot' THEN 'book_levels' WHEN 'trade' THEN 'trades' WHEN 'res_price' THEN 'res_prices' WHEN 'market_open' THEN 'market_opens' WHEN 'market_close' THEN 'market_closes'
  WHEN 'resolution' THEN 'resolutions' WHEN 'feed_gap' THEN 'feed_gaps' WHEN 'tick_size_change' THEN 'tick_size_changes' ELSE kind END"""


@query(_HOURS + f"SELECT {_ROWS} AS table_name, date, hour, CAST(sum(CASE kind WHEN 'book_delta' THEN 2 WHEN 'book_snapshot' THEN 6 ELSE 1 END) AS BIGINT) AS n FROM h GROUP BY ALL")
def lake_rows_filed(spark, sf_dir):
    """Raw hours compacted into the eleven tables: rows of each table and hour."""
    folder = _raw_hours(spark, sf_dir)
    lake.compact(spark, folder)
    return lake.rows_filed(spark, folder)


@query(_HOURS + """SELECT kind, count(*) AS n, CAST(sum(am) AS BIGINT) AS at_sum, count(DISTINCT m) FILTER (kind NOT IN ('spot', 'res_price')) AS markets FROM h
WHERE am >= 1704070800000 AND am < 1704081600000 GROUP BY kind""")
def lake_replay_range(spark, sf_dir):
    """A range of time replayed from the tables for the hours that are filed and raw for the rest."""
    folder = _raw_hours(spark, sf_dir)
    every = raw.list_hours(spark, folder)
    lake.compact(spark, folder, closed_before=every[len(every) // 2][:2])
    e = lake.replay(spark, folder, 1_704_070_800_000 * 10**6, 1_704_081_600_000 * 10**6, parquet=None)
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("exchange_ts").alias("at_sum"), F.count_distinct("market_id").alias("markets"))


@query(_HOURS + """SELECT 'events' AS item, count(*) AS n FROM h UNION ALL SELECT 'markets', count(DISTINCT m) FROM h WHERE kind NOT IN ('spot', 'res_price')
UNION ALL SELECT 'first_ms', min(am) FROM h UNION ALL SELECT 'last_ms', max(am) FROM h UNION ALL SELECT 'late', 0 UNION ALL SELECT 'kind ' || kind, count(*) FROM h GROUP BY kind""")
def lake_replay_summary(spark, sf_dir):
    """What a verified replay of the whole lake reports, as items."""
    folder = _raw_hours(spark, sf_dir)
    lake.compact(spark, folder)
    s = book.replay_summary(lake.replay(spark, folder, parquet=True, ordered=False))
    items = F.array(*[F.struct(F.lit(name).alias("item"), c.cast("long").alias("n")) for name, c in (("events", F.col("events")), ("markets", F.col("markets")), ("first_ms", F.expr("first_ts div 1000000")), ("last_ms", F.expr("last_ts div 1000000")), ("late", F.col("late")))])
    kinds = F.transform(F.map_entries("kinds"), lambda x: F.struct(F.concat(F.lit("kind "), x["key"]).alias("item"), x["value"].alias("n")))
    return s.select(F.inline(F.concat(items, kinds)))
