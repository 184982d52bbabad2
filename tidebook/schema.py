"""Types of the event stream and of the tables it is filed in, and what makes an event valid."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEVELS = "ARRAY<STRUCT<price: DOUBLE, size: DOUBLE>>"
_CHANGES = "ARRAY<STRUCT<token: STRING, side: STRING, price: DOUBLE, size: DOUBLE, bestBid: DOUBLE, bestAsk: DOUBLE>>"
#: One struct holds the fields of all eleven kinds; no two kinds use a name for different types.
PAYLOAD = (
    f"bids: {_LEVELS}, asks: {_LEVELS}, hash: STRING, changes: {_CHANGES}, price: DOUBLE, size: DOUBLE, side: STRING, feeRateBps: DOUBLE, txHash: STRING, "
    "type: STRING, source: STRING, bid: DOUBLE, bidSize: DOUBLE, ask: DOUBLE, askSize: DOUBLE, symbol: STRING, scaled: STRING, backfill: BOOLEAN, "
    "slug: STRING, upTokenId: STRING, downTokenId: STRING, windowStart: DOUBLE, windowEnd: DOUBLE, tickSize: DOUBLE, minOrderSize: DOUBLE, "
    "feeSchedule: STRUCT<rate: DOUBLE, exponent: DOUBLE, takerOnly: BOOLEAN, rebateRate: DOUBLE>, outcome: STRING, priceToBeat: DOUBLE, finalPrice: DOUBLE, "
    "oldTickSize: DOUBLE, newTickSize: DOUBLE, feed: STRING, eventType: STRING, data: STRING, gapMs: DOUBLE, reason: STRING"
)
#: An event as one line of the raw log has it; recvTs is a decimal string of nanoseconds.
LINE = f"kind STRING, marketId STRING, token STRING, exchangeTs DOUBLE, recvTs STRING, payload STRUCT<{PAYLOAD}>, _bad STRING"
#: The event stream: (date, hour, line) is its order.
EVENT = f"kind STRING, market_id STRING, token STRING, exchange_ts BIGINT, recv_ts BIGINT, payload STRUCT<{PAYLOAD}>, date DATE, hour INT, line INT"
ORDER = ["date", "hour", "line"]

_COMMON = "line INT, recv_ts BIGINT, exchange_ts BIGINT"
_OWN = {
    "book_deltas": "market_id STRING, idx SMALLINT, token STRING, side STRING, price DOUBLE, size DOUBLE, best_bid DOUBLE, best_ask DOUBLE",
    "book_levels": "market_id STRING, idx SMALLINT, token STRING, side STRING, price DOUBLE, size DOUBLE, hash STRING",
    "trades": "market_id STRING, token STRING, side STRING, price DOUBLE, size DOUBLE, fee_rate_bps DOUBLE, tx_hash STRING",
    "spot": "source STRING, type STRING, bid DOUBLE, bid_size DOUBLE, ask DOUBLE, ask_size DOUBLE, price DOUBLE, size DOUBLE, side STRING",
    "res_prices": "symbol STRING, price DOUBLE, scaled STRING, backfill BOOLEAN",
    "market_opens": "market_id STRING, slug STRING, up_token_id STRING, down_token_id STRING, window_start BIGINT, window_end BIGINT, tick_size DOUBLE, min_order_size DOUBLE, fee_rate DOUBLE, fee_exponent DOUBLE, fee_taker_only BOOLEAN, fee_rebate_rate DOUBLE",
    "market_closes": "market_id STRING, window_end BIGINT",
    "resolutions": "market_id STRING, outcome STRING, price_to_beat DOUBLE, final_price DOUBLE",
    "feed_gaps": "market_id STRING, feed STRING, gap_ms DOUBLE, reason STRING",
    "tick_size_changes": "market_id STRING, token STRING, old_tick_size DOUBLE, new_tick_size DOUBLE",
    "venue_raw": "market_id STRING, feed STRING, event_type STRING, data STRING",
}
#: Columns of each table; date and hour are its partitions.
TABLES = {name: f"{_COMMON}, {own}, date DATE, hour INT" for name, own in _OWN.items()}
#: The table that each kind of event is filed in.
TABLE_OF = {
    "book_delta": "book_deltas", "book_snapshot": "book_levels", "trade": "trades", "spot": "spot", "res_price": "res_prices", "market_open": "market_opens",
    "market_close": "market_closes", "resolution": "resolutions", "feed_gap": "feed_gaps", "tick_size_change": "tick_size_changes", "venue_raw": "venue_raw",
}


@lru_cache
def struct(ddl: str) -> T.StructType:
    """The type that a column list spells; a session must be running."""
    return T.StructType.fromDDL(ddl)


def payload() -> T.StructType:
    return struct(EVENT)["payload"].dataType


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows but with all its columns."""
    return spark.createDataFrame([], TABLES[table])


def valid() -> Column:
    """Whether a parsed line is an event of its kind. False, never null."""
    p = lambda name: F.col(f"payload.{name}")
    unit = lambda c: c.between(0, 1)
    positive = lambda *names: [p(n) > 0 for n in names]
    there = lambda *names: [p(n).isNotNull() for n in names]
    token, side = lambda c: c.isin("UP", "DOWN"), lambda c: c.isin("BUY", "SELL")
    whole = lambda *names: [p(n) == F.floor(p(n)) for n in names]
    levels = lambda name: F.forall(p(name), lambda x: F.coalesce(unit(x["price"]) & (x["size"] >= 0), F.lit(False)))
    change = lambda c: token(c["token"]) & side(c["side"]) & unit(c["price"]) & (c["size"] >= 0) & F.coalesce(unit(c["bestBid"]), F.lit(True)) & F.coalesce(unit(c["bestAsk"]), F.lit(True))
    fees = [p("feeSchedule.rate") >= 0, p("feeSchedule.exponent") >= 0, p("feeSchedule.takerOnly").isNotNull(), unit(p("feeSchedule.rebateRate"))]
    rules = {
        "book_snapshot": [levels("bids"), levels("asks"), *there("hash")],
        "book_delta": [F.size(p("changes")) > 0, F.forall(p("changes"), lambda c: F.coalesce(change(c), F.lit(False)))],
        "trade": [unit(p("price")), *positive("size"), side(p("side")), p("feeRateBps") >= 0, *there("txHash")],
        "spot": [p("source").isin("binance", "coinbase"), F.when(p("type") == "bbo", (p("bid") > 0) & (p("bidSize") >= 0) & (p("ask") > 0) & (p("askSize") >= 0)).when(p("type") == "trade", (p("price") > 0) & (p("size") > 0) & side(p("side")))],
        "res_price": [p("source") == "chainlink", *there("symbol"), *positive("price"), p("scaled").isNull() | p("scaled").rlike("^[0-9]+$")],
        "market_open": [*there("slug", "upTokenId", "downTokenId"), *whole("windowStart", "windowEnd"), *positive("tickSize", "minOrderSize"), *fees],
        "market_close": whole("windowEnd"),
        "resolution": [token(p("outcome")), *positive("priceToBeat", "finalPrice")],
        "feed_gap": [*there("feed"), p("gapMs") >= 0, p("reason").isin("reconnect", "silence", "sequence_break")],
        "tick_size_change": positive("oldTickSize", "newTickSize"),
        "venue_raw": there("feed", "eventType", "data"),
    }
    by_kind = F.lit(None).cast("boolean")
    for kind, needs in rules.items():
        ok = F.lit(True)
        for need in needs:
            ok = ok & need
        by_kind = F.when(F.col("kind") == kind, ok).otherwise(by_kind)
    envelope = F.col("_bad").isNull() & F.col("exchangeTs").isNotNull() & F.expr("try_cast(recvTs AS BIGINT)").isNotNull() & F.coalesce(token(F.col("token")), F.lit(True))
    return F.coalesce(envelope & by_kind, F.lit(False))
