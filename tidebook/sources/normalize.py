"""Venue messages as events: order book, oracle and two spot venues. Input columns: value (JSON text), recv_ts (ns), msg (a message number).

Each function gives (msg, idx, kind, market_id, token, exchange_ts, recv_ts, payload); msg and idx are the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook import schema as S
from tidebook.functions.scalars import price_key
from tidebook.operators.book import without_mirrors

_BOOK = "STRUCT<event_type: STRING, asset_id: STRING, timestamp: STRING, hash: STRING, bids: ARRAY<STRUCT<price: STRING, size: STRING>>, asks: ARRAY<STRUCT<price: STRING, size: STRING>>, price_changes: ARRAY<STRUCT<asset_id: STRING, side: STRING, price: STRING, size: STRING, best_bid: STRING, best_ask: STRING>>, price: STRING, size: STRING, side: STRING, fee_rate_bps: STRING, transaction_hash: STRING, old_tick_size: STRING, new_tick_size: STRING>"


def _payload(**own: Column) -> Column:
    return F.struct(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in ((f.name, f.dataType) for f in S.payload())])


def _number(c: Column) -> Column:
    """A number from text; empty text has none."""
    return F.nullif(c, F.lit("")).try_cast("double")


def _events(df: DataFrame, kind: str | Column, payload: Column, at: Column, idx: Column, market: Column | None = None, token: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("msg", idx.cast("int").alias("idx"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if market is None else market).alias("market_id"), (none if token is None else token).alias("token"), at.cast("long").alias("exchange_ts"), "recv_ts", payload.alias("payload"))


def book_messages(messages: DataFrame, markets: DataFrame, drop_mirrored: bool = True) -> DataFrame:
    """Order-book messages, single or in lists. markets: (market_id, up_token_id, down_token_id), one row a market.

    messages need market_id. Assets of other markets go; messages of unknown type are kept whole as venue_raw. With
    drop_mirrored, DOWN snapshots and DOWN changes that mirror an UP change of the message go; UPs come before DOWNs.
    """
    joined = messages.where(~F.trim("value").isin("", "PONG")).join(markets, "market_id")
    parts = F.when(F.ltrim("value").startswith("["), F.from_json("value", "ARRAY<STRING>")).otherwise(F.array("value"))
    each = joined.select("*", F.posexplode(parts).alias("part", "text")).withColumn("m", F.from_json("text", _BOOK)).drop("value")
    token_of = lambda asset: F.when(asset == F.col("up_token_id"), "UP").when(asset == F.col("down_token_id"), "DOWN")
    each = each.withColumn("token", token_of(F.col("m.asset_id")))
    at, kind = F.col("m.timestamp").try_cast("double"), F.col("m.event_type")
    market, token, idx = F.col("market_id"), F.col("token"), F.col("part") * 1000
    levels = lambda c: F.transform(c, lambda x: F.struct(_number(x["price"]).alias("price"), _number(x["size"]).alias("size")))

    books = each.where((kind == "book") & token.isNotNull() & ((token == "UP") | F.lit(not drop_mirrored)))
    out = _events(books, "book_snapshot", _payload(bids=levels(F.col("m.bids")), asks=levels(F.col("m.asks")), hash=F.col("m.hash")), at, idx, market, token)

    changes = each.where(kind == "price_change").select("msg", "part", "market_id", "recv_ts", at.alias("at"), "up_token_id", "down_token_id", F.posexplode("m.price_changes").alias("pos", "c"))
    changes = changes.select("msg", "part", "market_id", "recv_ts", "at", "pos", token_of(F.col("c.asset_id")).alias("token"), F.col("c.side").alias("side"), _number(F.col("c.price")).alias("price"), _number(F.col("c.size")).alias("size"), _number(F.col("c.best_bid")).alias("bestBid"), _number(F.col("c.best_ask")).alias("bestAsk")).where("token is not null").withColumn("key", price_key(F.col("price")))
    if drop_mirrored:
        changes = without_mirrors(changes, ["market_id", "msg", "part"], "pos")
    change = F.struct("token", "side", "price", "size", "bestBid", "bestAsk")
    deltas = changes.groupBy("msg", "part", "market_id", "recv_ts", "at").agg(F.array_sort(F.collect_list(F.struct((F.col("token") == "DOWN").alias("down"), "pos", change.alias("c")))).alias("l"))
    out = out.unionByName(_events(deltas, "book_delta", _payload(changes=F.transform("l", lambda x: x["c"])), F.col("at"), idx, market))

    trades = each.where((kind == "last_trade_price") & token.isNotNull())
    out = out.unionByName(_events(trades, "trade", _payload(price=_number(F.col("m.price")), size=_number(F.col("m.size")), side=F.col("m.side"), feeRateBps=_number(F.coalesce("m.fee_rate_bps", F.lit("0"))), txHash=F.coalesce("m.transaction_hash", F.lit(""))), at, idx, market, token))

    old, new = _number(F.col("m.old_tick_size")), _number(F.col("m.new_tick_size"))
    tick = (kind == "tick_size_change") & F.coalesce(token.isNotNull() & (old > 0) & (new > 0), F.lit(False))
    out = out.unionByName(_events(each.where(tick), "tick_size_change", _payload(oldTickSize=old, newTickSize=new), at, idx, market, token))

    unknown = each.where(F.coalesce(~kind.isin("book", "price_change", "last_trade_price") & ~tick, F.lit(True)))
    raw = _payload(feed=F.lit("clob"), eventType=F.coalesce(kind, F.lit("undefined")), data=F.col("text"))
    return out.unionByName(_events(unknown, "venue_raw", raw, F.coalesce(at, F.lit(0.0)), idx, market))


def mirror_mismatches(events: DataFrame) -> DataFrame:
    """(market_id, mismatches): DOWN changes that were kept because no UP change mirrors them."""
    n = F.size(F.filter("payload.changes", lambda c: c["token"] == "DOWN"))
    return events.where("kind = 'book_delta'").groupBy("market_id").agg(F.sum(n).alias("mismatches"))


def oracle_messages(messages: DataFrame, symbol: str) -> DataFrame:
    """Reference prices: a live update is one event, a subscription's history one for each of its points."""
    m = messages.withColumn("m", F.from_json("value", "STRUCT<topic: STRING, type: STRING, payload: STRUCT<symbol: STRING, timestamp: DOUBLE, value: DOUBLE, full_accuracy_value: STRING, data: ARRAY<STRUCT<timestamp: DOUBLE, value: DOUBLE>>>>"))
    m = m.where(F.col("m.payload.symbol") == symbol)
    live = m.where("m.topic = 'crypto_prices_chainlink' and m.type = 'update'")
    price = lambda c, **more: _payload(source=F.lit("chainlink"), symbol=F.lit(symbol), price=c, **more)
    out = _events(live, "res_price", price(F.col("m.payload.value"), scaled=F.nullif(F.col("m.payload.full_accuracy_value"), F.lit(""))), F.col("m.payload.timestamp"), F.lit(0))
    past = m.where("m.topic = 'crypto_prices' and m.type = 'subscribe'").select("msg", "recv_ts", F.posexplode("m.payload.data").alias("i", "d"))
    return out.unionByName(_events(past, "res_price", price(F.col("d.value"), backfill=F.lit(True)), F.col("d.timestamp"), F.col("i")))


def stream_messages(messages: DataFrame) -> DataFrame:
    """Spot venue with named streams: best quotes (their time is the arrival's) and aggregate trades."""
    # field names differ by case alone, so each is read by its path
    get = lambda path: F.get_json_object("value", f"$.{path}")
    stream = get("stream")
    quotes = messages.where(stream.endswith("@bookTicker") & get("data.b").isNotNull())
    number = lambda path: get(f"data.{path}").try_cast("double")
    source = F.lit("binance")
    out = _events(quotes, "spot", _payload(type=F.lit("bbo"), source=source, bid=number("b"), bidSize=number("B"), ask=number("a"), askSize=number("A")), F.expr("recv_ts div 1000000"), F.lit(0))
    trades = messages.where(stream.endswith("@aggTrade") & get("data.T").isNotNull())
    side = F.when(get("data.m") == "true", "SELL").otherwise("BUY")  # the buyer rested, so the taker sold
    return out.unionByName(_events(trades, "spot", _payload(type=F.lit("trade"), source=source, price=number("p"), size=number("q"), side=side), number("T"), F.lit(0)))


def ticker_messages(messages: DataFrame) -> DataFrame:
    """Spot venue with tickers: each is a trade and then the best quotes after it."""
    t = messages.withColumn("m", F.from_json("value", "STRUCT<type: STRING, time: STRING, price: STRING, last_size: STRING, side: STRING, best_bid: STRING, best_bid_size: STRING, best_ask: STRING, best_ask_size: STRING>")).where("m.type = 'ticker'")
    at, n = F.unix_millis(F.to_timestamp("m.time")), lambda c: _number(F.col(f"m.{c}"))
    trade = _payload(type=F.lit("trade"), source=F.lit("coinbase"), price=n("price"), size=n("last_size"), side=F.when(F.col("m.side") == "buy", "BUY").otherwise("SELL"))
    quote = _payload(type=F.lit("bbo"), source=F.lit("coinbase"), bid=n("best_bid"), bidSize=n("best_bid_size"), ask=n("best_ask"), askSize=n("best_ask_size"))
    return _events(t, "spot", trade, at, F.lit(0)).unionByName(_events(t, "spot", quote, at, F.lit(1)))


def market_records(records: DataFrame, length_sec: int = 900) -> DataFrame:
    """(slug, market_id, up_token_id, down_token_id, window_start, window_end) of market records (value: JSON).

    A record needs the outcomes Up and Down, two token ids, and a window of the expected length; others go.
    """
    m = records.withColumn("m", F.from_json("value", "STRUCT<slug: STRING, startTime: STRING, endDate: STRING, eventStartTime: STRING, markets: ARRAY<STRUCT<conditionId: STRING, outcomes: STRING, clobTokenIds: STRING, eventStartTime: STRING, endDate: STRING>>>"))
    m = m.withColumn("k", F.get("m.markets", F.lit(0)))
    names, ids = F.from_json("k.outcomes", "ARRAY<STRING>"), F.from_json("k.clobTokenIds", "ARRAY<STRING>")
    start = F.unix_millis(F.to_timestamp(F.coalesce("m.startTime", "k.eventStartTime", "m.eventStartTime")))
    end = F.unix_millis(F.to_timestamp(F.coalesce("m.endDate", "k.endDate")))
    out = m.where((names == F.array(F.lit("Up"), F.lit("Down"))) & (F.size(ids) == 2) & (end - start == length_sec * 1000))
    return out.select(F.col("m.slug").alias("slug"), F.col("k.conditionId").alias("market_id"), F.get(ids, F.lit(0)).alias("up_token_id"), F.get(ids, F.lit(1)).alias("down_token_id"), start.alias("window_start"), end.alias("window_end"))


def resolutions(records: DataFrame) -> DataFrame:
    """(slug, outcome, price_to_beat, final_price) of records that are closed, have both prices and 1 and 0 as outcome prices."""
    m = records.withColumn("m", F.from_json("value", "STRUCT<slug: STRING, closed: BOOLEAN, eventMetadata: STRUCT<priceToBeat: DOUBLE, finalPrice: DOUBLE>, markets: ARRAY<STRUCT<outcomePrices: STRING>>>"))
    prices = F.transform(F.from_json(F.get("m.markets", F.lit(0))["outcomePrices"], "ARRAY<STRING>"), lambda x: x.try_cast("double"))
    up, down = F.get(prices, F.lit(0)), F.get(prices, F.lit(1))
    outcome = F.when((up == 1) & (down == 0), "UP").when((up == 0) & (down == 1), "DOWN")
    out = m.where(F.col("m.closed") & F.col("m.eventMetadata.priceToBeat").isNotNull() & F.col("m.eventMetadata.finalPrice").isNotNull() & outcome.isNotNull())
    return out.select(F.col("m.slug").alias("slug"), outcome.alias("outcome"), F.col("m.eventMetadata.priceToBeat").alias("price_to_beat"), F.col("m.eventMetadata.finalPrice").alias("final_price"))
