"""Order books: mirror levels, the book after a stream of changes, pruning, verification and comparison.

The final book has a declarative form (last write per level, then a running minimum of what was reported). The check
of every single change against the reported best prices is a fold over the ordered events of one market.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.scalars import NO_SIZE, PRICE_SCALE, mirror_key
from tidebook.operators import digest as tree
from tidebook.session import stored
from tidebook.sources.raw import canonical


def mirrored(levels: DataFrame) -> DataFrame:
    """levels (token, side, key, size) as levels of the UP side: a DOWN bid at k is an UP ask at 1 - k, and so on."""
    down = F.col("token") == "DOWN"
    return levels.withColumn("key", F.when(down, mirror_key(F.col("key"))).otherwise(F.col("key"))).withColumn("side", F.when(down & (F.col("side") == "BUY"), "SELL").when(down, "BUY").otherwise(F.col("side"))).withColumn("token", F.lit("UP"))


def without_mirrors(changes: DataFrame, message: list[str], order: str) -> DataFrame:
    """changes of DOWN that do not mirror an UP change of the same message, one for one, and all UP changes.

    A mirror has the other side, the same size and the mirrored price. It is a multiset difference: the n-th equal
    DOWN change goes with the n-th equal UP change.
    """
    as_up = mirrored(changes.select("*", F.col("token").alias("_token")))
    by = [*message, "side", "key", "size"]
    numbered = as_up.withColumn("_n", F.row_number().over(W.partitionBy(*by, "_token").orderBy(order)))
    ups = numbered.where("_token = 'UP'").select(*by, "_n")
    downs = numbered.where("_token = 'DOWN'").join(ups, [*by, "_n"], "left_anti").select(*message, order)
    kept = changes.where("token = 'DOWN'").join(downs, [*message, order], "left_semi")
    return changes.where("token = 'UP'").unionByName(kept)


def quote(levels: DataFrame, by: list[str]) -> DataFrame:
    """Best bid and ask of UP levels (side, key, size > 0) per book, null where a side is empty."""
    live = F.col("size") > NO_SIZE
    return levels.groupBy(*by).agg(F.max(F.when(live & (F.col("side") == "BUY"), F.col("key"))).alias("bid"), F.min(F.when(live & (F.col("side") == "SELL"), F.col("key"))).alias("ask"))


def last_writes(changes: DataFrame, book: list[str], key: list[str], order: str, resets: Column, writes: Column) -> DataFrame:
    """The last write of each level since the latest reset of its book; a reset may write a level too.

    Both are aggregates, so a busy book is combined before the shuffle.
    """
    epochs = changes.where(resets).groupBy(*book).agg(F.max(order).alias("_epoch"))
    since = changes.join(epochs, book, "left").where(F.col("_epoch").isNull() | (F.col(order) >= F.col("_epoch")))
    rest = [c for c in changes.columns if c not in (*book, *key)]
    last = since.where(writes).groupBy(*book, *key).agg(F.max_by(F.struct(*rest, "_epoch"), order).alias("_w"))
    return last.select(*book, *key, *[F.col("_w")[c].alias(c) for c in (*rest, "_epoch")])


def pruned_bids(changes: DataFrame, book: list[str], order: str, resets: Column, writes: Column, removes: Column, reports: Column) -> DataFrame:
    """Bids that are left at the end: last write per key since the reset, not removed, and not above a later best bid.

    Reports count only once a reset has synced the book. The smallest best bid reported after a write is a running
    minimum from the end of the stream.
    """
    epochs = changes.where(resets).groupBy(*book).agg(F.max(order).alias("_epoch"))
    since = changes.join(epochs, book, "left").where(F.col("_epoch").isNull() | (F.col(order) >= F.col("_epoch")))
    later = W.partitionBy(*book).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    least = F.min(F.when(reports & F.col("_epoch").isNotNull(), F.col("key"))).over(later)
    seen = since.withColumn("_least", least).where(writes | removes)
    last = seen.groupBy(*book, "key").agg(F.max_by(F.struct(F.col("size"), removes.alias("gone"), "_least"), order).alias("w"))
    return last.where(~F.col("w.gone") & (F.col("w.size") > NO_SIZE) & (F.col("w._least").isNull() | (F.col("w._least") >= F.col("key")))).select(*book, "key", F.col("w.size").alias("size"))


def snapshot_difference(ours: DataFrame, theirs: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Levels (keys, size) that differ between two books: ours, theirs (0 where a book lacks the level)."""
    joined = ours.select(*keys, F.col("size").alias("ours")).join(theirs.select(*keys, F.col("size").alias("theirs")), keys, "full")
    filled = joined.select(*keys, F.coalesce("ours", F.lit(0.0)).alias("ours"), F.coalesce("theirs", F.lit(0.0)).alias("theirs"))
    return filled.where(F.abs(F.col("ours") - F.col("theirs")) > tolerance)


def digest(levels: DataFrame, book: list[str]) -> DataFrame:
    """A text of all levels of a book, bids then asks by ascending key, and its SHA-256."""
    side = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("key", "size")))), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["size"].cast("string"))), ",")
    text = levels.where(F.col("size") > NO_SIZE).groupBy(*book).agg(F.concat(F.lit("b["), side("BUY"), F.lit("]a["), side("SELL"), F.lit("]")).alias("book"))
    return text.withColumn("sha256", F.sha2(F.col("book").cast("binary"), 256))


# --- the fold -------------------------------------------------------------------------------------------------


class Book:
    """UP levels as key -> size on both sides; DOWN levels are their mirrors."""

    def __init__(self):
        self.sides: dict[str, dict[int, float]] = {"BUY": {}, "SELL": {}}

    @staticmethod
    def up(token: str, side: str, price: float) -> tuple[str, int]:
        key = int(price * PRICE_SCALE + 0.5)
        return (side, key) if token == "UP" else ("SELL" if side == "BUY" else "BUY", PRICE_SCALE - key)

    def set(self, token: str, side: str, price: float, size: float) -> None:
        side, key = self.up(token, side, price)
        if size <= NO_SIZE:
            self.sides[side].pop(key, None)
        else:
            self.sides[side][key] = size

    def replace(self, token: str, bids, asks) -> None:
        self.sides = {"BUY": {}, "SELL": {}}
        for side, levels in (("BUY", bids), ("SELL", asks)):
            for price, size in levels:
                self.set(token, side, price, size)

    def best(self, token: str = "UP") -> tuple[int | None, int | None]:
        bid, ask = max(self.sides["BUY"], default=None), min(self.sides["SELL"], default=None)
        if token == "UP":
            return bid, ask
        return (None if ask is None else PRICE_SCALE - ask), (None if bid is None else PRICE_SCALE - bid)

    def prune(self, token: str, bid: float | None, ask: float | None) -> int:
        """Removes levels better than the reported best; a side without a best is emptied. Returns how many went."""
        k = lambda p: None if p is None else int(p * PRICE_SCALE + 0.5)
        bid, ask = k(bid), k(ask)
        if token == "DOWN":
            bid, ask = (None if ask is None else PRICE_SCALE - ask), (None if bid is None else PRICE_SCALE - bid)
        gone = 0
        for side, best, better in (("BUY", bid, lambda x, b: x > b), ("SELL", ask, lambda x, b: x < b)):
            stale = [x for x in self.sides[side] if best is None or better(x, best)]
            gone += len(stale)
            for x in stale:
                del self.sides[side][x]
        return gone

    def difference(self, token: str, bids, asks, near: int = 50_000) -> tuple[int, int]:
        """Levels that differ from a snapshot, and those of them within `near` of the snapshot's best (or of none)."""
        other = Book()
        other.replace(token, bids, asks)
        total = close = 0
        for side, best in zip(("BUY", "SELL"), other.best()):
            for x in self.sides[side].keys() | other.sides[side].keys():
                if abs(self.sides[side].get(x, 0.0) - other.sides[side].get(x, 0.0)) > NO_SIZE:
                    total += 1
                    close += best is None or abs(x - best) <= near
        return total, close

    def text(self) -> str:
        size = lambda x: f"{x:.6f}".rstrip("0").rstrip(".")
        part = lambda s: ",".join(f"{x}:{size(self.sides[s][x])}" for x in sorted(self.sides[s]))
        return f"b[{part('BUY')}]a[{part('SELL')}]"


STATS = "changes long, unsynced_changes long, levels_pruned long, bests_checked long, best_mismatches long, snapshots long, snapshots_differing long, levels_differing long, near_top_differing long"


class MarketFold:
    """State of one market over its ordered events: book, whether it is in step with the venue, and counters."""

    def __init__(self):
        self.book, self.opened, self.synced, self.closed, self.outcome, self.tick = Book(), False, False, False, None, {}
        self.last_trade: float | None = None
        self.stats = {c.split()[0]: 0 for c in STATS.split(", ")}

    def apply(self, kind: str, p: dict) -> None:
        s = self.stats
        if kind == "book_snapshot":
            s["snapshots"] += 1
            if self.synced:
                total, near = self.book.difference(p["token"], p["bids"], p["asks"])
                s["snapshots_differing"] += total > 0
                s["levels_differing"] += total
                s["near_top_differing"] += near
            self.book.replace(p["token"], p["bids"], p["asks"])
            self.synced = True
        elif kind == "book_delta":
            for c in p["changes"]:
                s["changes"] += 1
                self.book.set(c["token"], c["side"], c["price"], c["size"])
                if not self.synced:
                    s["unsynced_changes"] += 1
                    continue
                # a bid of 0 or less and an ask of 1 or more are how the venue says that a side is empty
                bid = None if c["best_bid"] is None or c["best_bid"] <= 0 else c["best_bid"]
                ask = None if c["best_ask"] is None or c["best_ask"] >= 1 else c["best_ask"]
                s["levels_pruned"] += self.book.prune(c["token"], bid, ask)
                have, want = self.book.best(c["token"]), [None if x is None else int(x * PRICE_SCALE + 0.5) for x in (bid, ask)]
                s["bests_checked"] += 1
                s["best_mismatches"] += list(have) != want
        elif kind == "trade":
            self.last_trade = p["price"]
        elif kind == "feed_gap":
            self.synced = False
        elif kind == "market_open":
            self.synced = self.synced and not self.opened  # a second open means a new subscription
            self.opened = True
            self.tick = {"UP": p.get("tick_size"), "DOWN": p.get("tick_size")}
        elif kind == "tick_size_change":
            self.tick[p["token"]] = p["new_tick_size"]
        elif kind == "market_close":
            self.closed = True
        elif kind == "resolution":
            self.outcome = p["outcome"]


def _payload(row) -> dict:
    """What the fold needs of an event's payload, by its own names."""
    p = row.payload
    levels = lambda xs: [(x["price"], x["size"]) for x in (xs if xs is not None else [])]
    none = lambda x: None if x is None or x != x else x
    token = row.token if isinstance(row.token, str) else "UP"
    if row.kind == "book_snapshot":
        return {"token": token, "bids": levels(p["bids"]), "asks": levels(p["asks"])}
    if row.kind == "book_delta":
        return {"changes": [{"token": c["token"], "side": c["side"], "price": c["price"], "size": c["size"], "best_bid": none(c["bestBid"]), "best_ask": none(c["bestAsk"])} for c in p["changes"]]}
    return {"token": token, "price": p["price"], "outcome": p["outcome"], "tick_size": p["tickSize"], "new_tick_size": p["newTickSize"]}


def folded_fields() -> Column:
    """The payload with only the fields that the fold reads: each one costs every event its way into Python."""
    return F.struct(*[F.col(f"payload.{f}").alias(f) for f in ("bids", "asks", "changes", "price", "outcome", "tickSize", "newTickSize", "windowEnd")]).alias("payload")


def fold_events(rows: Iterator) -> MarketFold:
    fold = MarketFold()
    for row in rows:
        fold.apply(row.kind, _payload(row))
    return fold


def verified_books(events: DataFrame) -> DataFrame:
    """Per market: counters of the fold over its ordered events, the final book's text, closed, outcome.

    events is the event stream of tidebook.schema. A market lives for one window, so its events (some hundred
    thousand at most) are one bounded group; markets are spread over the cluster.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        fold = fold_events(pdf.sort_values(["date", "hour", "line"], kind="stable").itertuples(index=False))
        return pd.DataFrame([{"market_id": key[0], **fold.stats, "book": fold.book.text(), "synced": fold.synced, "closed": fold.closed, "outcome": fold.outcome}])

    wanted = events.where("market_id is not null").select("market_id", "token", "kind", "date", "hour", "line", folded_fields())
    return wanted.groupBy("market_id").applyInPandas(run, f"market_id string, {STATS}, book string, synced boolean, closed boolean, outcome string")


def replay_summary(events: DataFrame) -> DataFrame:
    """One row on a verified replay: events, their kinds, first and last arrival, how many came late (arrived before one that
    stands before them), markets, the counters of all books summed, where the first check failed, and a digest.

    The digest covers the ordered events and every market's final book, so two replays that agree on it agree on both.
    Books are checked as intervals, so no market's events need to fit a task. Events are made once, and stored with their hashes.
    """
    from tidebook.operators import gaps, verify

    events = stored(canonical(events).select("kind", "market_id", "token", "recv_ts", "date", "hour", "line", folded_fields(), "sha256"), "replay")
    books = stored(verify.verified_books(events), "books")
    line = F.concat_ws("|", "market_id", "book", F.col("closed").cast("string"), F.coalesce("outcome", F.lit("")))
    names = [c.split()[0] for c in STATS.split(", ")]
    marks = books.select(F.lit("1970-01-01").cast("date").alias("date"), F.lit(0).alias("hour"), F.pmod(F.xxhash64("market_id"), F.lit(1 << 30)).cast("int").alias("line"), F.sha2(line, 256).alias("sha256"))
    final = tree.root(marks.groupBy("date", "hour", "line").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256")))
    whole = books.agg(F.count(F.lit(1)).alias("markets"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.min("first_wrong").alias("first_wrong"))
    kinds = events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("recv_ts").alias("first_ts"), F.max("recv_ts").alias("last_ts"))
    kinds = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    part = F.unix_date("date").cast("long") * (24 << 18) + F.col("hour") * (1 << 18) + F.expr("line div 8192")
    late = gaps.late_rows(events.select("recv_ts", "date", "hour", "line"), "recv_ts", ["date", "hour", "line"], part).agg(F.count(F.lit(1)).alias("late"))
    one = kinds.crossJoin(late).crossJoin(whole).crossJoin(final)  # one row each
    digest = F.sha2(F.concat(F.lit(tree.root(events).first()[0] or ""), F.coalesce("sha256", F.lit(""))), 256)
    return one.select("events", "kinds", "first_ts", "last_ts", "late", "markets", *[F.col(c).cast("long").alias(c) for c in names], "first_wrong", digest.alias("digest"))
