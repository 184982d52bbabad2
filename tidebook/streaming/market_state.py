"""Live markets and feeds as typed state with event-time timers, removed when they are over.

Both processors run under transformWithState on the RocksDB state store: a market's levels are a map state, of which a
batch writes only what changed, everything else is one typed value. Event time is arrival time. A market is closed
when its window ends, awaits its resolution after a grace time, and is given up when none comes; a resolved one stays
for a while, for what is still under way. Whatever is over is handed out once, whole, and leaves the state empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidebook.functions.scalars import PRICE_SCALE
from tidebook.operators import book

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATS = [c.split()[0] for c in book.STATS.split(", ")]
MARKET = f"market_id string, event string, at_ms long, {book.STATS}, bid double, ask double, book string, synced boolean, closed boolean, outcome string, last_trade double, late long, events long"
FEED = "feed string, event string, at_ms long, start_ms long, gap_ms long, events long, gaps long, sequence_breaks long, reconnects long, max_gap_ms double"
_SEEN = f"synced boolean, opened boolean, closed boolean, outcome string, last_trade double, tick_up double, tick_down double, window_end long, stage string, due long, latest long, late long, events long, {book.STATS}"


class MarketProcessor(StatefulProcessor):
    """One market: applies its events in order of arrival and walks through its stages by timers.

    Rows: 'update' once a batch (with the book's text if `books`), 'closed' and 'awaiting' when those times come, and
    one last row, 'resolved' or 'given_up', with the whole book; then the state is removed. A market that never opened is
    given up after give_up_ms without an event. An event of a market that is gone starts it anew.
    """

    def __init__(self, grace_ms: int = 30_000, give_up_ms: int = 3_600_000, linger_ms: int = 60_000, books: bool = False):
        self.grace_ms, self.give_up_ms, self.linger_ms, self.books = grace_ms, give_up_ms, linger_ms, books

    def init(self, handle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side string, key long", "size double")
        self.seen = handle.getValueState("seen", _SEEN)

    def _load(self) -> tuple[book.MarketFold, dict]:
        fold, own = book.MarketFold(), {"window_end": None, "stage": "unopened", "due": None, "latest": -1, "late": 0, "events": 0}
        if self.seen.exists():
            kept = dict(zip([c.split()[0] for c in _SEEN.split(", ")], self.seen.get()))
            fold.synced, fold.opened, fold.closed, fold.outcome, fold.last_trade = (kept[c] for c in ("synced", "opened", "closed", "outcome", "last_trade"))
            fold.tick, fold.stats = {"UP": kept["tick_up"], "DOWN": kept["tick_down"]}, {c: kept[c] for c in _STATS}
            own = {c: kept[c] for c in own}
            for (side, key), (size,) in self.levels.iterator():
                fold.book.sides[side][key] = size
        return fold, own

    def _store(self, fold: book.MarketFold, own: dict, before: dict[str, dict[int, float]]) -> None:
        for side, levels in fold.book.sides.items():
            for key in before[side].keys() - levels.keys():
                self.levels.removeKey((side, key))
            for key, size in levels.items():
                if before[side].get(key) != size:
                    self.levels.updateValue((side, key), (size,))
        number = lambda x: None if x is None else float(x)
        self.seen.update((fold.synced, fold.opened, fold.closed, fold.outcome, number(fold.last_trade), number(fold.tick.get("UP")), number(fold.tick.get("DOWN")), *(own[c] for c in ("window_end", "stage", "due", "latest", "late", "events")), *(fold.stats[c] for c in _STATS)))

    def _row(self, key: tuple, event: str, at_ms: int, fold: book.MarketFold, own: dict, text: bool) -> pd.DataFrame:
        price = lambda k: None if k is None else k / PRICE_SCALE
        bid, ask = fold.book.best()
        values = (key[0], event, at_ms, *(fold.stats[c] for c in _STATS), price(bid), price(ask), fold.book.text() if text else None, fold.synced, fold.closed, fold.outcome, fold.last_trade, own["late"], own["events"])
        return pd.DataFrame([values], columns=[c.split()[0] for c in MARKET.split(", ")])

    def _due(self, own: dict, at: int) -> None:
        """One timer at a time: the next stage's."""
        if own["due"] is not None and own["due"] != at:
            self.handle.deleteTimer(own["due"])
        if own["due"] != at:
            self.handle.registerTimer(at)
        own["due"] = at

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold, own = self._load()
        before = {side: dict(levels) for side, levels in fold.book.sides.items()}
        for row in pd.concat(list(rows)).sort_values(["recv_ts", "line"], kind="stable").itertuples(index=False):
            own["late"] += row.recv_ts < own["latest"]
            own["latest"], own["events"] = max(own["latest"], row.recv_ts), own["events"] + 1
            fold.apply(row.kind, book._payload(row))
            if row.kind == "market_open" and own["stage"] != "resolved":
                own["window_end"], own["stage"] = int(row.payload["windowEnd"]), "open"
            elif row.kind == "resolution":
                own["stage"] = "resolved"
        now = own["latest"] // 1_000_000
        if own["stage"] == "resolved":
            self._due(own, now + self.linger_ms)
        elif own["stage"] == "unopened":
            self._due(own, now + self.give_up_ms)
        elif own["stage"] == "open":
            self._due(own, own["window_end"])
        self._store(fold, own, before)
        yield self._row(key, "update", now, fold, own, self.books)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, own = self._load()
        at, own["due"] = expiredTimerInfo.getExpiryTimeInMs(), None
        if own["stage"] in ("open", "closed"):
            own["stage"] = {"open": "closed", "closed": "awaiting"}[own["stage"]]
            self._due(own, own["window_end"] + (self.grace_ms if own["stage"] == "closed" else self.give_up_ms))
            self._store(fold, own, fold.book.sides)
            yield self._row(key, own["stage"], at, fold, own, False)
            return
        self.levels.clear()
        self.seen.clear()
        yield self._row(key, "resolved" if own["stage"] == "resolved" else "given_up", at, fold, own, True)

    def close(self) -> None:
        pass


class FeedProcessor(StatefulProcessor):
    """One feed: counts what arrives, reports each silence once, when data resumes, and says when a feed goes silent or is back.

    Rows: 'gap' for a pause longer than silence_ms, with its start; 'silent' when down_ms of event time pass without an
    event, 'recovered' with the next one; 'counters' once a batch. A feed without events for forget_ms leaves the state.
    Its rows are those of `_sliced`: a slice is no longer than silence_ms, so no pause that counts lies within one.
    """

    def __init__(self, silence_ms: int = 10_000, down_ms: int = 60_000, forget_ms: int = 86_400_000):
        self.silence_ms, self.down_ms, self.forget_ms = silence_ms, down_ms, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ms long, down boolean, due long, events long, gaps long, sequence_breaks long, reconnects long, max_gap_ms double")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FEED.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, down, due, events, gaps, breaks, reconnects, most = self.seen.get() if self.seen.exists() else (None, False, None, 0, 0, 0, 0, 0.0)
        out = []
        frame = pd.concat(list(rows))
        report = frame["reason"].notna()
        data = frame[~report].groupby("slice", as_index=False).agg({"ms": "min", "last_ms": "max", "n": "sum"})
        frame = pd.concat([data, frame[report]]).sort_values("ms", kind="stable")
        for ms, until, n, reason, reported in zip(*(frame.reindex(columns=["ms", "last_ms", "n", "reason", "gap_ms"])[c].tolist() for c in ("ms", "last_ms", "n", "reason", "gap_ms"))):
            counters = lambda: (events, gaps, breaks, reconnects, most)
            if isinstance(reason, str):  # the recorder's own report of what it missed
                gaps, breaks, reconnects = gaps + (reason != "sequence_break"), breaks + (reason == "sequence_break"), reconnects + (reason == "reconnect")
                most = max(most, float(reported))
                continue
            if down:
                down = False
                out.append((key[0], "recovered", ms, last, ms - last, *counters()))
            if last is not None and ms - last > self.silence_ms:
                out.append((key[0], "gap", ms, last, ms - last, *counters()))
            last, events = until if last is None else max(last, until), events + n
        if last is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = last + (self.forget_ms if down else self.down_ms)
            self.handle.registerTimer(due)
            out.append((key[0], "counters", last, None, None, events, gaps, breaks, reconnects, most))
        self.seen.update((last, down, due, events, gaps, breaks, reconnects, float(most)))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, down, due, *counters = self.seen.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if down:
            self.seen.clear()
            yield self._frame([(key[0], "forgotten", at, last, at - last, *counters)])
            return
        due = last + self.forget_ms
        self.handle.registerTimer(due)
        self.seen.update((last, True, due, *counters))
        yield self._frame([(key[0], "silent", at, last, at - last, *counters)])

    def close(self) -> None:
        pass


def _timed(events: DataFrame, late: str) -> DataFrame:
    """events with `at`, their arrival as a timestamp, and a watermark `late` behind it."""
    return events.withColumn("at", F.timestamp_millis(F.expr("recv_ts div 1000000"))).withWatermark("at", late)


def markets(events: DataFrame, processor: MarketProcessor | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows of MARKET as a stream of events (tidebook.schema) goes by. Events later than `late` behind the newest are dropped."""
    own = _timed(events.where("market_id is not null").select("market_id", "token", "kind", "recv_ts", "line", book.folded_fields()), late)
    return own.groupBy("market_id").transformWithStateInPandas(processor or MarketProcessor(), MARKET, "append", "eventTime")


def feed_of() -> Column:
    """The feed that an event came by: the order book's, a spot venue's or the reference price's; a reported gap's own."""
    return F.coalesce(F.when(F.col("kind") == "feed_gap", F.col("payload.feed")), F.when(F.col("kind") == "spot", F.concat(F.lit("spot:"), "payload.source")), F.when(F.col("kind") == "res_price", F.lit("oracle")), F.lit("clob"))


_SLICED = "feed string, ms long, reason string, gap_ms double, slice long, last_ms long, n long"


def _sliced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events of each feed in a slice of time as one row (first and last time, number) before they meet in their feed's one task; reports stay."""
    for frame in frames:
        report = frame["reason"].notna()
        data = frame[~report].groupby(["feed", "slice"], as_index=False).agg(ms=("ms", "min"), last_ms=("ms", "max"), n=("ms", "size"))
        reports = frame[report].assign(last_ms=frame["ms"], n=1)
        yield pd.concat([data.assign(reason=None, gap_ms=None), reports])[[c.split()[0] for c in _SLICED.split(", ")]]


def feeds(events: DataFrame, processor: FeedProcessor | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows of FEED as a stream of events goes by."""
    processor = processor or FeedProcessor()
    gap, ms = F.col("kind") == "feed_gap", F.expr("recv_ts div 1000000")
    each = events.select(feed_of().alias("feed"), ms.alias("ms"), F.when(gap, F.col("payload.reason")).alias("reason"), F.when(gap, F.col("payload.gapMs")).alias("gap_ms"), F.floor(ms / max(processor.silence_ms, 1)).alias("slice"))
    own = each.mapInPandas(_sliced, _SLICED).withColumn("at", F.timestamp_millis("last_ms")).withWatermark("at", late)
    return own.groupBy("feed").transformWithStateInPandas(processor, FEED, "append", "eventTime")


def feed_counters(events: DataFrame) -> DataFrame:
    """(feed, events, gaps, sequence_breaks, reconnects, max_gap_ms): what the streams' counters end at, by one aggregate."""
    gap, reason = F.col("kind") == "feed_gap", F.col("payload.reason")
    return events.groupBy(feed_of().alias("feed")).agg(
        F.count_if(~gap).alias("events"), F.count_if(gap & (reason != "sequence_break")).alias("gaps"), F.count_if(gap & (reason == "sequence_break")).alias("sequence_breaks"),
        F.count_if(gap & (reason == "reconnect")).alias("reconnects"), F.coalesce(F.max(F.when(gap, F.col("payload.gapMs"))), F.lit(0.0)).alias("max_gap_ms"),
    )


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which transformWithState asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_all(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there goes through a stream once; its rows are appended to Parquet files under path and read back."""
    spark = rows.sparkSession
    with state_store(spark):
        query = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
