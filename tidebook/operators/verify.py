"""The check of order books without a fold: lives of levels as intervals, stabbed by what the venue reported.

A level lives from the write that set it to the next write of it, the next snapshot, or the first report of a best price
that it beats (then it was consumed: pruned). After a pruning the best level of a side is the reported one exactly if
a level lives there, so each check of a best price is a question about one level: was it set, and has no report
since fallen below it? Both are questions for the least report in a range of reports. Reports are numbered in each
market and lie in blocks of FAN, blocks of blocks and so on, each with the minima of what is below it; a range is
at most two pieces of blocks for each tier, so it meets its answers in equal joins. No Python runs, and no task
needs a market's events in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook import schema as S
from tidebook.functions.scalars import NO_SIZE, PRICE_SCALE, price_key
from tidebook.operators.book import STATS
from tidebook.session import stored

#: Entries of a block of reports.
FAN = 64
#: Levels this near to the best one count as near the top, in millionths.
NEAR = 50_000
#: What stands for the report that a side is empty: below all levels, seen from its side.
EMPTY = -(1 << 40)

_BOOK = ["market_id", "side", "key"]


def _up(token: Column, side: Column, key: Column) -> tuple[Column, Column]:
    """A level seen from UP. Ask keys are negative, so that on both sides a better price is a larger key."""
    buy, own = (side == "BUY") == (token == "UP"), F.when(token == "UP", key).otherwise(F.lit(PRICE_SCALE).cast("long") - key)
    return F.when(buy, "BUY").otherwise("SELL"), F.when(buy, own).otherwise(-own)


def steps(events: DataFrame) -> DataFrame:
    """One row for each change of a message and each other event that matters, numbered by `pos` within its market.

    Columns: what is known before the step (synced), the number of its book (epoch: snapshots so far, its own included),
    the reports before it (r0), whether it is one (report), its level (side, key, size), the best prices it
    reports (bid, ask: keys as of _up; EMPTY for an empty side) and a snapshot's levels.
    """
    token = F.coalesce("token", F.lit("UP"))
    changes = F.when(F.col("kind") == "book_delta", F.col("payload.changes")).otherwise(F.array(F.lit(None).cast(S.payload()["changes"].dataType.elementType)))
    wanted = events.where(F.col("market_id").isNotNull() & F.col("kind").isin("market_open", "book_snapshot", "book_delta", "feed_gap", "market_close", "resolution"))
    rows = wanted.select("market_id", "kind", token.alias("token"), "date", "hour", "line", "payload.bids", "payload.asks", "payload.outcome", F.posexplode(changes).alias("idx", "c"))
    change, snap = F.col("kind") == "book_delta", F.col("kind") == "book_snapshot"
    side, key = _up(F.col("c.token"), F.col("c.side"), price_key(F.col("c.price")))
    best = lambda p, ok: F.when(ok, price_key(p))  # noqa: E731  0 or less, and 1 or more, are how the venue says that a side is empty
    bid, ask = best(F.col("c.bestBid"), F.col("c.bestBid") > 0), best(F.col("c.bestAsk"), F.col("c.bestAsk") < 1)
    down, whole = F.col("c.token") == "DOWN", F.lit(PRICE_SCALE).cast("long")
    up_bid, up_ask = F.when(down, whole - ask).otherwise(bid), F.when(down, whole - bid).otherwise(ask)
    in_order = W.partitionBy("market_id").orderBy("date", "hour", "line", "idx")
    before, upto = in_order.rowsBetween(W.unboundedPreceding, -1), in_order.rowsBetween(W.unboundedPreceding, 0)
    opened = F.coalesce(F.max((F.col("kind") == "market_open").cast("int")).over(before), F.lit(0)) > 0
    turn = F.when(snap, F.lit(True)).when((F.col("kind") == "feed_gap") | ((F.col("kind") == "market_open") & F.col("opened")), F.lit(False))
    rows = rows.withColumn("opened", opened).withColumn("turn", turn).withColumn("pos", F.row_number().over(in_order))
    rows = rows.withColumn("synced", F.coalesce(F.last("turn", ignorenulls=True).over(before), F.lit(False))).withColumn("epoch", F.sum(snap.cast("long")).over(upto))
    rows = rows.withColumn("report", change & F.col("synced")).withColumn("r0", F.coalesce(F.sum(F.col("report").cast("long")).over(before), F.lit(0)))
    return rows.select(
        "market_id", "kind", "token", "pos", F.struct("date", "hour", "line").alias("ord"), "turn", "synced", "epoch", "report", "r0", F.when(change, side).alias("side"), F.when(change, key).alias("key"), F.when(change, F.col("c.size")).alias("size"),
        F.when(F.col("report"), F.coalesce(up_bid, F.lit(EMPTY))).alias("bid"), F.when(F.col("report"), F.coalesce(-up_ask, F.lit(EMPTY))).alias("ask"), F.when(snap, F.col("bids")).alias("bids"), F.when(snap, F.col("asks")).alias("asks"), "outcome",
    )


def _snapshot_levels(at: DataFrame) -> DataFrame:
    """(market_id, side, key, pos, epoch, r0, size) of the levels of snapshots; of one level twice in a snapshot the last counts."""
    def of(column: str, side: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<struct<price:double,size:double>>")), lambda x, i: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["size"].alias("size"), i.alias("i")))

    both = F.concat(of("bids", "BUY"), of("asks", "SELL"))
    each = at.where("kind = 'book_snapshot'").select("market_id", "pos", "epoch", "r0", "token", F.explode(both).alias("x"))
    side, key = _up(F.col("token"), F.col("x.side"), price_key(F.col("x.price")))
    each = each.select("market_id", "pos", "epoch", "r0", side.alias("side"), key.alias("key"), "x.size", "x.i")
    return each.groupBy(*_BOOK, "pos", "epoch", "r0").agg(F.max_by("size", "i").alias("size"))


def _blocks(reports: DataFrame, tiers: int) -> DataFrame:
    """(market_id, tier, block, bids, asks): for each block its up to FAN least reports, in their order.

    reports: (market_id, r, bid, ask), r from 0 in each market. A block of a higher tier has the minima of blocks.
    """
    now, out = reports.select("market_id", F.col("r").alias("i"), "bid", "ask"), None
    for tier in range(tiers):
        listed = now.groupBy("market_id", F.expr(f"i div {FAN}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "bid", "ask"))).alias("l"), F.min("bid").alias("bid"), F.min("ask").alias("ask"))
        part = listed.select("market_id", F.lit(tier).alias("tier"), "block", F.col("l.bid").alias("bids"), F.col("l.ask").alias("asks"))
        out = part if out is None else out.unionByName(part)
        now = listed.select("market_id", F.col("block").alias("i"), "bid", "ask")
    return out


def _fallen(ranges: DataFrame, blocks: DataFrame, tiers: int) -> DataFrame:
    """ranges (market_id, side, key, lo, hi, ...) of reports, with `fallen`: whether one of them lies below the key.

    Tier by tier a range gives off what does not fill whole blocks at its start and at its end, at most a piece of one
    block each; the whole blocks between are a range one tier higher. lo > hi is no range.
    """
    rows = stored(ranges.withColumn("query", F.monotonically_increasing_id()), "ranges")  # stored, so that a query's number stays
    piece = "struct<tier:int,block:bigint,a:bigint,b:bigint>"
    start = lambda t: F.expr(f"(lo + {FAN**t - 1}) div {FAN**t}")
    end = lambda t: F.expr(f"(hi + 1) div {FAN**t}")

    def cut(tier: int) -> Column:
        """Pieces of blocks of this tier: [a, b] inside a block; null ones have nothing."""
        a, b, next_a, next_b = start(tier), end(tier), start(tier + 1), end(tier + 1)
        part = lambda block, a, b: F.when(a < b, F.struct(F.lit(tier).alias("tier"), block.alias("block"), (a - block * FAN).alias("a"), (b - 1 - block * FAN).alias("b")))
        one = F.array(part(next_b, a, b))
        two = F.array(part(next_a - 1, a, next_a * FAN), part(next_b, next_b * FAN, b))
        return F.when(a >= b, F.array().cast(f"array<{piece}>")).when(next_a > next_b, one).otherwise(two)

    pieces = F.filter(F.concat(*[cut(t) for t in range(tiers)]), lambda x: x.isNotNull())
    each = rows.select("market_id", "side", "key", "query", F.inline(F.when(F.col("lo") <= F.col("hi"), pieces)))
    met = each.join(blocks, ["market_id", "tier", "block"])
    least = F.array_min(F.slice(F.when(F.col("side") == "BUY", F.col("bids")).otherwise(F.col("asks")), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a") + 1).cast("int")))
    hit = met.where(least < F.col("key")).select("query").distinct()
    return rows.join(hit.withColumn("fallen", F.lit(True)), "query", "left").withColumn("fallen", F.coalesce("fallen", F.lit(False)))


def verified_books(events: DataFrame) -> DataFrame:
    """Per market, the counters of tidebook.operators.book.verified_books, the final book, synced, closed, outcome and first_wrong,
    the place (date, hour, line) of the first event at which a best price or a level near a snapshot's top was wrong.

    events is the event stream of tidebook.schema. The rows are those of the fold, found by windows and equal joins.
    """
    at = stored(steps(events), "steps")
    longest = at.groupBy("market_id").agg(F.sum(F.col("report").cast("long")).alias("n")).agg(F.max("n")).first()[0] or 0
    tiers = 1
    while FAN**tiers <= longest:
        tiers += 1
    blocks = stored(_blocks(at.where("report").select("market_id", F.col("r0").alias("r"), "bid", "ask"), tiers), "blocks")

    # a market's books: where each ends, and how many reports there were by then
    books = at.where("kind = 'book_snapshot'").select("market_id", "pos", "epoch", "r0", "synced")
    ends = books.select("market_id", (F.col("epoch") - 1).alias("epoch"), F.col("pos").alias("reset"), F.col("r0").alias("reset_r"), F.col("synced").alias("compared"))
    totals = at.groupBy("market_id").agg(F.sum(F.col("report").cast("long")).alias("reports"))
    writes = at.where("kind = 'book_delta'").select(*_BOOK, "pos", "epoch", "r0", "size").unionByName(_snapshot_levels(at))

    # lives: from a write to the next one of the level or the end of the book
    level = W.partitionBy(*_BOOK).orderBy("pos")
    lives = writes.withColumn("next", F.lead("pos").over(level)).withColumn("next_r", F.lead("r0").over(level)).where(F.col("size") > NO_SIZE)
    lives = lives.join(ends, ["market_id", "epoch"], "left").join(totals, "market_id")
    over = F.col("reset").isNotNull() & (F.col("next").isNull() | (F.col("next") >= F.col("reset")))  # the snapshot that ends the book may write the level too
    hi = F.when(over, F.col("reset_r")).when(F.col("next").isNotNull(), F.col("next_r")).otherwise(F.col("reports")) - 1
    last = F.when(over, "reset").when(F.col("next").isNotNull(), "write").otherwise("end")
    asked = lives.select(*_BOOK, "size", "epoch", last.alias("last"), F.coalesce("compared", F.lit(False)).alias("compared"), F.col("r0").alias("lo"), hi.alias("hi"))

    # checks: the last write of the level that a report names, in its book
    looks = at.where("report").select("market_id", "pos", "epoch", "r0", F.explode(F.array(F.struct(F.lit("BUY").alias("side"), F.col("bid").alias("key")), F.struct(F.lit("SELL").alias("side"), F.col("ask").alias("key")))).alias("x")).select("market_id", "x.side", "x.key", "pos", "epoch", "r0").where(F.col("key") != EMPTY)
    write = F.struct("size", "epoch", "r0")
    seen = writes.select(*_BOOK, "pos", write.alias("w"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("r")).unionByName(looks.select(*_BOOK, "pos", F.lit(None).cast(writes.select(write).schema[0].dataType).alias("w"), F.col("epoch").alias("e"), F.col("r0").alias("r")))
    latest = F.last("w", ignorenulls=True).over(W.partitionBy(*_BOOK).orderBy("pos", F.col("e").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    checks = seen.withColumn("w", latest).where("e is not null")
    there = F.coalesce((F.col("w.size") > NO_SIZE) & (F.col("w.epoch") == F.col("e")), F.lit(False))
    checks = checks.select(*_BOOK, F.lit(0.0).alias("size"), F.col("r").alias("epoch"), F.when(there, "look").otherwise("miss").alias("last"), F.lit(False).alias("compared"), F.when(there, F.col("w.r0")).otherwise(1).alias("lo"), F.when(there, F.col("r")).otherwise(0).alias("hi"))

    found = stored(_fallen(asked.unionByName(checks), blocks, tiers).drop("query", "lo", "hi"), "stabbed")
    wrong = found.where(F.col("last").isin("look", "miss") & (F.col("fallen") | (F.col("last") == "miss"))).select("market_id", F.col("epoch").alias("r")).distinct()
    per = lambda df, **named: df.groupBy("market_id").agg(*[c.alias(n) for n, c in named.items()])
    one = F.lit(1)

    # snapshots against the levels that live when they come
    ours = found.where("last = 'reset' and compared and not fallen").select(*_BOOK, (F.col("epoch") + 1).alias("epoch"), F.col("size").alias("ours"))
    checked = books.where("synced").select("market_id", "epoch")
    theirs = _snapshot_levels(at).where(F.col("size") > NO_SIZE).join(checked, ["market_id", "epoch"], "left_semi").select(*_BOOK, "epoch", F.col("size").alias("theirs"))
    tops = theirs.groupBy("market_id", "epoch", "side").agg(F.max("key").alias("top"))
    differ = ours.join(theirs, [*_BOOK, "epoch"], "full").where(F.abs(F.coalesce("ours", F.lit(0.0)) - F.coalesce("theirs", F.lit(0.0))) > NO_SIZE).join(tops, ["market_id", "epoch", "side"], "left")
    near = F.col("top").isNull() | (F.abs(F.col("key") - F.col("top")) <= NEAR)

    shown = found.where("last = 'end' and not fallen").withColumn("key", F.abs("key"))
    digits = F.regexp_replace(F.col("size").cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    side = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("key", digits.alias("size"))))), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["size"])), ",")
    texts = shown.groupBy("market_id").agg(F.concat(F.lit("b["), side("BUY"), F.lit("]a["), side("SELL"), F.lit("]")).alias("book"))

    kind = lambda k: F.col("kind") == k
    out = per(
        at, changes=F.count_if(kind("book_delta")), unsynced_changes=F.count_if(kind("book_delta") & ~F.col("report")), bests_checked=F.count_if("report"), snapshots=F.count_if(kind("book_snapshot")),
        synced=F.coalesce(F.max_by("turn", F.when(F.col("turn").isNotNull(), F.col("pos"))), F.lit(False)), closed=F.max(kind("market_close")), outcome=F.max_by("outcome", F.when(kind("resolution"), F.col("pos"))),
    )
    # the first check that failed: a best price that is no level's, or a snapshot that differs near the top
    failed = wrong.join(at.where("report").select("market_id", F.col("r0").alias("r"), "ord"), ["market_id", "r"]).select("market_id", "ord")
    failed = failed.unionByName(differ.where(near).join(at.where("kind = 'book_snapshot'").select("market_id", "epoch", "ord"), ["market_id", "epoch"]).select("market_id", "ord"))
    parts = [
        per(failed, first_wrong=F.min("ord")), per(found.where("fallen and last in ('reset', 'write', 'end')"), levels_pruned=F.count(one)), per(wrong, best_mismatches=F.count(one)),
        per(differ, snapshots_differing=F.count_distinct("epoch"), levels_differing=F.count(one), near_top_differing=F.count_if(near)), texts,
    ]
    for part in parts:
        out = out.join(part, "market_id", "left")
    out = events.where("market_id is not null").select("market_id").distinct().join(out, "market_id", "left")  # markets without a book are checked too
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("synced", "closed")})
    counters = [c.split()[0] for c in STATS.split(", ")]
    return out.select("market_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters], F.coalesce("book", F.lit("b[]a[]")).alias("book"), "synced", "closed", "outcome", "first_wrong")
