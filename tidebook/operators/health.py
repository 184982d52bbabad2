"""Each market's data quality: what was missed, what the reference price says, and whether the market is fit for use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import bands, gaps


#: Lines of an hour that one task looks through for silences.
SLICE = 8192


@dataclass(frozen=True)
class HealthRules:
    length_ms: int = 900_000
    symbol: str = "btc/usd"
    twap_first_ms: int = -62_000
    twap_last_ms: int = -3_000
    tie: str = "UP"
    tolerance: float = 1.0
    max_gap_ms: int = 3_000
    late_sec: float = 5.0
    least_ticks: float = 0.95


def _ord():
    return F.struct("date", "hour", "line")


def market_health(events: DataFrame, from_ms: int, to_ms: int, now_ms: int, rules: HealthRules = HealthRules()) -> DataFrame:
    """One row per market whose window starts in [from_ms, to_ms), as judged at now_ms.

    Only events after a market's first open count for it. Silences are found against the running maximum of arrival
    times, in slices of SLICE lines and over their borders. Book events are windowed per market; all else is aggregates.
    """
    e = events.withColumn("t", F.expr("recv_ts div 1000000")).withColumn("ord", _ord())
    opens = e.where("kind = 'market_open'").groupBy("market_id").agg(F.min_by(F.struct("payload.slug", "payload.windowStart", "payload.windowEnd"), "ord").alias("m"), F.min("ord").alias("opened"))
    opens = opens.select("market_id", "opened", F.col("m.slug").alias("slug"), F.col("m.windowStart").cast("long").alias("window_start"), F.col("m.windowEnd").cast("long").alias("window_end"))
    windows = opens.where((F.col("window_start") >= from_ms) & (F.col("window_start") < to_ms)).select("market_id", "slug", "window_start", "window_end")

    own = e.join(opens, "market_id").where(F.col("ord") > F.col("opened"))
    book = own.where(F.col("kind").isin("book_delta", "book_snapshot", "trade"))
    prev = F.lag("t").over(W.partitionBy("market_id").orderBy("date", "hour", "line"))
    hole = F.least("t", "window_end") - F.greatest(F.coalesce(prev, F.col("window_start")), F.col("window_start"))
    book = book.withColumn("hole", hole).groupBy("market_id").agg(
        F.count_if(F.col("kind") == "book_delta").alias("deltas"), F.count_if(F.col("kind") == "trade").alias("trades"), F.count_if(F.col("kind") == "book_snapshot").alias("snapshots"),
        F.min_by("t", "ord").alias("first_t"), F.max_by("t", "ord").alias("last_t"), F.max("hole").alias("hole"),
    )
    other = own.where(F.col("kind").isin("feed_gap", "resolution")).groupBy("market_id").agg(
        F.max(F.when(F.col("kind") == "feed_gap", F.col("payload.gapMs"))).alias("own_gap"),
        F.max_by(F.struct("payload.outcome", "payload.priceToBeat", "payload.finalPrice"), F.when(F.col("kind") == "resolution", F.col("ord"))).alias("r"),
    )

    # silences of the whole recording; an hour is cut into slices of lines, so a busy one is many tasks' work
    part = F.unix_date("date").cast("long") * (24 << 18) + F.col("hour") * (1 << 18) + F.expr(f"line div {SLICE}")
    silent = gaps.silences(e.select("t", "date", "hour", "line"), "t", ["date", "hour", "line"], part, rules.max_gap_ms).select(F.col("start").alias("hs"), F.col("end").alias("he"))
    holes = bands.longest_overlap(silent, ("hs", "he"), windows, ("window_start", "window_end"), rules.length_ms, ["market_id"], "rec_hole_ms").select("market_id", "rec_hole_ms")

    missed = e.where("kind = 'feed_gap'").join(opens.select("market_id", "opened"), "market_id", "left")
    missed = missed.where(F.col("payload.feed").startswith("spot:") & (F.col("opened").isNull() | (F.col("ord") < F.col("opened"))))
    missed = missed.select((F.col("t") - F.col("payload.gapMs").cast("long")).alias("gs"), F.col("t").alias("ge"), F.col("payload.gapMs").alias("gap"))
    spot = bands.overlaps(missed, ("gs", "ge"), windows, ("window_start", "window_end"), rules.length_ms).groupBy("market_id").agg(F.max("gap").alias("spot_gap"))

    ticks = bands.one_tick_per_time(e.where((F.col("kind") == "res_price") & (F.col("payload.symbol") == rules.symbol)).select(F.col("exchange_ts").alias("ts"), "ord", F.coalesce("payload.scaled", F.lit("")).alias("scaled"), F.col("payload.price").alias("price")))
    counted = bands.points_in_ranges(ticks.select("ts"), "ts", windows.select("market_id", "window_start", (F.col("window_end") - 1).alias("last")), "window_start", "last", rules.length_ms).groupBy("market_id").agg(F.count(F.lit(1)).alias("cl_ticks"))
    bounds = windows.select(F.col("window_start").alias("boundary")).union(windows.select("window_end")).distinct()
    mean = bands.twap(ticks, bounds, rules.twap_first_ms, rules.twap_last_ms).select("boundary", "ticks", "mean")
    at = lambda name, c: mean.select(F.col("boundary").alias(c), F.col("mean").alias(name), F.col("ticks").alias(f"{name}_ticks"))

    m = windows
    for part in (book, other, holes, spot, counted):
        m = m.join(part, "market_id", "left")
    m = m.join(at("s0", "window_start"), "window_start", "left").join(at("s1", "window_end"), "window_end", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    start, end = F.col("window_start"), F.col("window_end")
    tail = F.when(F.lit(now_ms) >= end, end - F.greatest(F.coalesce("last_t", start), start)).otherwise(0)
    m = m.select(
        "market_id", "slug", "window_start", "window_end", *[zero(c).cast("long").alias(c) for c in ("deltas", "trades", "snapshots")],
        F.when(F.col("first_t").isNotNull(), F.greatest(F.lit(0.0), (F.col("first_t") - start) / 1000)).alias("late_sec"),
        F.greatest(zero("hole"), tail, F.lit(0)).cast("long").alias("clob_hole_ms"), "rec_hole_ms", F.greatest(zero("own_gap"), zero("spot_gap")).cast("double").alias("feed_gap_ms"), zero("cl_ticks").cast("long").alias("cl_ticks"),
        "s0", zero("s0_ticks").cast("long").alias("s0_ticks"), "s1", zero("s1_ticks").cast("long").alias("s1_ticks"), S.outcome(F.col("s0"), F.col("s1"), rules.tie).alias("our_outcome"),
        F.col("r.outcome").alias("outcome"), F.col("r.priceToBeat").alias("price_to_beat"), F.col("r.finalPrice").alias("final_price"), (F.col("s0") - F.col("r.priceToBeat")).alias("s0_diff"), (F.col("s1") - F.col("r.finalPrice")).alias("s1_diff"),
    )
    done, off = F.lit(now_ms) >= end, lambda c: F.coalesce(F.abs(F.col(c)) > rules.tolerance, F.lit(False))
    flags = S.flag_list(
        (~done, "OPEN"), (done & F.col("late_sec").isNull(), "NOCLOB"), (done & (F.col("late_sec") > rules.late_sec), "LATE"),
        (done & (F.greatest("clob_hole_ms", "rec_hole_ms", "feed_gap_ms") > rules.max_gap_ms), "GAP"), (done & (F.col("cl_ticks") < rules.least_ticks * rules.length_ms / 1000), "CLTICKS"),
        (done & F.col("outcome").isNull(), "NORES"), (done & (off("s0_diff") | off("s1_diff")), "TWAPΔ"), (done & (F.col("our_outcome") != F.col("outcome")), "SETTLE"),
    )
    return m.withColumn("flags", flags).withColumn("excluded", S.excluded(F.col("flags")))
