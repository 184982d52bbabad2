"""The calendar of windows and where each market stands at a given time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.scalars import slug


def calendar(spark: SparkSession, from_ms: int, to_ms: int, length_ms: int = 900_000, prefix: str = "m") -> DataFrame:
    """(window_start, window_end, slug) of the epoch-aligned windows that start in [from, to)."""
    first = -(-from_ms // length_ms)
    windows = spark.range(first, max(first, -(-to_ms // length_ms))).select((F.col("id") * length_ms).alias("window_start"))
    return windows.select("window_start", (F.col("window_start") + length_ms).alias("window_end"), slug(prefix, F.col("window_start")).alias("slug"))


def standing(windows: DataFrame, now_ms: int, ahead_ms: int = 120_000, grace_ms: int = 30_000, give_up_ms: int = 3_600_000) -> DataFrame:
    """windows (window_start, window_end, resolved) with stage: future, registered, open, closed, awaiting, resolved, given_up."""
    now = F.lit(now_ms)
    stage = (
        F.when(now < F.col("window_start") - ahead_ms, "future").when(now < F.col("window_start"), "registered").when(now < F.col("window_end"), "open")
        .when(F.col("resolved"), "resolved").when(now < F.col("window_end") + grace_ms, "closed").when(now < F.col("window_end") + give_up_ms, "awaiting").otherwise("given_up")
    )
    return windows.withColumn("stage", stage)


def day_report(health: DataFrame, now_ms: int) -> DataFrame:
    """(item, n): markets, closed and usable ones, and how many carry each flag."""
    n = health.agg(F.count(F.lit(1)).alias("markets"), F.count_if(F.col("window_end") <= now_ms).alias("closed"), F.count_if(~F.col("excluded")).alias("usable"))
    counts = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in ("markets", "closed", "usable")])).alias("x")).select("x.*")
    flags = health.where("flags <> ''").select(F.explode(F.split("flags", ",")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(flags)


def report_lines(health: DataFrame, window_sec: int) -> DataFrame:
    """(window_start, line): each market of a day's health as a line of text, columns padded to one width; null is "-"."""
    text = lambda c, digits=None: F.when(c.isNull(), "-").otherwise(c.cast("string") if digits is None else F.format_string(f"%.{digits}f", c))
    start = F.date_format(F.timestamp_millis("window_start"), "HH:mm")
    cells = [
        (start, 6), (text(F.col("deltas")), 8), (text(F.col("trades")), 8), (text(F.col("snapshots")), 7), (text(F.col("late_sec"), 1), 9), (text(F.col("clob_hole_ms")), 10), (text(F.col("rec_hole_ms")), 9),
        (text(F.col("feed_gap_ms"), 0), 9), (F.concat(text(F.col("cl_ticks")), F.lit(f"/{window_sec}")), 9), (text(F.col("our_outcome")), 6), (text(F.col("s0_diff"), 9), 13), (text(F.col("s1_diff"), 9), 15), (F.when(F.col("excluded"), "yes").otherwise(""), 5),
    ]
    padded = [F.when(F.length(c) < n, F.lpad(c, n, " ")).otherwise(c) for c, n in cells]
    return health.select("window_start", F.rtrim(F.concat_ws(" ", *padded, F.coalesce("flags", F.lit("")))).alias("line"))


_HEADING = ("window", 6), ("deltas", 8), ("trades", 8), ("snaps", 7), ("late(s)", 9), ("bookHole", 10), ("recHole", 9), ("feedGap", 9), ("ticks", 9), ("ours", 6), ("s0 diff", 13), ("s1 diff", 15), ("excl", 5)


def report_text(health: DataFrame, events: DataFrame, day: str, window_sec: int, bad_lines: int = 0) -> DataFrame:
    """(place, line): a day's report in full: events read by kind, the heading, a line for each market, totals and flags.

    health has a row for each market of the day; expected are as many as the day has windows. Counts come from
    aggregates; the lines are as many as the markets.
    """
    spark = health.sparkSession
    kinds = events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit(" "), x["n"].cast("string"))), ", ")
    read = kinds.agg(F.format_string(f"{day}: %,d events read{f', {bad_lines} bad lines' if bad_lines else ''}  %s", F.coalesce(F.sum("n"), F.lit(0).cast("long")), text).alias("line")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), "line")
    heading = spark.createDataFrame([(1, 0, " ".join(name.rjust(n) for name, n in _HEADING) + " flags")], "part int, place long, line string")
    markets = report_lines(health, window_sec).select(F.lit(2).alias("part"), F.col("window_start").alias("place"), "line")
    opened = F.array_contains(F.split("flags", ","), "OPEN")
    n = health.agg(F.count(F.lit(1)).alias("n"), F.count_if(~opened).alias("closed"), F.count_if(~opened & ~F.col("excluded")).alias("usable"))
    totals = n.select(F.lit(3).alias("part"), F.lit(0).cast("long").alias("place"), F.format_string(f"markets: %d/{86_400 // window_sec} recorded, %d closed, %d usable", "n", "closed", "usable").alias("line"))
    flags = health.where("flags <> ''").select(F.explode(F.split("flags", ",")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    flagged = flags.agg(F.concat(F.lit("flags: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flag", "n"))), lambda x: F.concat(x["flag"], F.lit(" "), x["n"].cast("string"))), ", ")).alias("line")).select(F.lit(4).alias("part"), F.lit(0).cast("long").alias("place"), "line")
    every = read.unionByName(heading).unionByName(markets).unionByName(totals).unionByName(flagged)
    return every.orderBy("part", "place").select((F.col("part") * 10**15 + F.col("place")).alias("place"), "line")


def feed_gaps(arrivals: DataFrame, keys: list[str], ms: str, silence_ms: int) -> DataFrame:
    """(keys, start, end, gap_ms): silences of a feed, each reported once, when data resumes."""
    before = F.lag(ms).over(W.partitionBy(*keys).orderBy(ms))
    gaps = arrivals.select(*keys, before.alias("start"), F.col(ms).alias("end")).withColumn("gap_ms", F.col("end") - F.col("start"))
    return gaps.where(F.col("gap_ms") > silence_ms)

