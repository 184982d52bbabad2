"""Silences, holes and disorder in event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Parts in one run of the silences' middle level.
PARTS = 4096


def largest_gap(events: DataFrame, key: str, t: str, order: list[str], windows: DataFrame, start: str, end: str) -> DataFrame:
    """For each window (one per key): the longest time without an event, in stream order, its tail included.

    A gap is min(t, end) - max(previous t or start, start). Keys without events have the whole window. A key's rows are
    one sorted group, as long as one market's window.
    """
    w = W.partitionBy(key).orderBy(*order)
    seen = events.join(windows.select(key, start, end), key)
    seen = seen.withColumn("_prev", F.lag(t).over(w)).withColumn("_last", F.row_number().over(w))
    gap = F.least(F.col(t), F.col(end)) - F.greatest(F.coalesce("_prev", F.col(start)), F.col(start))
    most = seen.groupBy(key).agg(F.max(gap).alias("_gap"), F.max_by(t, "_last").alias("_tail"))
    tail = F.col(end) - F.coalesce("_tail", F.col(start))
    return windows.join(most, key, "left").select(*windows.columns, F.greatest(F.coalesce("_gap", F.lit(0).cast("long")), tail).alias("max_gap"))


def _against_latest(events: DataFrame, t: str, order: list[str], part: Column) -> DataFrame:
    """events (t and order) with `_start`, the latest t of all rows before them.

    In three levels, so that no task sees the stream: inside each part (a whole number, an ordered slice of it) a window
    finds the maximum before a row; the parts' own maxima are carried over their borders inside runs of PARTS parts, and
    those of the runs, a table of PARTS times fewer rows, over the borders of these.
    """
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = events.select(t, *[c for c in order if c != t], part.alias("_part")).withColumn("_before", F.max(t).over(inside))
    tops = rows.groupBy("_part").agg(F.max(t).alias("_top"))
    tops = tops.withColumn("_run", F.floor(F.col("_part") / PARTS))
    runs = tops.groupBy("_run").agg(F.max("_top").alias("_top"))
    runs = runs.select("_run", F.max("_top").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)).alias("_early"))
    near = F.max("_top").over(W.partitionBy("_run").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    carried = tops.withColumn("_near", near).join(runs, "_run").select("_part", F.greatest("_near", "_early").alias("_carry"))
    return rows.join(carried, "_part").withColumn("_start", F.greatest("_before", "_carry"))


def silences(events: DataFrame, t: str, order: list[str], part: Column, longest: int) -> DataFrame:
    """(start, end, gap): pauses of the whole stream longer than `longest`, against the running maximum of t.

    part is a whole number that cuts the ordered stream into slices, each of which one task can sort.
    """
    found = _against_latest(events, t, order, part)
    return found.where(F.col(t) - F.col("_start") > longest).select(F.col("_start").alias("start"), F.col(t).alias("end"), (F.col(t) - F.col("_start")).alias("gap"))


def late_rows(events: DataFrame, t: str, order: list[str], part: Column) -> DataFrame:
    """(t, order): rows of the whole stream that are older than one before them; part as in silences."""
    return _against_latest(events, t, order, part).where(F.col(t) < F.col("_start")).select(*dict.fromkeys([t, *order]))


def out_of_order(events: DataFrame, t: str, order: list[str], keys: list[str]) -> DataFrame:
    """Per key, whose rows are one sorted group: events, how many are older than one before them, first and last time."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    late = (F.col(t) < F.max(t).over(w)).cast("int")
    return events.withColumn("_late", F.coalesce(late, F.lit(0))).groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.sum("_late").alias("late"), F.min(t).alias("first_t"), F.max(t).alias("last_t"))


def sequence_breaks(ticks: DataFrame, t: str, order: list[str], keys: list[str], step: int) -> DataFrame:
    """Ticks that come more than one step after the latest before them: keys, t, missing (what is beyond the step)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    late = F.col(t) - F.max(t).over(w) - step
    return ticks.withColumn("missing", late).where("missing > 0").select(*keys, t, "missing")
