"""First and last rows per key, lookups that hold only from a point of the stream on, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], best) -> DataFrame:
    """One row per key by min_by or max_by: partial aggregates before the shuffle, no sort, safe for hot keys."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    out = df.groupBy(*keys).agg(best(row, F.struct(*order)).alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first by order. Name enough order columns to leave no tie."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def after_first(events: DataFrame, keys: list[str], order: Column, opens: Column) -> DataFrame:
    """Events of a key that come after its first opening event; keys that never open lose all theirs.

    The first opening per key is aggregated and joined back, so no key is sorted or held in one task.
    """
    marks = events.where(opens).groupBy(*keys).agg(F.min(order).alias("_opened"))
    return events.join(marks, keys).where(order > F.col("_opened")).drop("_opened")


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tie: int = 0) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before its time (null if there is none).

    Spark has no AS OF join: both sides go into one stream, and a window carries the last value forward. With tie=1,
    right rows of the very same time do not count.
    """
    marked = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(1 - tie).alias("_side"), F.lit(True).alias("_left"))
    other = right.select(*keys, time, F.col(value).alias("_value"), F.lit(tie).alias("_side"), F.lit(False).alias("_left"))
    both = marked.unionByName(other, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_left").select(*[c for c in left.columns if c != value], value)


def markets(opens: DataFrame, resolutions: DataFrame, health: DataFrame) -> DataFrame:
    """One row per market: its first open, its latest resolution and its health; unknown health means excluded."""
    order = [c for c in ("recv_ts", "date", "hour", "line") if c in opens.columns]
    first = first_per_key(opens, ["market_id"], order).select("market_id", "slug", "window_start", "window_end")
    last = last_per_key(resolutions, ["market_id"], [c for c in order if c in resolutions.columns]).select("market_id", "outcome", "price_to_beat", "final_price")
    joined = first.join(last, "market_id", "left").join(health, "market_id", "left")
    known = [c for c in health.columns if c not in ("market_id", "excluded", *first.columns, *last.columns)]
    return joined.select(
        "market_id", "slug", "window_start", "window_end",
        F.timestamp_millis("window_start").cast("timestamp_ntz").alias("window_start_utc"),
        "outcome", "price_to_beat", "final_price",
        F.coalesce("excluded", F.lit(True)).alias("excluded"),
        *known,
    )
