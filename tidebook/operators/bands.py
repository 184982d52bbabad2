"""Joins on ranges as equi-joins on bins: points in ranges, and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: One unit of prices that are counted in 1e-18.
UNIT = "1000000000000000000"


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def points_in_ranges(points: DataFrame, t: str, ranges: DataFrame, low: str, high: str, width: int, keys: list[str] = ()) -> DataFrame:
    """Every point with every range [low, high] that holds it (of the same keys). Times are longs.

    A point lies in one bin and a range in all that it touches, so each pair meets once; the width should be about
    that of a range. Only pairs of a shared bin are compared.
    """
    binned = points.withColumn("_bin", F.floor(F.col(t) / width))
    spread = ranges.withColumn("_bin", F.explode(_bins(F.col(low), F.col(high), width)))
    return binned.join(spread, [*keys, "_bin"]).where(F.col(t).between(F.col(low), F.col(high))).drop("_bin")


def overlaps(left: DataFrame, a: tuple[str, str], right: DataFrame, b: tuple[str, str], width: int, keys: list[str] = ()) -> DataFrame:
    """Pairs of intervals with a.end > b.start and a.start < b.end, each once: in the bin where the later one starts."""
    x = left.where(F.col(a[0]) <= F.col(a[1])).withColumn("_bin", F.explode(_bins(F.col(a[0]), F.col(a[1]), width)))
    y = right.where(F.col(b[0]) <= F.col(b[1])).withColumn("_bin", F.explode(_bins(F.col(b[0]), F.col(b[1]), width)))
    met = x.join(y, [*keys, "_bin"]).where((F.col(a[1]) > F.col(b[0])) & (F.col(a[0]) < F.col(b[1])))
    return met.where(F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width) == F.col("_bin")).drop("_bin")


def longest_overlap(left: DataFrame, a: tuple[str, str], right: DataFrame, b: tuple[str, str], width: int, by: list[str], name: str) -> DataFrame:
    """For each row of right (named by `by`) the longest part of a left interval inside it, 0 where none overlaps."""
    met = overlaps(left, a, right, b, width).groupBy(*by).agg(F.max(F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0]))).alias(name))
    return right.join(met, by, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def twap(ticks: DataFrame, boundaries: DataFrame, first_ms: int, last_ms: int, step_ms: int = 1000) -> DataFrame:
    """Mean of the ticks (ts, ord, scaled) around each boundary (boundary), as an exact count of scaled units.

    Of ticks with one ts the first by ord counts. Columns: boundary, ticks, expected, mean_scaled (truncated decimal),
    mean (double). Boundaries without ticks have 0 and nulls.
    """
    own = ticks.groupBy("ts").agg(F.min_by("scaled", "ord").alias("scaled"))
    ranges = boundaries.select("boundary", (F.col("boundary") + first_ms).alias("_low"), (F.col("boundary") + last_ms).alias("_high"))
    met = points_in_ranges(own, "ts", ranges, "_low", "_high", max(1, last_ms - first_ms))
    sums = met.groupBy("boundary").agg(F.count(F.lit(1)).alias("ticks"), F.sum(F.col("scaled").cast("decimal(28,0)")).alias("_sum"))
    mean = F.floor(F.col("_sum") / F.col("ticks").cast("decimal(10,0)"))
    whole = F.floor(F.col("mean_scaled") / F.lit(UNIT).cast("decimal(19,0)")).cast("double")
    part = (F.col("mean_scaled") % F.lit(UNIT).cast("decimal(19,0)")).cast("double") / F.lit(1e18)
    out = boundaries.select("boundary").join(sums.withColumn("mean_scaled", mean.cast("decimal(38,0)")), "boundary", "left")
    return out.select("boundary", F.coalesce("ticks", F.lit(0).cast("long")).alias("ticks"), F.lit((last_ms - first_ms) // step_ms + 1).cast("long").alias("expected"), "mean_scaled", (whole + part).alias("mean"))


def one_tick_per_time(ticks: DataFrame) -> DataFrame:
    """(ts, scaled, ord): the last live tick that has an exact price wins, else the first of the rest."""
    from tidebook.functions.scalars import scaled_price

    exact = F.nullif(F.col("scaled"), F.lit("")).cast("decimal(38,0)")
    picked = ticks.groupBy("ts").agg(F.max_by(exact, F.when(exact.isNotNull(), F.col("ord"))).alias("_exact"), F.min_by(scaled_price(F.col("price")).cast("decimal(38,0)"), "ord").alias("_rough"), F.min("ord").alias("ord"))
    return picked.select("ts", F.coalesce("_exact", "_rough").alias("scaled"), "ord")
