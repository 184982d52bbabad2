"""Sanity checks of results as one gate: each check a row that says whether it holds and, if not, what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The checks that are about single rows, fixed by the specification: what a row must hold. Names of columns are those
#: of tidebook.operators.results.decomposed, and quoted, own_size and median_size of quotes.
IDENTITY = 1e-9
SETTLED, SMALL, SMALL_SHARE = 0.999, 0.2, 0.95


def row_checks(rows: DataFrame, key: Column, checks: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """(check, rows, broken, holds, witness): all checks in one pass over rows, from one aggregate.

    A check is (what it is about, what must hold, least share of rows for which it does). witness is the least key of the
    rows that break it, where any do; what is null does not hold.
    """
    parts = []
    for i, (about, holds, _) in enumerate(checks.values()):
        bad = about & ~F.coalesce(holds, F.lit(False))
        parts += [F.count_if(about).alias(f"n{i}"), F.count_if(bad).alias(f"b{i}"), F.min(F.when(bad, key.cast("string"))).alias(f"w{i}")]
    one = rows.agg(*parts)
    listed = [F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("rows"), F.col(f"b{i}").alias("broken"), (F.col(f"b{i}") <= (1 - share) * F.col(f"n{i}") + 1e-9).alias("holds"), F.col(f"w{i}").alias("witness")) for i, (name, (_, _, share)) in enumerate(checks.items())]
    return one.select(F.inline(F.array(*listed)))


def identity(fills: DataFrame) -> tuple[Column, Column, float]:
    """The parts of each fill's result add up to it."""
    return F.lit(True), F.abs(F.col("spread") + F.col("adverse") + F.col("inventory") - F.col("total")) <= IDENTITY * F.greatest(F.lit(1.0), F.abs("total")), 1.0


def deterministic(name: str, first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """A row of the gate: two runs on the same data, as tables of equal columns, agree row by row."""
    text = lambda df, n: df.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), F.xxhash64(*sorted(df.columns)).alias(n))
    count = lambda df, n: text(df, "h").groupBy("key", "h").agg(F.count(F.lit(1)).alias(n))
    met = count(first, "a").join(count(second, "b"), ["key", "h"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    rows = first.agg(F.count(F.lit(1)).alias("rows"))
    broken = met.agg(F.count_distinct("key").alias("broken"), F.min("key").alias("witness"))
    return rows.crossJoin(broken).select(F.lit(name).alias("check"), "rows", "broken", (F.col("broken") == 0).alias("holds"), "witness")  # one row each


def zero_strategy(fills: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """A row of the gate: keys that never quoted have no fills."""
    idle = fills.join(quotes.select(*keys).distinct(), keys, "left_anti")
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    found = idle.agg(F.count_distinct(key).alias("broken"), F.min(key).alias("witness"))
    return fills.select(*keys).distinct().agg(F.count(F.lit(1)).alias("rows")).crossJoin(found).select(F.lit("zero strategy").alias("check"), "rows", "broken", (F.col("broken") == 0).alias("holds"), "witness")  # one row each


def gate(checks: list[DataFrame]) -> DataFrame:
    """All checks' rows."""
    return reduce(DataFrame.unionByName, checks)


class Failed(AssertionError):
    """A run whose results broke a check."""


def enforce(found: DataFrame) -> None:
    """Raise if a check does not hold, with what breaks it."""
    if bad := found.where(~F.col("holds")).orderBy("check").collect():  # one row a check
        raise Failed("; ".join(f"{r['check']}: {r['broken']} of {r['rows']}, first {r['witness']}" for r in bad))


def thinned(points: DataFrame, keys: list[str], x: str, y: str, pixels: int) -> DataFrame:
    """points (keys, x, y) thinned to at most four a pixel column: its first, last, lowest and highest (the first of equals).

    A line drawn through them covers the same pixels as one through all points, at any number of points: each key's range
    of x is cut into `pixels` equal columns, and one aggregate finds each column's four.
    """
    ends = points.groupBy(*keys).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    width = F.greatest((F.col("_high") - F.col("_low")) / F.lit(float(pixels)), F.lit(1e-300))
    placed = points.join(ends, keys) if keys else points.crossJoin(ends)  # ends is one row where there are no keys
    placed = placed.withColumn("pixel", F.least(F.floor((F.col(x) - F.col("_low")) / width), F.lit(pixels - 1)).cast("int"))
    point = F.struct(x, y)
    four = [F.min_by(point, point), F.max_by(point, point), F.min_by(point, F.struct(y, x)), F.min_by(point, F.struct(-F.col(y), F.col(x)))]
    found = placed.groupBy(*keys, "pixel").agg(F.array_distinct(F.array_sort(F.array(*four))).alias("p"))
    return found.select(*keys, "pixel", F.inline("p"))
