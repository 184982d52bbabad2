"""Mergeable sketches stored by hour: distinct counts and quantiles of any range without its events.

Each hour's state is one row a group: an HLL sketch for distinct values, a KLL sketch for quantiles. A range merges its
hours' rows; their size depends on the sketches' precision alone, not on the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Precision of distinct counts (log2 of the sketch's cells) and four standard errors of it.
LG_CELLS, DISTINCT_ERROR = 12, 4 * 1.04 / 2**6
#: Precision of quantiles, and the error of a rank that it promises (with a confidence of 99 %, and room for merging).
KLL_K, RANK_ERROR = 400, 0.02


def store(events: DataFrame, keys: list[str], hour: str, path: str, distinct: dict[str, Column] | None = None, quantiles: dict[str, Column] | None = None) -> DataFrame:
    """Write a row of sketches for each of the keys and hour to path and read them back; quantiles are of whole numbers."""
    made = [F.hll_sketch_agg(c, F.lit(LG_CELLS)).alias(n) for n, c in (distinct or {}).items()]
    made += [F.kll_sketch_agg_bigint(c, F.lit(KLL_K)).alias(n) for n, c in (quantiles or {}).items()]
    events.groupBy(*keys, hour).agg(*made).write.partitionBy(hour).parquet(path)
    return events.sparkSession.read.parquet(path)


def merged(stored: DataFrame, keys: list[str], distinct: list[str] | None = None, quantiles: dict[str, list[float]] | None = None) -> DataFrame:
    """(keys, names): for each of distinct an estimate of how many, for each of quantiles an array of values at the given ranks."""
    parts = [F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in distinct or []]
    parts += [F.kll_merge_agg_bigint(n).alias(n) for n in quantiles or {}]
    out = stored.groupBy(*keys).agg(*parts)
    at = {n: F.array(*[F.kll_sketch_get_quantile_bigint(F.col(n), F.lit(q)) for q in qs]) for n, qs in (quantiles or {}).items()}
    return out.select(*keys, *(distinct or []), *[c.alias(n) for n, c in at.items()])
