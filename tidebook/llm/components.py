"""Connected components of a sparse graph, as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import BROADCAST_ROWS, materialize

SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) with the least neighbour m of u. A hub's edges are dealt over salts, so no task gets them all. Spark judges
    the copies by the edges' files and may broadcast them; large forbids it."""
    dealt = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies.hint("merge") if large else copies, ["u", "_s"]).drop("_s")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long pairs -> (node, root): root is the smallest node reachable from node.

    Every node that occurs in an edge with another node gets a row. Self loops, nulls and repeated edges are
    ignored. Each round writes its edges to the shared folder, so lineage stays short and lost executors cost
    one round at most. Stops when a round leaves the edges as they were, which star contraction reaches after
    O(log^2 n) rounds; max_rounds only guards against a defect and raises.
    """
    now = materialize(
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    before, large = None, now.count() > BROADCAST_ROWS
    for _ in range(max_rounds):
        # large star: larger neighbours of u move to the least neighbour of u (u itself included)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = _with_least(both, least, large).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.where("u != v").distinct()
        # small star: all smaller neighbours of u, and u, move to the least of them
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
        moved = _with_least(moved, least, large).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == (state["n"], state["h"]):
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = (state["n"], state["h"])
    raise RuntimeError("components did not settle")
