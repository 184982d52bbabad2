"""Hash trees over ordered events: equal roots mean equal streams, and a descent names the first line where two differ.

A leaf covers LEAF line numbers of an hour: the hash of its lines' hashes in order. Up to FAN leaves make a node, nodes
make nodes of the next tier, up to the hour; hours make days, and days a tree of their own. No group is larger than a
leaf or FAN nodes, so any hour, however many lines it has, is spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.session import stored

#: Line numbers of a leaf, and nodes that make one of the next tier.
LEAF, FAN = 4096, 256
#: Tiers over the leaves of an hour, and over days: FAN**TIERS leaves of LEAF lines are more than an int has.
TIERS = 3


def _joined(order: str) -> Column:
    """A hash of the group's hashes in the given order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "sha256"))), lambda x: x["sha256"]), "").cast("binary"), 256).alias("sha256")


def leaves(lines: DataFrame) -> DataFrame:
    """(date, hour, leaf, lines, sha256) of lines (date, hour, line, sha256)."""
    return lines.groupBy("date", "hour", F.expr(f"line div {LEAF}").alias("leaf")).agg(F.count(F.lit(1)).alias("lines"), _joined("line"))


def tree(lines: DataFrame) -> DataFrame:
    """(tier, date, hour, node, parent, sha256): all nodes over lines (date, hour, line, sha256).

    Tiers 0 to TIERS are of an hour (0: leaves; TIERS: the hour), TIERS + 1 has a day a node, those above the tree over days;
    the last is the root. date and hour are null where a node is of more than one; parent is the number of the node above.
    """
    now = leaves(lines).select("date", "hour", F.col("leaf").alias("node"), "sha256")
    out = []
    for tier in range(TIERS):
        up = F.expr(f"node div {FAN}")
        out.append(now.select(F.lit(tier).alias("tier"), "date", "hour", "node", up.alias("parent"), "sha256"))
        now = now.groupBy("date", "hour", up.alias("up")).agg(_joined("node")).withColumnRenamed("up", "node")
    day, none = F.unix_date("date").cast("long"), F.lit(None).cast("int")
    out.append(now.select(F.lit(TIERS).alias("tier"), "date", "hour", F.col("hour").cast("long").alias("node"), day.alias("parent"), "sha256"))
    days = now.groupBy("date").agg(_joined("hour")).select("date", day.alias("node"), "sha256")
    for tier in range(TIERS + 1, 2 * TIERS + 1):
        up = F.expr(f"node div {FAN}")
        own = F.col("date") if tier == TIERS + 1 else F.lit(None).cast("date")
        out.append(days.select(F.lit(tier).alias("tier"), own.alias("date"), none.alias("hour"), "node", up.alias("parent"), "sha256"))
        days = days.groupBy(up.alias("up")).agg(_joined("node")).withColumnRenamed("up", "node")
    out.append(days.agg(_joined("node")).select(F.lit(2 * TIERS + 1).alias("tier"), F.lit(None).cast("date").alias("date"), none.alias("hour"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), "sha256"))
    return reduce(DataFrame.unionByName, out)


def root(lines: DataFrame) -> DataFrame:
    """(sha256): one row, the hash of all lines (date, hour, line, sha256) in their order; that of nothing where there are none."""
    return tree(lines).where(F.col("tier") == 2 * TIERS + 1).select("sha256")


def first_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(date, hour, line, left, right): the first line (date, hour, line, text, sha256) that the two streams do not share, if any.

    left or right is null where only the other has the line. Both trees are stored; the search goes down from the roots
    and reads, tier by tier, the children of one node on either side: at most FAN rows a tier, and the lines of one leaf.
    """
    spark = left.sparkSession
    trees = [stored(tree(x.select("date", "hour", "line", "sha256")), "tree") for x in (left, right)]
    at: dict = {}
    for tier in range(2 * TIERS, -1, -1):
        inside = [t.where(F.col("tier") == tier) for t in trees]
        if "parent" in at:
            inside = [t.where(F.col("parent") == at["parent"]) for t in inside]
        if "hour" in at:
            inside = [t.where((F.col("date") == at["date"]) & (F.col("hour") == at["hour"])) for t in inside]
        a, b = (t.select("node", "date", "hour", F.col("sha256").alias(name)) for t, name in zip(inside, "ab"))
        differ = a.join(b.withColumnsRenamed({"date": "d", "hour": "h"}), "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        first = differ.select("node", F.coalesce("date", "d").alias("date"), F.coalesce("hour", "h").alias("hour")).orderBy("node").limit(1).collect()
        if not first:
            return spark.createDataFrame([], "date date, hour int, line int, left string, right string")
        at["parent"] = first[0]["node"]
        if tier <= TIERS:
            at |= {"date": first[0]["date"], "hour": first[0]["hour"]}
            if tier == TIERS:
                at.pop("parent")  # tiers of an hour are found by the hour
    low = at["parent"] * LEAF
    own = [x.where((F.col("date") == at["date"]) & (F.col("hour") == at["hour"]) & F.col("line").between(low, low + LEAF - 1)).select("date", "hour", "line", F.col("text").alias(name)) for x, name in ((left, "left"), (right, "right"))]
    return own[0].join(own[1], ["date", "hour", "line"], "full").where(~F.col("left").eqNullSafe(F.col("right"))).orderBy("line").limit(1)
