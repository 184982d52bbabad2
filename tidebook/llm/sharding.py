"""Sharding by fixed virtual slots: rows hash into 4,096 slots, and a versioned map says which shard holds a slot.

Bytes and rows are summed per slot (a table of at most SLOTS rows, whatever the corpus), slots are dealt to shards
largest first onto the least loaded shard, and the map is stored with a version. Rebalancing edits the map: it
moves whole slots out of overloaded shards, or into a new shard, and writes the next version; rows never hash anew.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.llm.common import materialize, read_table, scratch_path

SLOTS = 4096
SHARDS = 40
#: A row's size: the UTF-8 bytes of its text and this much for its other fields.
ROW_OVERHEAD = 16
#: Rows that one sorting group inside a slot holds on average; more rows make more groups.
GROUP_ROWS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), one row for each of docs.

    A null text has no bytes. A null doc_id hashes by its text, so such rows spread as well. Extra columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(text)), F.lit(SLOTS)).cast("int").alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): partial sums before the shuffle, at most SLOTS rows after it."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _deal(slots: Column, loads: Column) -> Column:
    """Shard of each element of slots (structs with bytes, largest first), each put on the least loaded shard of loads."""

    def put(acc: Column, slot: Column) -> Column:
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        raised = F.transform(acc["loads"], lambda x, i: F.when(i == least, x + slot["bytes"]).otherwise(x))
        return F.struct(raised.alias("loads"), F.concat(acc["owner"], F.array(least)).alias("owner"))

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("owner"))
    return F.aggregate(slots, start, put, lambda acc: acc["owner"])


def _placed(slots: DataFrame, loads: Column) -> DataFrame:
    """slots (virtual_slot, bytes, rows) with the shard that _deal gives them. The list holds at most SLOTS entries."""
    one = slots.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "rows")), asc=False).alias("slots"))
    dealt = one.select(F.arrays_zip("slots", _deal(F.col("slots"), loads).alias("shard")).alias("z"))
    each = dealt.select(F.explode("z").alias("z"))
    return each.select("z.slots.virtual_slot", "z.slots.bytes", "z.slots.rows", F.col("z.shard").alias("shard"))


def slot_map(totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard, bytes, rows). Slots without rows get their shard too."""
    every = totals.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("virtual_slot"))
    full = every.join(F.broadcast(totals), "virtual_slot", "left").select("virtual_slot", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "rows")])
    placed = _placed(full, F.array_repeat(F.lit(0).cast("long"), shards))
    return placed.select(F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def store(slots: DataFrame, path: str | None = None) -> str:
    """Add a version of the map to the table at path (a new one under the shared folder if None); returns the path."""
    path = path or scratch_path(slots.sparkSession, "slot-map")
    slots.write.mode("append").partitionBy("version").parquet(path)
    return path


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the latest if None."""
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "rows")


def rebalanced(slots: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for the byte counts in totals and a number of shards that may have grown.

    Every shard over the mean gives up its smallest slots until it is not over any more; those are dealt, the largest
    first, to the shards with the least. All other slots, and empty ones, stay where they are.
    """
    now = slots.select("version", "virtual_slot", "shard").join(F.broadcast(totals), "virtual_slot", "left")
    now = now.select("version", "virtual_slot", "shard", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "rows")])
    inside = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    mean = F.sum("bytes").over(W.partitionBy()) / F.lit(shards)
    marked = now.withColumn("stays", (F.sum("bytes").over(inside.rowsBetween(W.unboundedPreceding, 0)) <= mean) | (F.col("bytes") == 0))
    marked = materialize(marked, "slots")
    kept = marked.where("stays")
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("load"))
    per_shard = marked.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(loads), "shard", "left")
    start = {r["shard"]: r["load"] or 0 for r in per_shard.collect()}  # one number for each shard
    placed = _placed(marked.where("not stays").select("virtual_slot", "bytes", "rows"), F.array(*[F.lit(start[s]).cast("long") for s in range(shards)]))
    version = (marked.agg(F.max("version")).first()[0] or 0) + 1
    out = kept.select("virtual_slot", "shard", "bytes", "rows").unionByName(placed.select("virtual_slot", "shard", "bytes", "rows"))
    return out.select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def positioned(rows: DataFrame, slots: DataFrame, n_rows: int) -> DataFrame:
    """rows with shard and slot, the row's place in its shard, counted from 0 without gaps.

    Places come from the row counts of small sorting groups inside each virtual slot, so no task sorts a shard.
    """
    groups = max(1, -(-n_rows // (SLOTS * GROUP_ROWS)))
    grouped = rows.join(F.broadcast(slots.select("virtual_slot", "shard")), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(groups)))
    counts = grouped.groupBy("shard", "virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32"))
    return grouped.withColumn("place", place - 1).join(starts, ["virtual_slot", "part"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) dealt to shards with near equal bytes: doc_id, size, text_crc32, virtual_slot, shard, slot, version.

    Null and empty texts have size 16. Repeated rows each get a place. An empty table gives an empty result.
    A document larger than a fair share of the bytes makes its shard that much larger: rows are never cut.
    """
    rows = materialize(sized(docs), "sized")
    totals = materialize(slot_totals(rows), "slot-totals")
    n = totals.agg(F.sum("rows")).first()[0] or 0
    slots = load(docs.sparkSession, store(slot_map(totals, shards)))
    return positioned(rows, slots, n).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot", F.lit(1).alias("version"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard(read_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
