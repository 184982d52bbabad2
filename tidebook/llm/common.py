"""Shared pieces of the training-data operators: table access, scratch space, salted lookups."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A label may be learned only from rows whose crc32 remainder differs from this one.
HELD_OUT_REMAINDER = 1
#: What one Arrow batch of texts holds at most.
BATCH_ROWS, BATCH_BYTES = 1024, "8m"
#: Narrow rows (some 100 bytes) that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by any path Spark itself can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a fresh local one only where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidebook-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder. Nothing is ever written to it twice."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path in the shared folder, for what Spark's own writers have no format for."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after the session was told to hand Python at most BATCH_ROWS rows and BATCH_BYTES at a time.

    Texts have any length, and both sides of the pipe hold a batch whole; a smaller setting of the session's own stays.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may see."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == HELD_OUT_REMAINDER


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 16, how: str = "left", large: bool = False) -> DataFrame:
    """Left join on `key` where one key may hold a large share of `left` and each key has one row in `right`.

    Left rows of a key are dealt over `salts` buckets by `spread`; each right row is copied into every bucket. Spark judges
    the copies by the file that they come from and may broadcast them; large says that right is known to be too large for it.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge") if large else copies, [key, "_salt"], how).drop("_salt")


def looked_up(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """The same join (left, left_anti, left_semi or inner): right, a stored table of narrow rows, is counted, broadcast
    where it has at most BROADCAST_ROWS rows, and joined by a salted shuffle beyond that."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    return salted_left_join(left, right, key, spread, how=how, large=True)


def running_sums(numbers: Column) -> Column:
    """The prefix sums of an array of numbers, in n log n steps: each round adds what stands 1, 2, 4 ... places before."""
    steps = F.when(F.size(numbers) > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers))).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, numbers, lambda sums, step: F.transform(sums, lambda x, i: F.when(i >= step, x + F.get(sums, i - step)).otherwise(x)))


def sampled_labels(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """Labelled rows a model may learn from: not held out, label known, at most `max_rows`.

    The sample is the rows with the least hashes of doc_id, so it is the same on every run; a cut by the hash leaves
    little more than max_rows rows to sort, however many labels there are. Columns: doc_id, text, label.
    Several rows of one doc_id in `labels` count once, and of one doc_id in `docs` the least text counts. The
    sampled labels are broadcast; max_rows bounds their size.
    """
    known = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("label"))
    )
    n = known.count()
    if n > max_rows:
        place = F.pmod(F.xxhash64("doc_id", F.lit(target)), F.lit(1_000_000))
        share = 1_000_000 * (max_rows + 6 * max_rows**0.5) / n  # six deviations: enough rows in all but one of a billion samples
        known = known.where(place <= share).orderBy(place, "doc_id").limit(max_rows)
    known = materialize(known, "labels")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
