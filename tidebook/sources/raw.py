"""Raw hours: line-numbered NDJSON files raw/YYYY-MM-DD/HH.ndjson[.gz], one event a line."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook import schema as S
from tidebook.operators import digest as tree

_HOUR = re.compile(r"/(\d{4}-\d{2}-\d{2})/(\d{2})\.ndjson(\.gz)?$")


def list_hours(spark: SparkSession, data_dir: str, dates: list[str] | None = None) -> list[tuple[str, int, str]]:
    """(date, hour, path) of all raw hours, oldest first. A gzipped hour wins over a plain twin. Missing folder: none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/raw")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found: dict[tuple[str, int], str] = {}
    files = fs.listFiles(root, True)
    while files.hasNext():
        path = files.next().getPath().toString()
        if (m := _HOUR.search(path)) and (dates is None or m[1] in dates) and int(m[2]) < 24:
            key = m[1], int(m[2])
            if m[3] or key not in found:
                found[key] = path
    return [(*key, found[key]) for key in sorted(found)]


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(date, hour, line, value): lines counted from 1 in each file, blank ones too.

    Files are read twice: first the lines of each of their blocks are counted, one row a block, so that no file's lines have to meet.
    """
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = text.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    above = F.coalesce(F.sum("_n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    text = text.join(F.broadcast(blocks.select("_file", "_block", "_first", above.alias("_above"))), ["_file", "_block"])
    part = lambda n: F.regexp_extract("_file", r"/(\d{4}-\d{2}-\d{2})/(\d{2})\.ndjson", n)
    return text.select(part(1).cast("date").alias("date"), part(2).cast("int").alias("hour"), (F.col("_at") - F.col("_first") + F.col("_above") + 1).cast("int").alias("line"), "value")


def parsed(lines: DataFrame) -> DataFrame:
    """lines with value parsed: the columns of an event line and `ok`.

    What is parsed comes out of an explode, which no filter on it passes: below it each field that the filter names is parsed by itself.
    """
    own = [c for c in lines.columns if c != "value"]
    read = F.from_json(F.col("value"), S.LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(*own, "value", F.explode(F.array(read)).alias("e")).select(*own, "value", "e.*").withColumn("ok", S.valid())


def events_of(lines: DataFrame) -> DataFrame:
    """The valid events of parsed lines, in the columns of tidebook.schema.EVENT."""
    return lines.where("ok").select(
        "kind", F.col("marketId").alias("market_id"), "token", F.floor(F.col("exchangeTs") + 0.5).alias("exchange_ts"), F.col("recvTs").cast("long").alias("recv_ts"), "payload", "date", "hour", "line"
    )


def bad_lines(lines: DataFrame) -> DataFrame:
    """(date, hour, line, value): lines that are neither blank nor events."""
    return lines.where(~F.col("ok") & (F.trim("value") != "")).select("date", "hour", "line", "value")


def read_raw(spark: SparkSession, data_dir: str, dates: list[str] | None = None, hours: list[tuple[str, int, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and bad lines of all raw hours, or of those given (date, hour, path)."""
    paths = [p for *_, p in (list_hours(spark, data_dir, dates) if hours is None else hours)]
    lines = parsed(numbered_lines(spark, paths)) if paths else parsed(spark.createDataFrame([], "date date, hour int, line int, value string"))
    return events_of(lines), bad_lines(lines)


def encoded(events: DataFrame) -> DataFrame:
    """(date, hour, line, value): events as raw lines; absent fields are left out."""
    line = F.struct("kind", F.col("market_id").alias("marketId"), "token", F.col("exchange_ts").alias("exchangeTs"), F.col("recv_ts").cast("string").alias("recvTs"), "payload")
    return events.select("date", "hour", "line", F.to_json(line).alias("value"))


def canonical(events: DataFrame) -> DataFrame:
    """events with `text`, one JSON text for one content, and its `sha256`."""
    fields = sorted(S.payload().names)
    text = F.to_json(F.struct("exchange_ts", "kind", "market_id", F.struct(*[F.col(f"payload.{f}").alias(f) for f in fields]).alias("payload"), "recv_ts", "token"))
    return events.withColumn("text", text).withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))


def digest(events: DataFrame) -> str:
    """A SHA-256 of the stream in its order: the root of the hash tree over its lines."""
    return tree.root(canonical(events)).first()[0]
