"""Hours of raw lines closed into one file each: raw/DATE/HH.ndjson.gz, in the order of arrival, as the rest reads them.

Batches are staged first. Closing an hour makes its file of all batches that ever staged lines of it, puts it in place
by a rename, writes the hour's manifest, and only then sets its batches aside. A crash at any point leaves batches
staged, so the hour is closed again and comes out the same; lines that arrive after it was closed do that too.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PART = re.compile(r"/batch=(\d+)/date=(\d{4}-\d{2}-\d{2})/hour=(\d+)$")


#: Line numbers of an hour that one task stages at most.
STAGED_LINES = 1 << 16


def stage(lines: DataFrame, data_dir: str, batch: int) -> None:
    """Write lines (date, hour, line, value) of a batch, each file of an hour ordered by line, in place of what it wrote before."""
    ordered = lines.repartition("date", "hour", F.expr(f"line div {STAGED_LINES}")).sortWithinPartitions("date", "hour", "line").drop("line")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date", "hour").option("compression", "gzip").text(f"{data_dir}/stream_raw/batch={batch}")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def staged(spark: SparkSession, data_dir: str, folder: str = "stream_raw") -> dict[tuple[str, int], dict[int, str]]:
    """(date, hour) -> batch -> path of what is staged, or set aside with folder="stream_done"."""
    fs, pattern = _hadoop(spark, f"{data_dir}/{folder}/batch=*/date=*/hour=*")
    out: dict[tuple[str, int], dict[int, str]] = {}
    for status in fs.globStatus(pattern) or []:
        path = status.getPath().toString()
        if m := _PART.search(path):
            out.setdefault((m[2], int(m[3])), {})[int(m[1])] = path
    return out


def manifest(spark: SparkSession, data_dir: str) -> DataFrame:
    """(date, hour, lines, batches) of closed hours."""
    kind = "date string, hour int, lines long, batches array<long>"
    fs, p = _hadoop(spark, f"{data_dir}/stream_done/_manifest")
    return spark.read.schema(kind).json(p.toString()) if fs.exists(p) else spark.createDataFrame([], kind)


def _replace(fs, source, there, spark: SparkSession) -> None:
    """Put a file in a place; what was there is out of the way first and gone afterwards."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{there.toString()}.old")
    fs.mkdirs(there.getParent())
    fs.delete(old, True)
    if fs.exists(there):
        fs.rename(there, old)
    fs.rename(source, there)
    fs.delete(old, True)


def close_hours(spark: SparkSession, data_dir: str, before: tuple[str, int] | None = None) -> list[tuple[str, int]]:
    """Close all hours that have staged lines and come before the given one (all, if None); returns them.

    An hour's file has its lines by arrival, equal times by batch. It is written by one task, as its layout is one file.
    """
    waiting = staged(spark, data_dir)
    wanted = sorted(h for h in waiting if before is None or h < before)
    if not wanted:
        return []
    aside = staged(spark, data_dir, "stream_done")
    lines = None
    for folder, parts in (("stream_raw", waiting), ("stream_done", aside)):
        # a batch that stands in both was set aside before a crash: it counts once
        paths = [p for h in wanted for b, p in parts.get(h, {}).items() if folder == "stream_raw" or b not in waiting[h]]
        if paths:
            part = spark.read.option("basePath", f"{data_dir}/{folder}").schema("value string, batch long, date date, hour int").text(paths)
            lines = part if lines is None else lines.unionByName(part)
    side = f"{data_dir}/raw/_new-{uuid.uuid4().hex}"
    at = F.get_json_object("value", "$.recvTs").cast("long")
    number = lambda d, h: Date.fromisoformat(d).toordinal() * 24 + h
    first = number(*wanted[0])
    tasks = min(number(*wanted[-1]) - first + 1, 4 * len(wanted))  # hours that follow each other have a task each
    task = F.pmod((F.unix_date("date") + Date(1970, 1, 1).toordinal()) * 24 + F.col("hour") - first, F.lit(tasks))
    ordered = lines.withColumn("at", at).repartitionById(tasks, task).sortWithinPartitions("date", "hour", "at", "batch", "value")
    ordered.select("value", "date", "hour").write.partitionBy("date", "hour").option("compression", "gzip").text(side)
    counts = {(str(r["date"]), r["hour"]): r["n"] for r in lines.groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n")).collect()}
    for d, h in wanted:
        fs, pattern = _hadoop(spark, f"{side}/date={d}/hour={h}/part-*")
        made = fs.globStatus(pattern)
        _replace(fs, made[0].getPath(), _hadoop(spark, f"{data_dir}/raw/{d}/{h:02}.ndjson.gz")[1], spark)
        batches = sorted({*waiting[d, h], *aside.get((d, h), {})})
        out = fs.create(_hadoop(spark, f"{data_dir}/stream_done/_manifest/{d}-{h:02}.json")[1], True)
        out.write(bytearray(json.dumps({"date": d, "hour": h, "lines": counts[d, h], "batches": batches}).encode()))
        out.close()
        for b, path in waiting[d, h].items():
            away = _hadoop(spark, f"{data_dir}/stream_done/batch={b}/date={d}/hour={h}")[1]
            fs.delete(away, True)
            fs.mkdirs(away.getParent())
            fs.rename(_hadoop(spark, path)[1], away)
    fs, p = _hadoop(spark, side)
    fs.delete(p, True)
    return wanted


def sweep(spark: SparkSession, data_dir: str, before: tuple[str, int]) -> None:
    """Delete the batches set aside of closed hours before the given one, of which no more lines are expected."""
    for h, parts in staged(spark, data_dir, "stream_done").items():
        if h < before:
            for path in parts.values():
                fs, p = _hadoop(spark, path)
                fs.delete(p, True)
