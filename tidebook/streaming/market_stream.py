"""The same work on a stream: raw files become tables as they close, and books live in per-market state.

Nothing late is dropped: no watermark is set, an event is applied when it arrives and counted if it is older than one
before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook import schema as S
from tidebook.operators import book
from tidebook.sources import hours, raw


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """(value, path) of the lines of raw hour files, as they appear under folder/raw."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").text(f"{folder}/raw").select("value", F.col("_metadata.file_path").alias("path"))


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Valid events of new raw files; order within a market is that of arrival (recv_ts)."""
    lines = raw_stream(spark, folder, files_per_batch).select(F.to_date(F.lit("1970-01-01")).alias("date"), F.lit(0).alias("hour"), F.lit(0).alias("line"), "value")
    return raw.events_of(raw.parsed(lines))


def kind_counts(events: DataFrame, every: str = "15 minutes") -> DataFrame:
    """Events by kind and window of event time, kept up to date."""
    return events.groupBy(F.window(F.timestamp_millis("exchange_ts"), every)["start"].alias("window_start"), "kind").agg(F.count(F.lit(1)).alias("n"))


def _state_of(fold: book.MarketFold, latest: int, late: int) -> str:
    sides = {s: sorted(levels.items()) for s, levels in fold.book.sides.items()}
    return json.dumps({"sides": sides, "synced": fold.synced, "closed": fold.closed, "outcome": fold.outcome, "last_trade": fold.last_trade, "tick": fold.tick, "stats": fold.stats, "latest": latest, "late": late})


def _fold_of(text: str) -> tuple[book.MarketFold, int, int]:
    kept, fold = json.loads(text), book.MarketFold()
    fold.book.sides = {s: {int(k): v for k, v in levels} for s, levels in kept["sides"].items()}
    fold.synced, fold.closed, fold.outcome, fold.last_trade, fold.tick, fold.stats = (kept[k] for k in ("synced", "closed", "outcome", "last_trade", "tick", "stats"))
    return fold, kept["latest"], kept["late"]


def _apply(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fold, latest, late = _fold_of(state.get[0]) if state.exists else (book.MarketFold(), -1, 0)
    rows = pd.concat(list(frames)).sort_values("recv_ts", kind="stable")
    for row in rows.itertuples(index=False):
        late += row.recv_ts < latest
        latest = max(latest, row.recv_ts)
        fold.apply(row.kind, book._payload(row))
    state.update((_state_of(fold, latest, late),))
    yield pd.DataFrame([{"market_id": key[0], **fold.stats, "book": fold.book.text(), "synced": fold.synced, "closed": fold.closed, "outcome": fold.outcome, "late": late}])


def verified_books(events: DataFrame) -> DataFrame:
    """Per market and batch, the counters and the book so far; the last row of a market equals the batch result."""
    out = f"market_id string, {book.STATS}, book string, synced boolean, closed boolean, outcome string, late long"
    wanted = events.where("market_id is not null").select("market_id", "token", "kind", "recv_ts", "payload")
    return wanted.groupBy("market_id").applyInPandasWithState(_apply, out, "state string", "update", GroupStateTimeout.NoTimeout)


def file_tables(events: DataFrame, data_dir: str, checkpoint: str):
    """A running query that appends each batch's rows to the tables of the lake, by arrival date and hour.

    Batches are named in their files' folder, so one that runs twice replaces what it wrote before.
    """
    from tidebook.sources import lake

    def write(batch: DataFrame, number: int) -> None:
        at = F.timestamp_seconds(F.expr("recv_ts div 1000000000"))
        filed = batch.withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at)).persist()
        try:
            for table in S.TABLES:
                rows = lake.rows_for(filed, table)
                rows.write.mode("overwrite").parquet(f"{data_dir}/stream/{table}/batch={number}", compression="zstd")
        finally:
            filed.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_hours(events: DataFrame, data_dir: str, checkpoint: str, late_ms: int | None = 600_000):
    """A running query that stages each batch's events as gzipped lines, by arrival, and closes the hours that are over.

    Lines lie under stream_raw/batch=N/date=/hour= until sources.hours.close_hours makes an hour's file of them, which
    happens once events have arrived late_ms beyond the hour (never, if None). A batch that runs twice replaces what it
    wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = F.timestamp_seconds(F.expr("recv_ts div 1000000000"))
        filed = batch.withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at)).withColumn("line", F.col("recv_ts")).persist()
        try:
            hours.stage(raw.encoded(filed), data_dir, number)
            newest = filed.agg(F.max("recv_ts")).first()[0]
        finally:
            filed.unpersist()
        if late_ms is not None and newest is not None:
            over = datetime.fromtimestamp((newest // 1_000_000 - late_ms) / 1000, timezone.utc)
            hours.close_hours(batch.sparkSession, data_dir, (over.date().isoformat(), over.hour))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """The events that record_hours staged and has not closed, with date and hour; line is null, as their order is that of recv_ts."""
    lines = spark.read.schema("value string, batch long, date date, hour int").text(f"{data_dir}/stream_raw").select("date", "hour", F.lit(None).cast("int").alias("line"), "value")
    return raw.events_of(raw.parsed(lines))
