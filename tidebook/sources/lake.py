"""The lake: events fanned out into eleven typed tables under parquet/<table>/date=/hour=, views on them, and replay."""

from __future__ import annotations

import calendar
import uuid
from datetime import date as Date
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import schema as S
from tidebook.operators import keyed
from tidebook.session import scratch
from tidebook.sources import raw


def _p(name: str) -> Column:
    return F.col(f"payload.{name}")


def rows_for(events: DataFrame, table: str) -> DataFrame:
    """The rows of one table. Arrays become one row an element with its place; an empty snapshot is one row without a side."""
    kind = next(k for k, t in S.TABLE_OF.items() if t == table)
    own = events.where(F.col("kind") == kind)
    common = [F.col("line"), F.col("recv_ts"), F.col("exchange_ts")]
    market, token = F.col("market_id"), F.col("token")
    if table == "book_deltas":
        own = own.select("*", F.posexplode("payload.changes").alias("idx", "c"))
        cols = [market, F.col("idx"), F.col("c.token"), F.col("c.side"), F.col("c.price"), F.col("c.size"), F.col("c.bestBid"), F.col("c.bestAsk")]
    elif table == "book_levels":
        sided = lambda name, side: F.transform(_p(name), lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["size"].alias("size")))
        own = own.select("*", F.posexplode_outer(F.concat(sided("bids", "BUY"), sided("asks", "SELL"))).alias("idx", "l"))
        cols = [market, F.coalesce("idx", F.lit(0)), token, F.col("l.side"), F.col("l.price"), F.col("l.size"), _p("hash")]
    else:
        cols = {
            "trades": [market, token, _p("side"), _p("price"), _p("size"), _p("feeRateBps"), _p("txHash")],
            "spot": [_p(x) for x in ("source", "type", "bid", "bidSize", "ask", "askSize", "price", "size", "side")],
            "res_prices": [_p("symbol"), _p("price"), _p("scaled"), F.coalesce(_p("backfill"), F.lit(False))],
            "market_opens": [market, *[_p(x) for x in ("slug", "upTokenId", "downTokenId", "windowStart", "windowEnd", "tickSize", "minOrderSize", "feeSchedule.rate", "feeSchedule.exponent", "feeSchedule.takerOnly", "feeSchedule.rebateRate")]],
            "market_closes": [market, _p("windowEnd")],
            "resolutions": [market, _p("outcome"), _p("priceToBeat"), _p("finalPrice")],
            "feed_gaps": [market, _p("feed"), _p("gapMs"), _p("reason")],
            "tick_size_changes": [market, token, _p("oldTickSize"), _p("newTickSize")],
            "venue_raw": [market, _p("feed"), _p("eventType"), _p("data")],
        }[table]
    return own.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip([*common, *cols, F.col("date"), F.col("hour")], S.struct(S.TABLES[table]))])


def events_for(rows: DataFrame, table: str) -> DataFrame:
    """The inverse: events of the rows of one table. Levels and changes of one line are gathered in their order."""
    kind = next(k for k, t in S.TABLE_OF.items() if t == table)
    by = ["date", "hour", "line", "recv_ts", "exchange_ts", "market_id"]
    fields: dict[str, Column] = {}
    if table == "book_deltas":
        change = F.struct("token", "side", "price", "size", F.col("best_bid").alias("bestBid"), F.col("best_ask").alias("bestAsk"))
        rows = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", change.alias("c")))).alias("l")).withColumn("token", F.lit(None).cast("string"))
        fields = {"changes": F.transform("l", lambda x: x["c"])}
    elif table == "book_levels":
        rows = rows.groupBy(*by, "token", "hash").agg(F.array_sort(F.collect_list(F.struct("idx", "side", "price", "size"))).alias("l"))
        side = lambda s: F.transform(F.filter("l", lambda x: x["side"] == s), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
        fields = {"bids": side("BUY"), "asks": side("SELL"), "hash": F.col("hash")}
    elif table == "market_opens":
        fee = F.struct(F.col("fee_rate").alias("rate"), F.col("fee_exponent").alias("exponent"), F.col("fee_taker_only").alias("takerOnly"), F.col("fee_rebate_rate").alias("rebateRate"))
        fields = {"slug": F.col("slug"), "upTokenId": F.col("up_token_id"), "downTokenId": F.col("down_token_id"), "windowStart": F.col("window_start"), "windowEnd": F.col("window_end"), "tickSize": F.col("tick_size"), "minOrderSize": F.col("min_order_size"), "feeSchedule": fee}
    elif table == "res_prices":
        fields = {"source": F.lit("chainlink"), "symbol": F.col("symbol"), "price": F.col("price"), "scaled": F.col("scaled"), "backfill": F.when(F.col("backfill"), True)}
    else:
        names = {"fee_rate_bps": "feeRateBps", "tx_hash": "txHash", "bid_size": "bidSize", "ask_size": "askSize", "window_end": "windowEnd", "price_to_beat": "priceToBeat", "final_price": "finalPrice", "gap_ms": "gapMs", "old_tick_size": "oldTickSize", "new_tick_size": "newTickSize", "event_type": "eventType"}
        fields = {names.get(c, c): F.col(c) for c in rows.columns if c not in (*by, "token")}
    payload = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.payload()])
    none = F.lit(None).cast("string")
    have = lambda c: F.col(c) if c in rows.columns else none.alias(c)
    return rows.select(F.lit(kind).alias("kind"), have("market_id"), have("token"), "exchange_ts", "recv_ts", payload.alias("payload"), "date", "hour", "line")


# --- files ----------------------------------------------------------------------------------------------------


def _path(data_dir: str, table: str) -> str:
    return f"{data_dir}/parquet/{table}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def has_table(spark: SparkSession, data_dir: str, table: str) -> bool:
    fs, p = _fs(spark, _path(data_dir, table))
    return bool(fs.exists(p)) and any(s.getPath().getName().startswith("date=") for s in fs.listStatus(p))


def read_table(spark: SparkSession, data_dir: str, table: str) -> DataFrame:
    """A table of the lake with its declared columns, typed and empty where nothing was written yet."""
    if not has_table(spark, data_dir, table):
        return S.empty(spark, table)
    return spark.read.schema(S.TABLES[table]).parquet(_path(data_dir, table))


def compacted(spark: SparkSession, data_dir: str) -> set[tuple[str, int]]:
    """Hours whose markers say that all their tables are written."""
    fs, p = _fs(spark, f"{data_dir}/parquet/_done")
    if not fs.exists(p):
        return set()
    rows = spark.read.schema("lines long, events long, bad long, first_bad int, date date, hour int").parquet(f"{data_dir}/parquet/_done").select("date", "hour").distinct().collect()  # one row an hour
    return {(str(r["date"]), r["hour"]) for r in rows}


def _put(spark: SparkSession, new: str, place: str) -> None:
    """Put a folder in a place; what was there goes, also where the new folder is missing, as it has no rows."""
    fs, there = _fs(spark, place)
    source, away = _fs(spark, new)[1], _fs(spark, f"{new}.old")[1]
    if fs.exists(there):
        fs.mkdirs(away.getParent())
        fs.rename(there, away)
    if fs.exists(source):
        fs.mkdirs(there.getParent())
        fs.rename(source, there)


def rows_filed(spark: SparkSession, data_dir: str) -> DataFrame:
    """(table_name, date, hour, n): the rows of each table by hour."""
    out = None
    for table in S.TABLES:
        part = read_table(spark, data_dir, table).groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table_name"), "date", "hour", "n")
        out = part if out is None else out.unionByName(part)
    return out


#: Lines of an hour that one task files at most: a busy hour has several files in each table.
FILE_LINES = 1 << 18
#: Lines of an hour that are parsed together.
PARSED_LINES = 1 << 14


def compact(spark: SparkSession, data_dir: str, dates: list[str] | None = None, force: bool = False, closed_before: tuple[str, int] | None = None) -> DataFrame:
    """Files all closed raw hours that are not done yet; returns (date, hour, lines, events, bad, first_bad) of those.

    Hours before closed_before are closed (all, if None). A backlog is filed day by day. All tables of a day are written
    beside the lake first and then put in place folder by folder, so readers miss an hour for no longer than a rename
    takes; its markers come last, so a day that was interrupted is done again, and those before it are not. Partitions
    are replaced, never added to, and those that a redone hour leaves empty are removed. first_bad is the first line
    of an hour that is neither blank nor an event.
    """
    done = set() if force else compacted(spark, data_dir)
    hours = [h for h in raw.list_hours(spark, data_dir, dates) if h[:2] not in done and (closed_before is None or h[:2] < closed_before)]
    days: dict[str, list[tuple[str, int, str]]] = {}
    for h in hours:
        days.setdefault(h[0], []).append(h)
    rows = [r for own in days.values() for r in _compact_day(spark, data_dir, own)]  # one row an hour
    return spark.createDataFrame(rows, "date date, hour int, lines long, events long, bad long, first_bad int")


def _compact_day(spark: SparkSession, data_dir: str, hours: list[tuple[str, int, str]]) -> list:
    # parsed in parts of hours and stored: a task of what follows reads a split of the columns it needs, however long an hour is
    numbered = raw.numbered_lines(spark, [p for *_, p in hours]).repartition("date", "hour", F.expr(f"line div {PARSED_LINES}"))
    made = raw.parsed(numbered).withColumn("blank", F.trim("value") == "").withColumn("filed", F.when(F.col("ok"), F.col("kind"))).drop("value", "_bad", "kind")
    place = scratch(spark, "parsed")
    try:
        made.write.partitionBy("filed").parquet(place)  # by kind, so that each table's rows are read alone
        lines = spark.read.schema(made.schema).parquet(place)
        events = raw.events_of(lines.withColumnRenamed("filed", "kind"))
        side = f"{data_dir}/parquet/_new-{uuid.uuid4().hex}"
        for table in S.TABLES:
            spread = rows_for(events, table).repartition("date", "hour", F.expr(f"line div {FILE_LINES}"))
            spread.sortWithinPartitions("date", "hour", "line", *(["idx"] if "idx" in S.struct(S.TABLES[table]).names else [])).write.partitionBy("date", "hour").parquet(f"{side}/{table}", compression="zstd")
        bad = ~F.col("ok") & ~F.col("blank")
        report = lines.groupBy("date", "hour").agg(F.count(F.lit(1)).alias("lines"), F.count_if("ok").alias("events"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("line"))).alias("first_bad"))
        listed = spark.createDataFrame([(Date.fromisoformat(d), h) for d, h, _ in hours], "date date, hour int")
        report = listed.join(report, ["date", "hour"], "left").na.fill(0, ["lines", "events", "bad"])
        rows = report.collect()  # one row an hour
        for d, h, _ in hours:
            fs, p = _fs(spark, f"{data_dir}/parquet/_done/date={d}/hour={h}")
            fs.delete(p, True)
            for table in S.TABLES:
                _put(spark, f"{side}/{table}/date={d}/hour={h}", f"{_path(data_dir, table)}/date={d}/hour={h}")
        fs, p = _fs(spark, side)
        fs.delete(p, True)
        spark.createDataFrame(rows, report.schema).write.mode("append").partitionBy("date", "hour").parquet(f"{data_dir}/parquet/_done")
        return rows
    finally:
        fs, p = _fs(spark, place)
        fs.delete(p, True)


# --- views and replay -----------------------------------------------------------------------------------------

HEALTH = "market_id string, deltas long, trades long, snapshots long, late_sec double, clob_hole_ms long, rec_hole_ms long, feed_gap_ms double, cl_ticks long, s0 double, s0_ticks long, s1 double, s1_ticks long, our_outcome string, s0_diff double, s1_diff double, flags string, excluded boolean"


def register_views(spark: SparkSession, data_dir: str) -> list[str]:
    """Temporary views of the eleven tables, market_health and markets; returns their names."""
    for table in S.TABLES:
        read_table(spark, data_dir, table).createOrReplaceTempView(table)
    fs, p = _fs(spark, f"{data_dir}/health")
    health = spark.read.schema(HEALTH + ", date date").parquet(f"{data_dir}/health") if fs.exists(p) else spark.createDataFrame([], HEALTH + ", date date")
    health.createOrReplaceTempView("market_health")
    keyed.markets(read_table(spark, data_dir, "market_opens"), read_table(spark, data_dir, "resolutions"), health.drop("date")).createOrReplaceTempView("markets")
    return [*S.TABLES, "market_health", "markets"]


def sql(spark: SparkSession, data_dir: str, text: str, **args) -> DataFrame:
    """Any query over the views, with named parameters."""
    register_views(spark, data_dir)
    return spark.sql(text, args=args or None)


def write_health(health: DataFrame, data_dir: str, day: str) -> None:
    """One day's health, replaced as a whole; a day without markets has no rows."""
    health.withColumn("date", F.lit(day).cast("date")).repartition(1).sortWithinPartitions("window_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{data_dir}/health", compression="zstd")


def stored_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """All events of the lake, rebuilt from its tables."""
    out = None
    for table in S.TABLES:
        part = events_for(read_table(spark, data_dir, table), table)
        out = part if out is None else out.unionByName(part)
    return out


def planned_hours(spark: SparkSession, data_dir: str, start_ns: int | None = None, end_ns: int | None = None, parquet: bool | None = None) -> tuple[list[tuple[str, int, str]], set[tuple[str, int]]]:
    """Which hours a replay reads: raw ones (date, hour, path), and those it takes from the tables.

    Hours are pruned before any is opened, with an hour to spare on either side, as files are cut by another clock.
    parquet=None takes what is filed from the tables and the other hours raw.
    """
    at = lambda d, h: calendar.timegm(Date.fromisoformat(d).timetuple()) + h * 3600
    inside = lambda d, h: (start_ns is None or at(d, h) >= start_ns // 10**9 - 2 * 3600) and (end_ns is None or at(d, h) <= end_ns // 10**9 + 3600)
    filed = set() if parquet is False else {h for h in compacted(spark, data_dir) if inside(*h)}
    plain = [] if parquet else [h for h in raw.list_hours(spark, data_dir) if inside(*h[:2]) and h[:2] not in filed]
    return plain, filed


def replay(spark: SparkSession, data_dir: str, start_ns: int | None = None, end_ns: int | None = None, markets: list[str] | None = None, parquet: bool | None = False, ordered: bool = True) -> DataFrame:
    """Events in recorded order, from the raw hours, the tables (parquet), or both (None); all give the same rows.

    recv_ts lies in [start, end); events of other markets go, those of no market always stay. Only planned_hours are
    read. What needs no order takes ordered=False: a sort samples the events first, so they are made twice.
    """
    plain, filed = planned_hours(spark, data_dir, start_ns, end_ns, parquet)
    events = _of_hours(spark, data_dir, plain, filed)
    if start_ns is not None:
        events = events.where(F.col("recv_ts") >= start_ns)
    if end_ns is not None:
        events = events.where(F.col("recv_ts") < end_ns)
    if markets is not None:
        events = events.where(F.col("market_id").isNull() | F.col("market_id").isin(markets))
    return events.orderBy(*S.ORDER) if ordered else events


def _of_hours(spark: SparkSession, data_dir: str, plain: list[tuple[str, int, str]], filed: set[tuple[str, int]]) -> DataFrame:
    """The events of raw hours and of hours in the tables, whose partitions alone are read."""
    events, _ = raw.read_raw(spark, data_dir, hours=plain)
    if not filed:
        return events
    by_day: dict[str, list[int]] = {}
    for d, h in filed:
        by_day.setdefault(d, []).append(h)
    wanted = F.lit(False)
    for hours in {tuple(sorted(hs)) for hs in by_day.values()}:  # days with the same hours, most of them whole ones, share a term
        days = sorted(d for d, hs in by_day.items() if tuple(sorted(hs)) == hours)
        wanted = wanted | (F.col("date").isin([Date.fromisoformat(d) for d in days]) & F.col("hour").isin(list(hours)))
    stored = None
    for table in S.TABLES:
        part = events_for(read_table(spark, data_dir, table).where(wanted), table)
        stored = part if stored is None else stored.unionByName(part)
    return stored if not plain else stored.unionByName(events)


def day_events(spark: SparkSession, data_dir: str, day: str, parquet: bool | None = None) -> DataFrame:
    """The events of a day and of the hours around it that its markets reach into: the last before, three after."""
    first = Date.fromisoformat(day)
    near = {str(first - timedelta(days=1)): {23}, day: set(range(24)), str(first + timedelta(days=1)): {0, 1, 2}}
    inside = lambda h: h[1] in near.get(h[0], ())
    filed = set() if parquet is False else {h for h in compacted(spark, data_dir) if inside(h)}
    plain = [] if parquet else [h for h in raw.list_hours(spark, data_dir, list(near)) if inside(h) and h[:2] not in filed]
    return _of_hours(spark, data_dir, plain, filed).orderBy(*S.ORDER)
