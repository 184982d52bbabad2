"""Benchmark decontamination: a broadcast hash set of benchmark windows, probed by the token windows of documents.

Words are made by one rule on both sides. Each window of ten words of a benchmark item (a shorter item is one
window) goes into a hash set that is broadcast while it is small enough and shuffled otherwise; documents are
scanned once, their window hashes probe the set, and hits are verified word by word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import looked_up, materialize, read_table, salted_left_join

WINDOW = 10
#: What stands between words once A-Z are lower-cased: ASCII without 0-9 and a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are lower-cased.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A set of windows of at most this many rows is broadcast (about 100 bytes each); a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, GAP, -1), "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null and empty texts share theirs."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def _starts(n: Column, width: int) -> Column:
    return F.when(n >= width, F.sequence(F.lit(1), n - F.lit(width - 1))).otherwise(F.array().cast("array<int>"))


def _anchor(w: Column, start: Column, width: int) -> Column:
    """A hash of up to four words of the window at start, enough to find it; the whole window is verified later."""
    return F.xxhash64(*[F.get(w, start + F.lit(i - 1)) for i in sorted({0, width // 3, 2 * width // 3, width - 1})])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(width, hash, gram, item_ids): the distinct windows of all items with the items that hold them.

    Items with null text or no word have none. Items with equal ids are one item; a null item_id is kept as "null".
    """
    tokens = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w"))
    tokens = tokens.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(window)))
    hashes = F.lit(None).cast("long")
    for k in range(1, window + 1):
        hashes = F.when(F.col("width") == k, _anchor(F.col("w"), F.col("at"), k)).otherwise(hashes)
    each = tokens.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)))
    each = each.select("item_id", "width", hashes.alias("hash"), F.slice("w", F.col("at"), F.col("width")).alias("gram"))
    return each.groupBy("width", "hash", "gram").agg(F.collect_set("item_id").alias("item_ids"))


def _probed(docs: DataFrame, grams: DataFrame, counted: bool) -> DataFrame:
    """(doc_id, key, width, at, hash): the windows of docs whose hash is in the set; they are candidates.

    Rows that are probed are a few numbers wide, as every window of the corpus passes here. counted adds a row of
    width 0 for each of docs, whose `at` is its number of words plus one; where the set is broadcast, one scan gives
    both.
    """
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())  # at most WINDOW numbers
    small = grams.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    scan = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    of = lambda k: F.transform(_starts(F.size("w"), k), lambda i: F.struct(F.lit(k).alias("width"), i.alias("at"), _anchor(F.col("w"), i, k).alias("hash")))
    count = F.array(F.struct(F.lit(0).alias("width"), (F.size("w") + 1).alias("at"), F.lit(0).cast("long").alias("hash")))
    together = counted and small
    probes = scan.select("doc_id", "key", F.explode(F.concat(*([count] if together or not widths else []), *[of(k) for k in widths])).alias("p"))
    probes = probes.select("doc_id", "key", "p.width", "p.at", "p.hash")
    known = grams.select("width", "hash").distinct()
    if together:  # the added rows meet an entry of their own, so an inner join leaves nothing but them and candidates
        known = known.union(docs.sparkSession.range(1).select(F.lit(0), F.lit(0).cast("long")))
    if small:
        found = probes.join(F.broadcast(known), ["width", "hash"])
    else:  # a window that millions of texts share is dealt over salts
        met = F.struct("width", "hash").alias("met")
        found = salted_left_join(probes.select("*", met), known.select(met), "met", F.struct("key", "at"), how="inner", large=True)
    found = found.select("doc_id", "key", "width", "at", "hash")
    if counted and not together:
        found = found.unionByName(scan.select("doc_id", "key", F.lit(0).alias("width"), (F.size("w") + 1).alias("at"), F.lit(0).cast("long").alias("hash")))
    return found


def _verified(docs: DataFrame, grams: DataFrame, probed: DataFrame) -> DataFrame:
    """(key, hit, item_ids) for each distinct text with a verified hit: hit is the sorted array of word places (from 1).

    Only texts with a candidate are read again; their windows are compared word by word. Equal texts are one row,
    and a text's places are bounded by its words.
    """
    places = probed.where("width > 0").groupBy("key").agg(F.collect_set(F.struct("at", "width", "hash")).alias("places"))
    places = materialize(places, "candidates")
    n = places.agg(F.sum(F.size("places"))).first()[0] or 0
    texts = docs.select(text_key(F.col("text")).alias("key"), "text", *([F.col("doc_id")] if "doc_id" in docs.columns else []))
    wanted = texts.join(F.broadcast(places.select("key")), "key", "left_semi") if n <= BROADCAST_WINDOWS else salted_left_join(texts, places.select("key"), "key", F.col("doc_id") if "doc_id" in docs.columns else F.lit(0), how="left_semi", large=True)
    once = wanted.groupBy("key").agg(F.min("text").alias("text"))  # copies become one before they are shuffled
    own = once.join(F.broadcast(places) if n <= BROADCAST_WINDOWS else places, "key").select("key", "places", words(F.col("text")).alias("w"))
    each = own.select("key", F.explode(F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["width"].alias("width"), p["hash"].alias("hash"), F.slice("w", p["at"], p["width"]).alias("gram")))).alias("p")).select("key", "p.*")
    if grams.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        met = each.join(grams, ["width", "hash", "gram"])
    else:
        window = F.struct("width", "hash", "gram").alias("met")
        met = salted_left_join(each.select("key", "at", "width", window), grams.select(window, "item_ids"), "met", F.struct("key", "at"), how="inner", large=True)
    runs = met.groupBy("key").agg(F.collect_set(F.struct("at", "width")).alias("runs"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    hit = F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["width"] - 1)))
    return runs.select("key", F.array_sort(F.array_distinct(hit)).alias("hit"), F.array_sort("item_ids").alias("item_ids"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_hit, item_ids (sorted as strings).

    Null and empty texts have no words and no hits. Repeated rows each get a row; extra columns are ignored.
    """
    grams = materialize(benchmark_windows(benchmark, window), "windows")
    found = materialize(_probed(docs, grams, counted=True), "probed")
    hits = materialize(_verified(docs, grams, found).select("key", F.size("hit").cast("long").alias("n_hit"), "item_ids"), "hits")
    joined = found.where("width = 0").select("doc_id", "key", (F.col("at") - 1).cast("long").alias("n_words"))
    joined = looked_up(joined, hits, "key", F.col("doc_id"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False) -> DataFrame:
    """docs without what they share with the benchmark; columns as before.

    spans=False drops each document that holds a window. spans=True keeps every document and removes the hit words
    with what follows them up to the next word. Rows are otherwise unchanged, null texts included.
    """
    grams = materialize(benchmark_windows(benchmark, window), "windows")
    texts = docs.select(F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"), "text")
    found = materialize(_verified(texts, grams, materialize(_probed(texts, grams, counted=False), "probed")), "hits")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col("text")).alias("key"))
    beside = [F.col("row")[c] for c in docs.columns if c != "text"]
    spread = F.xxhash64(*beside) if beside else F.lit(0)
    if not spans:
        return looked_up(rows, found.select("key"), "key", spread, "left_anti").select("row.*")
    joined, text = salted_left_join(rows, found.select("key", "hit"), "key", spread), F.col("row.text")
    own, gaps = F.regexp_extract_all(text, F.lit(CASED_WORD), F.lit(0)), F.split(text, CASED_WORD, -1)
    # one flag for each word up to the last that is hit, from the places in their order
    hit = F.flatten(F.transform("hit", lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get("hit", i - 1), F.lit(0)) - 1), F.array(F.lit(True)))))
    each = F.zip_with(own, F.slice(gaps, F.lit(2), F.size(own)), lambda w, gap: F.concat(w, gap))
    left = F.zip_with(each, hit, lambda w, gone: F.when(F.coalesce(gone, F.lit(False)), F.lit("")).otherwise(w))
    cut = F.when(F.col("hit").isNull(), text).otherwise(F.concat(F.get(gaps, F.lit(0)), F.array_join(left, "")))
    return joined.select(*[cut.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT r, item, i, p.k FROM p JOIN g ON p.gram = g.gram AND p.k = g.k),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
