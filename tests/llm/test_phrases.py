"""Phrase collocations against a plain count of every run of words, on both sides of each switch, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import common, components, phrases

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, percent=80, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        own = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in own.items():
            if any(100 * b >= percent * a for h, b in own.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))):
                continue
            score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["a", "b", "the", "THE", "of", "naïve", "日本", "x", "q.", "r,", "z\n", "é é", "-", " "]
    texts = [(rng.choice(["en", "fr", None]), " ".join(rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 3, 2, 2, 2, 1, 1, 1], k=rng.randrange(60)))) for _ in range(150)]
    return [*texts, ("en", None), ("fr", ""), (None, "the the the the the the"), ("und", "a\ta \t a a"), ("de", " . ,"), *[("de", "one two three four five")] * 6, ("en", "the of " * 3000)]


@pytest.mark.parametrize("held, hot", [(phrases.HELD_WORDS, phrases.HOT_PIVOT), (0, phrases.HOT_PIVOT), (phrases.HELD_WORDS, 20)])
def test_equals_plain_counts(spark, held, hot):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(df, 6, held_words=held, hot_pivot=hot).collect()
    assert sorted(map(tuple, got)) == brute(rows, 6) and len(got) > 100


def test_short_stretches_hold_the_same_fragments(spark):
    df = spark.createDataFrame(corpus(), "lang string, text string")
    words = phrases.ordered_words(phrases.word_counts(df), 6)
    total = lambda made: {tuple(r[c] for c in phrases.FRAGMENT): r["n"] for r in made.groupBy(*phrases.FRAGMENT).agg(F.sum("n").alias("n")).collect()}
    assert total(phrases._joined_fragments(df, words, 5)) == total(phrases._held_fragments(df, words))


def test_small_buffers_lose_nothing(monkeypatch):
    for name, n in (("WORDS_AT_ONCE", 10), ("FRAGMENTS_AT_ONCE", 40), ("ROWS_AT_ONCE", 20)):
        monkeypatch.setattr(phrases, name, n)
    texts = pa.table({"lang": ["en"] * 150, "text": [t for _, t in corpus()[:150]]}).to_batches(7)
    counted = Counter()
    for b in phrases._count_batches(iter(texts)):
        for w, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            counted[w] += f
    assert counted == Counter(w.decode() for _, t in corpus()[:150] for w in phrases.words_of(t) if w != b".")
    ids = np.array([counted[w.decode()] % 7 - 1 for _, t in corpus()[:150] for w in phrases.words_of(t)])
    found, batches = phrases._Fragments(), []
    for part in range(0, len(ids), 11):
        batches += found.add(ids, np.arange(len(ids)) // 11 * 11 == part)
    batches += found.out()
    whole, n = phrases.mined_table(pa.table([*phrases.fragments_of(ids), np.ones(len(phrases.fragments_of(ids)[0]), np.int64)], names=[*phrases.FRAGMENT, "n"])), Counter()
    rows = pa.Table.from_batches(batches).sort_by("p")
    rows = rows.append_column("part", pa.array(np.where(rows.column("p").to_numpy() % 2, -1, rows.column("p").to_numpy())))
    for b in phrases._mine_batches(iter(rows.to_batches(9)), 1):
        for *gram, k in zip(*(c.to_pylist() for c in b.columns)):
            n[tuple(gram)] += k
    assert n == {tuple(g): k for *g, k in zip(*(whole.column(c).to_pylist() for c in [*phrases.PHRASE, "n"]))} and len(n) > 50


def test_fragments_hold_what_the_pivot_owns():
    # ids rise with rarity: around the 5 in 1 2 5 5 3 7 nothing beyond the 7, and only what comes before 5 on its left
    columns = np.stack(phrases.fragments_of(np.array([1, 2, 5, 5, 3, 7, -1, 4])), axis=1).tolist()
    assert [2, 1, -1, 5, 5, 3, -1] in columns and [-1, -1, -1, 5, 3, -1, -1] in columns
    assert [3, 5, 5, 7, -1, -1, -1] in columns and [1, -1, -1, 2, -1, -1, -1] in columns and len(columns) == 4


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(phrases.ORACLE_SQL)
    names = [d[0] for d in found.description]
    got = phrases.op13_phrases(spark, SF)
    assert names == got.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(found.fetchall()) and len(rows) > 10


def test_scores_are_exact_beyond_64_bits(spark):
    big = 5_000_000_000_000_000_000
    words = spark.createDataFrame([(0, big), (1, big - 1)], "id long, f long")
    rows = spark.createDataFrame([(0, 1, -1, -1, big - 3)], "w1 long, w2 long, w3 long, w4 long, n long")
    assert phrases.scored(rows, words).first()["score"] == 2_000_000 * (big - 3) // (2 * big - 1)
    assert phrases.standing(rows.withColumnRenamed("n", "a")).count() == 1


def test_odd_rows(odd, nothing):
    df = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("a", F.lit(1)).withColumn("word", F.lit("x"))
    got = phrases.collocations(df).collect()
    assert {r["lang"] for r in got} == {"und"} and "word word word word" in {r["phrase"] for r in got}
    assert phrases.collocations(df.limit(0)).count() == 0


def test_words_do_not_pass_the_driver(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "lang string, text string")
    words = phrases.ordered_words(phrases.word_counts(df), 6)
    found = lambda made: {tuple(r[c] for c in phrases.FRAGMENT): r["n"] for r in made.groupBy(*phrases.FRAGMENT).agg(F.sum("n").alias("n")).collect()}
    want = found(phrases._joined_fragments(df, words))
    monkeypatch.setattr(phrases, "KNOWN_WORDS", 3)  # forgotten after each batch
    monkeypatch.setattr(phrases, "FILE_WORDS", 4)
    for way in ("toArrow", "collect", "toPandas"):
        monkeypatch.setattr(type(df), way, lambda self: 1 / 0)
    made = phrases._held_fragments(df, words)
    monkeypatch.undo()
    assert found(made) == want and len(want) > 50


def test_ids_are_found_by_both_hashes(spark, tmp_path):
    pairs = [("en", "the"), ("en", ""), ("und", "日本"), ("de", "naïve" * 20), ("", "x")]
    rows = spark.createDataFrame(pairs, "lang string, word string").select(F.xxhash64("lang", "word").alias("a"), F.xxhash64("word", "lang").alias("b")).collect()
    assert [tuple(r) for r in rows] == [(phrases._hash(x, y), phrases._hash(y, x)) for x, y in ((a.encode(), b.encode()) for a, b in pairs)]
    a, b = (list(x) for x in zip(*rows))
    pq.write_table(pa.table({"a": [*a, a[0], a[0]], "b": [*b, b[0] + 1, b[0] - 1], "id": range(7)}), tmp_path / "ids.parquet")  # one hash of three words
    ids = phrases._Ids([str(tmp_path / "ids.parquet")])
    assert [ids.find(x.encode(), y.encode()) for x, y in pairs] == [0, 1, 2, 3, 4] and ids.find(b"fr", b"the") == -1
    assert phrases._Ids([]).find(b"en", b"the") == -1


def joins(df: DataFrame) -> set[str]:
    return set(re.findall(r"\w+Join\b", df._jdf.queryExecution().executedPlan().toString()))


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Spark takes copies of rows, and rows from files of numbers, for as small as the files."""
    rows = common.materialize(spark.range(2000).select(F.col("id").alias("key"), F.lit("word").alias("word")), "many")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    assert joins(common.looked_up(rows.select("key"), rows, "key", F.col("key"))) == {"SortMergeJoin"}
    edges = common.materialize(spark.range(2000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "edges")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    assert joins(components._with_least(edges, least, large=True)) == {"SortMergeJoin"}
    words = common.materialize(spark.range(9).select("id", F.lit(50).cast("long").alias("f")), "words")
    found = common.materialize(spark.range(8).select(F.col("id").alias("w1"), (F.col("id") + 1).alias("w2"), F.lit(-1).cast("long").alias("w3"), F.lit(-1).cast("long").alias("w4"), F.lit(40).cast("long").alias("n")), "phrases")
    kept = phrases.standing(phrases.scored(found, words))
    assert joins(kept) == {"SortMergeJoin"} and kept.count() == 8
    monkeypatch.setattr(components, "BROADCAST_ROWS", 1)
    assert {r["root"] for r in components.connected_components(spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))).collect()} == {0}
