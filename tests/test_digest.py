"""Hash trees: roots tell streams apart, the descent names the first line, and no group is longer than a leaf."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import digest


def lines(spark, rows):
    df = spark.createDataFrame(rows, "date string, hour int, line int, text string").withColumn("date", F.to_date("date"))
    return df.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))


def stream(n=3000, seed=1):
    rng = random.Random(seed)
    return [(f"2026-0{rng.randrange(1, 4)}-{rng.randrange(10, 28)}", rng.randrange(24), i, f"line {i}") for i in range(1, n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(digest, "LEAF", 8)
    monkeypatch.setattr(digest, "FAN", 8)


def test_the_root_is_that_of_nested_hashes(spark, small):
    rows = stream(400)
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    nodes = {}
    for d, h, i, t in sorted(rows):
        nodes.setdefault((d, h, i // 8), []).append(hashlib.sha256(t.encode()).hexdigest())
    now = {k: sha(v) for k, v in nodes.items()}
    for _ in range(digest.TIERS):
        up = {}
        for (d, h, n), v in sorted(now.items()):
            up.setdefault((d, h, n // 8), []).append(v)
        now = {k: sha(v) for k, v in up.items()}
    days = {}
    for (d, h, _), v in sorted(now.items()):
        days.setdefault(d, []).append(v)
    from datetime import date

    now = {(date.fromisoformat(d) - date(1970, 1, 1)).days: sha(v) for d, v in days.items()}
    for _ in range(digest.TIERS):
        up = {}
        for n, v in sorted(now.items()):
            up.setdefault(n // 8, []).append(v)
        now = {k: sha(v) for k, v in up.items()}
    assert digest.root(lines(spark, rows)).first()[0] == sha(v for _, v in sorted(now.items()))
    assert digest.root(lines(spark, rows).repartition(7)).first()[0] == digest.root(lines(spark, rows)).first()[0]
    assert digest.root(lines(spark, rows[:-1])).first()[0] != digest.root(lines(spark, rows)).first()[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_descent_names_the_first_line_that_differs(spark, small, seed):
    rng, rows = random.Random(seed), stream(600, seed)
    other = list(rows)
    for i in rng.sample(range(len(other)), 3):
        d, h, line, t = other[i]
        other[i] = (d, h, line, t + "!") if rng.random() < 0.5 else None
    other = [r for r in other if r] + [("2026-03-05", 3, 9_999, "only here")]
    first = min({r for r in set(rows) ^ set(other)})[:3]
    got = digest.first_difference(lines(spark, rows), lines(spark, other)).collect()
    assert [(str(r["date"]), r["hour"], r["line"]) for r in got] == [first] and got[0]["left"] != got[0]["right"]


def test_equal_and_empty_streams_have_no_difference(spark):
    rows = lines(spark, stream(200))
    assert digest.first_difference(rows, rows.repartition(3)).count() == 0
    assert digest.first_difference(rows.limit(0), rows.limit(0)).count() == 0
    assert digest.first_difference(rows.limit(0), rows).first()["left"] is None
    assert digest.root(rows.limit(0)).count() == 1


def test_a_hot_hour_is_no_single_group(spark):
    hot = spark.range(50_000).select(F.to_date(F.lit("2026-01-01")).alias("date"), F.lit(1).alias("hour"), F.col("id").cast("int").alias("line"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    assert digest.leaves(hot).agg(F.max("lines")).first()[0] <= digest.LEAF
