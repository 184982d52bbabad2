from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, one id with two texts, and columns whose names clash."""
    rows = [
        (1, "", 0), (2, None, 0), (None, "a null id and some words", 1), (None, None, 1), (3, "same text here", 2), (3, "same text here", 2), (4, "same text here", 2),
        (5, "one id two texts, mail a.b@mail.example.com now", 3), (5, "another text of this id 4026083977531332 yes", 3), (6, "x" * 70_000, 4), (7, "word " * 30_000, 5), (8, " \t\n ", 6), (9, "naïve ÉCOLE 日本 🙂 end", 7),
    ]
    clash = ["key", "row", "fp", "n", "found", "score", "count", "label", "slot", "_key", "n_entities", "kinds", "component_id"]
    df = spark.createDataFrame([(i, t, k) for i, t, k in rows], "doc_id long, text string, k int")
    for c in clash:
        df = df.withColumn(c, df["k"])
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
