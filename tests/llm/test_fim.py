"""Fill-in-middle: run-length cuts against listed units, round trips, SQL and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebook.llm import fim

SF = "/root/testdata/sf0.001"
PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s:.)", "word": r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$"}


@pytest.mark.parametrize("unit", PATTERNS)
def test_cuts_lie_where_listed_units_end(unit):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "é", "🙂", "\n", "\n\n", " ", "\t", "xyz"]) for _ in range(rng.randrange(30)))
        units, found = re.findall(PATTERNS[unit], text), fim.runs(text, unit)
        assert found.total == len(units) and "".join(units) == text
        assert [found.offset(c) for c in range(len(units) + 1)] == [len("".join(units[:c])) for c in range(len(units) + 1)]


def test_few_runs_hold_many_units():
    found = fim.runs("\n" * 1_000_000 + "x" * 1_000_000)
    assert len(found.start) == 2 and found.total == 1_000_001 and found.offset(777_777) == 777_777 and found.offset(1_000_001) == 2_000_000


def brute(doc_id, text):
    d = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(PATTERNS["line"], text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_equals_brute_force_and_gives_texts_back(spark, docs):
    more = spark.createDataFrame([(9_001, "a <P> mark"), (9_002, "<<\n<\nP>\n>S<\n"), (9_003, "\n"), (9_004, "no feed"), (9_005, "\r\n\x00\n x\n"), (9_006, "<S\n>\n<M\n<"), (9_007, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    made = fim.transformed(rows).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    got = made.collect()
    assert len(got) == len(texts) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], texts[r["doc_id"]])
        assert r["back"] == texts[r["doc_id"]]


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(fim.ORACLE_SQL)
    names = [d[0] for d in found.description]
    got = fim.op12_fim(spark, SF)
    assert names == got.columns and sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_rates_and_units(docs):
    forms = {r["form"] for r in fim.transformed(docs, rate=0).collect()}
    assert forms == {"plain"}
    made = fim.transformed(docs, unit="word", rate=50, spm=0, marks=("<|p|>", "<|s|>", "<|m|>")).withColumn("back", fim.restored(F.col("output"), F.col("form"), ("<|p|>", "<|s|>", "<|m|>")))
    rows = made.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").collect()
    assert {r["form"] for r in rows} == {"plain", "psm"} and all(r["back"] == r["text"] for r in rows)


def test_odd_rows(odd, nothing):
    got = fim.transformed(odd).collect()
    assert len(got) == odd.count() and {(r["n"], r["form"], r["output"]) for r in got if r["doc_id"] in (1, 2)} == {(0, "plain", "")}
    assert sum(r["doc_id"] is None for r in got) == 2 and fim.transformed(nothing).count() == 0
