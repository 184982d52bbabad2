"""Nearest neighbours against brute force: the radius search exactly, the whole operator by its recall, and odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebook.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, k=20, step=20):
    """query_id -> [(score, vec_id)] of rows (vec_id, vector), all sound and of one length."""
    names, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(names % step == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((names, -np.round(score, 12))) if names[j] != names[i]][:k]
        out[int(names[i])] = [(score[j], int(names[j])) for j in order]
    return out


def held(got, want, k=20):
    """Recall; checks form, order and scores on the way."""
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert by.keys() == {q for q, w in want.items() if w}
    hits = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(rows, rows[1:])) and q not in {r["vec_id"] for r in rows}
        least = want[q][-1][0] - 1e-9
        hits, total = hits + sum(r["score"] >= least for r in rows), total + len(rows)
    return hits / total


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = ann.op11_ann(spark, SF).collect()
    assert held(got, want) >= 0.95
    scores = {(q, v): s for q, w in want.items() for s, v in w}
    assert all(abs(r["score"] - scores[r["query_id"], r["vec_id"]]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in scores)


@pytest.mark.parametrize("dims", [3, 20, 150])
def test_recall_on_clusters_of_any_norm(spark, dims):
    rng = np.random.default_rng(dims)
    centre = rng.normal(size=(12, dims))
    x = np.concatenate([centre[rng.integers(12, size=1500)] + 0.2 * rng.normal(size=(1500, dims)), rng.normal(size=(500, dims))]) * rng.uniform(0.5, 2, size=(2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert held(got, brute(rows)) >= 0.93


def test_many_copies_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)  # slices of many bits, hot slices in parts, queries in chunks
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 16)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 8)), 3)
    x[300:650] = x[0]
    rows = [(i * 10, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows + rows[:100], "vec_id long, embedding array<float>").withColumn("vk", F.lit(1)).withColumn("key", F.lit(2)).withColumn("ids", F.lit(3))).collect()
    f32 = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert held(got, brute(f32)) >= 0.93
    copies = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 3000), key=lambda r: r["rank"])]
    better = {w[1] for w in brute(f32)[3000]}
    assert set(copies) == better


@pytest.mark.parametrize("radius", [0, 7, 8, 40, 70, 128])
def test_every_code_within_the_radius_is_found_once(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 63, size=(400, 2), dtype=np.int64)
    codes[100:200] = codes[:100] ^ (np.int64(1) << rng.integers(0, 62, size=(100, 2)))
    vectors = rng.normal(size=(400, 5))
    points = pa.table({"c0": codes[:, 0], "c1": codes[:, 1], "vec": list(vectors), "ids": [[i] for i in range(400)]})
    asked = points.slice(0, 50)
    found = []
    for j in range(ann.SUBSTRINGS):
        q, own, _ = ann.probed(points, asked, j, radius, 1000)
        found += zip(q.tolist(), own.tolist())
    far = np.bitwise_count(codes[:50, None].view(np.uint64) ^ codes[None].view(np.uint64)).sum(2)
    assert sorted(found) == [tuple(p) for p in np.argwhere(far <= radius).tolist()]


def test_queries_that_find_too_few_ask_again(spark, monkeypatch):
    monkeypatch.setattr(ann, "_learned_radius", lambda *_: 0)
    x = np.random.default_rng(2).normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute(rows)
    assert len(got) == sum(map(len, want.values()))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0]), (140, []), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (160, [1.0, 2.0, 3.0]), (2, [-1.0, -1.0]), (3, [5.0, 0.0]), (3, [4.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("found", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).collect())
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 3), (0, 2, 1), (0, 3, 20), (0, 4, 2)] and got[0][3] in (4.0, 5.0)
    assert [g for g in got if g[0] == 20] == [(20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 3, 0.0), (20, 4, 2, -2.0)] and len(got) == 8
    assert ann.nearest(df.limit(0)).collect() == [] and ann.nearest(df.where("vec_id = 1")).collect() == []
