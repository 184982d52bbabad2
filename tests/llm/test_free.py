"""SimHash, cover trees, WARC, BPE and the classifiers: against brute force, the reference library or held-out labels."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import struct
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebook.llm import bpe, common, components, covertree, quality, simhash, toxicity, warc

# --- SimHash --------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    root = list(range(len(ids)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(ids))]


def brute_long(text):
    """Three words of bits over the distinct five-word shingles; later words from mixed hashes."""
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return [0, 0, 0]
    h = {xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, len(w) - 4))}
    out, full = [], 2**64 - 1
    for word in range(3):
        own = []
        for x in h:
            if word:
                x = x + word * 0x9E3779B97F4A7C15 & full
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
                x = (x ^ x >> 27) * 0x94D049BB133111EB & full
                x ^= x >> 31
            own.append(x)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own)))
    return out


def brute_linked(a, b):
    """At most 33 of 192 bits differ, and some word agrees in two of seven bands."""
    xor, edges = [x ^ y for x, y in zip(a, b)], [64 * i // 7 for i in range(8)]
    agreed = lambda x: sum(not x >> s & (1 << e - s) - 1 for s, e in zip(edges, edges[1:]))
    return sum(x.bit_count() for x in xor) <= 33 and any(agreed(x) >= 2 for x in xor)


def test_simhash_is_exact(spark, docs):
    rnd = random.Random(3)
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    own += [(10_000 + i, re.sub(r"\b\w", lambda m: m[0] if rnd.random() < 0.995 else "q", t)) for i, t in own[:60]]
    own += [(20_000, ""), (20_001, None), (20_002, "\x1c"), (20_003, "One two"), (20_004, "one TWO")]
    df = spark.createDataFrame(own, "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for _, t in own]
    assert all(got[i]["fp"] & (2**64 - 1) == f for (i, _), f in zip(own, fps))
    want = brute_components([i for i, _ in own], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert [got[i]["component_id"] for i, _ in own] == want and len(set(want)) < len(own) - 5


@pytest.mark.parametrize("radius", [2, 4])
@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 2])
def test_no_link_is_lost_between_fingerprints(spark, hot, radius):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:100]:
        for n in (1, 2, 3, 4, 5):
            g = f
            for b in rnd.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    base = rnd.getrandbits(32)
    fps |= {base << 32 | rnd.getrandbits(12) for _ in range(300)}
    fps = sorted(fps)
    signed = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = [(r["src"] & (2**64 - 1), r["dst"] & (2**64 - 1)) for r in simhash.fingerprint_links(signed, hot, radius).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in links)
    at, root = {f: i for i, f in enumerate(fps)}, list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        root[find(at[a])] = find(at[b])
    want = brute_components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= radius)
    classes = lambda xs: sorted(sorted(i for i in range(len(xs)) if xs[i] == x) for x in set(xs))
    assert classes([find(i) for i in range(len(fps))]) == classes(want)


def test_keep_one(spark, docs, odd, nothing):
    rnd = random.Random(9)
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for rate in (0.01, 0.03, 0.05, 0.2):
        own += [(10_000 + len(own) + i, re.sub(r"\w+", lambda m: m[0] if rnd.random() > rate / 5 else "edited", t)) for i, t in own[:40]]
    left = simhash.keep_one(spark.createDataFrame(own, "doc_id long, text string"))
    marks = [brute_long(t) for _, t in own]
    assert marks == [simhash.long_fingerprint(t) for _, t in own]
    want = set(brute_components([i for i, _ in own], lambda a, b: brute_linked(marks[a], marks[b])))
    got = [r["doc_id"] for r in left.collect()]
    assert left.columns == ["doc_id", "text"] and sorted(got) == sorted(want) and len(got) < len(own) - 60
    few = simhash.keep_one(odd)
    assert few.columns == odd.columns and simhash.keep_one(nothing).count() == 0
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in few.collect())
    # 1, 2, 8 and the null row without text are one group; 3 and 4 are one; both texts of 5 stay, and the null id with a text
    assert ids == [(False, 1), (False, 3), (False, 5), (False, 5), (False, 6), (False, 7), (False, 9), (True, 0)]
    assert simhash.near_duplicates(odd).count() == 13


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 40])
def test_no_link_is_lost_between_long_fingerprints(spark, hot):
    """Families of every size around few centres, so that buckets are single, small, large and dealt in parts."""
    rnd, fps = random.Random(6), set()
    for size in (1, 2, 3, 5, 9, 20, 70, 150):
        centre = [rnd.getrandbits(64) for _ in range(3)]
        for _ in range(size):
            own = list(centre)
            for b in rnd.sample(range(192), rnd.choice([4, 12, 20, 30])):
                own[b // 64] ^= 1 << b % 64
            fps.add(tuple(own))
    fps = sorted(fps)
    rows = [(i, tuple(map(simhash._signed, f))) for i, f in enumerate(fps)]
    links = [(r["src"], r["dst"]) for r in simhash.long_links(spark.createDataFrame(rows, "node long, fp struct<w0:long,w1:long,w2:long>"), hot).collect()]
    assert all(brute_linked(fps[a], fps[b]) or sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b])) <= 33 for a, b in links)
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(fps))] == brute_components(list(range(len(fps))), lambda a, b: brute_linked(fps[a], fps[b]))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (3, 2), (2, 3)]
    df = spark.createDataFrame(edges + [(None, 4)], "src long, dst long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [7, *range(200, 400)]} == {7} and got[3] == got[2] == 2 and 5 not in got


# --- cover trees ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [covertree.BLOCK, 40])
def test_cover_trees_are_exact(spark, block, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 260)] + rng.normal(size=(260, 8)) * 0.25
    x = np.concatenate([x, x[:20] * 3, x[:5], x[:5]]).astype(np.float32)  # scaled copies and equal ones
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] * 8), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = brute_components(list(range(len(x))), lambda a, b: near[a, b])
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[i].sum() - 1, want[i]), i
    for i in (900, 901, 902, 903, 904, 907):
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    assert (got[905]["n_links"], got[906]["component_id"]) == (1, 905)
    assert covertree.near_duplicates(df.limit(0)).count() == 0
    assert covertree.op6_embedding_dedup(spark, "/root/testdata/sf0.001").columns == ["vec_id", "n_links", "component_id", "kept"]


def test_pivots_of_one_direction_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)  # about 30 pivots, most of them of the hot direction
    rng = np.random.default_rng(4)
    hot, others = rng.normal(size=16), rng.normal(size=(200, 16))
    x = np.concatenate([hot * rng.uniform(0.1, 9, (1000, 1)), others])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    for i in range(len(x)):
        assert got[i]["n_links"] == near[i].sum() - 1, i
    assert {got[i]["component_id"] for i in range(1000)} == {0}


def test_nodes_cover_their_points():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.build(x)
    for centre, low, high, radius in tree.levels:
        assert low[0] == 0 and high[-1] == 300 and (low[1:] == high[:-1]).all()
        for c, a, b, r in zip(centre, low, high, radius):
            assert np.linalg.norm(tree.points[a:b] - tree.points[c], axis=1).max() <= r + 1e-9
    for (c, *_), (d, *_) in zip(tree.levels, tree.levels[1:]):
        assert set(c) <= set(d)  # nested
    assert (tree.points == x[tree.order]).all()


def test_centres_lie_apart_over_a_whole_level():
    rng = np.random.default_rng(3)
    tight = rng.normal(size=(8, 6))
    x = np.concatenate([tight[rng.integers(0, 8, 400)] + rng.normal(size=(400, 6)) * 0.1, rng.normal(size=(200, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, radius = covertree.covers(x), covertree.TOP_RADIUS
    assert len(found) > 3
    for cover in found:
        centres = np.unique(cover)
        assert (cover[centres] == centres).all() and (np.linalg.norm(x - x[cover], axis=1) <= radius + 1e-3).all()
        apart = np.linalg.norm(x[centres][:, None] - x[centres], axis=2) + 9 * np.eye(len(centres))
        assert apart.min() > radius - 1e-3
        radius /= 2


@pytest.mark.parametrize("block", [covertree.BLOCK, 60])
def test_links_beside_the_threshold(spark, block, monkeypatch):
    """Pairs planted with cosines from 0.949 to 0.951: those of 0.95 or more are linked, no other; clashing columns do not matter."""
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for i, cosine in enumerate(np.linspace(0.949, 0.951, 101)):
        u, v = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        other = cosine * u + np.sqrt(1 - cosine**2) * v
        rows += [(2 * i, (u * 3).tolist(), 1), (2 * i + 1, other.tolist(), 1)]
        real = float(u @ other) / float(np.linalg.norm(u) * np.linalg.norm(other))
        if abs(real - 0.95) > 1e-12:
            want[2 * i] = want[2 * i + 1] = (int(real >= 0.95), 2 * i)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    for c in ("vk", "unit", "weight", "root", "n", "low", "first", "n_links", "component_id", "square"):
        df = df.withColumn(c, df["key"])
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df).collect()}
    assert len(got) == 202
    for i, (n, root) in want.items():
        assert (got[i]["n_links"], got[i]["component_id"]) == (n, root if n else i), i


def shuffled_rows(spark) -> dict[int, int]:
    """Rows that each stage so far wrote for a shuffle."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(10_000)
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_vectors_travel_once_whatever_the_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 10)  # some 60 blocks, and each point lies within reach of all of them
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x[200:300] = x[:100] + rng.normal(size=(100, 64)) * 0.2  # cosines beside 0.98
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = shuffled_rows(spark)
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = brute_components(list(range(len(x))), lambda a, b: near[a, b])
    assert near.sum() > 500 and all((got[i]["n_links"], got[i]["component_id"]) == (near[i].sum() - 1, want[i]) for i in range(len(x)))
    assert sum(n for stage, n in shuffled_rows(spark).items() if stage not in before) < 30 * len(x)


def test_node_pairs_are_opened_in_bounded_memory():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 256)).repeat(40, 0) + rng.normal(size=(1600, 256)) * 0.25  # many nodes that are near each other
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.build(x)
    weight = np.ones(len(x), np.int64)
    tracemalloc.start()
    links = covertree.traverse(tree, tree, (weight, weight), 0.5, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links.count[: len(x)] == (tree.points @ tree.points.T >= 0.5).sum(1)).all()
    assert most < 400 << 20


# --- WARC -----------------------------------------------------------------------------------------------------


def test_archives_give_back_what_was_written(spark):
    rows = [(5, "http://a", "<p>x</p>"), (3, "http://b c", "<p>x</p>"), (9, None, None), (8, "u", ""), (7, "v", "é" * 50_000), (None, "w", "<p>x</p>"), (6, "z", "solo"), (5, "http://a", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("sha1", F.lit(2)).withColumn("first", F.lit(3))
    found, folder = warc.archive(df)
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found.collect()), key=str)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    x = digest("<p>x</p>")
    want = [(False, 3, "response", None, 8, x), (False, 5, "revisit", 3, 8, x), (False, 5, "revisit", 3, 8, x), (True, 0, "response", None, 8, x), (False, 6, "response", None, 4, digest("solo")), (False, 7, "response", None, 100_000, digest("é" * 50_000)), (False, 8, "response", None, 0, digest("")), (False, 9, "revisit", 8, 0, digest(""))]
    assert got == sorted(want, key=str)
    kept, _ = warc.archive(df, least=9)
    assert {r["record_type"] for r in kept.collect()} == {"response"}
    assert warc.archive(df.limit(0))[0].count() == 0


def archive(records, dictionary=b"", compressed=False):
    sink = io.BytesIO()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    warc.write_archive(sink, zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary, iter(records), packer)
    return sink.getvalue()


def test_reader_takes_the_dictionary_and_refuses_broken_archives():
    payload = b"body"
    r = warc.record("response", 1, "u", warc.digest_of(payload), payload, None)
    words = zstandard.train_dictionary(2048, [(f"sample {i} of some words " * 20).encode() for i in range(400)]).as_bytes()
    for d, c in ((b"", False), (words, False), (words, True)):
        data = archive([r, r, r], d, c)
        assert [x["block"] for x in warc.read_archive(io.BytesIO(data))] == [payload] * 3
    data = archive([r, r], words)
    for broken in (data[:-3], data[:4], b"\0" * 8 + data[8:], data[:8] + data[9:], struct.pack("<II", warc.DICTIONARY_MAGIC, 10**6) + data[8:]):
        with pytest.raises((warc.ArchiveError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(broken)))
    for bad in (r[:-1], r.replace(b"WARC/1.1", b"HTTP/1.1"), r.replace(b"Content-Length: 4", b"Content-Length: 5"), r.replace(b"WARC-Type", b"X-Type")):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(archive([bad]))))


# --- BPE ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.vocabulary_path())


def test_encoding_equals_the_library(spark, docs, odd, vocabulary):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rnd = random.Random(1)
    own = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + i, "".join(rnd.choice(" \t\n\r\x0b\x1c\x85\xa0　'stre!9éß日🙂aA½") for _ in range(rnd.randint(0, 80)))) for i in range(300)]
    own += [(20_000, "x<|endoftext|>y <|endoftext|>"), (20_001, ""), (20_002, None), (20_003, "a" * 9_000), (20_004, "!?" * 3_000 + " " * 500)]
    df = spark.createDataFrame(own, "doc_id long, text string")
    for most in (bpe.LEXICON_WORDS, 50):
        got = {r["doc_id"]: r for r in bpe.encoded(df, most=most).collect()}
        for i, t in own:
            e = library.encode(t or "", add_special_tokens=False)
            assert got[i]["ids"] == e.ids and got[i]["n_tokens"] == len(e.ids) and got[i]["decoded"] == library.decode(e.ids, skip_special_tokens=False) == (t or ""), i
    assert bpe.encoded(odd).count() == 13 and bpe.encoded(odd.limit(0)).count() == 0


def test_the_pipeline_hands_back_checked_ids(spark, odd, monkeypatch):
    import corpus_pipeline

    library = Tokenizer.from_file(bpe.vocabulary_path())
    rows = odd.select("doc_id", "text")
    want = sorted(str(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows.collect())
    got = corpus_pipeline.tokens(spark, rows, "").collect()
    assert sorted(str(r["ids"]) for r in got) == want and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in got)


def test_transducer_is_minimal_and_exact(vocabulary):
    words = sorted({w.encode() for w in "the then there these thin thing things sing sings singing wing wings é été".split()})
    entries = {w: vocabulary.merge(w) for w in words}
    t = bpe.Transducer(bpe.Transducer.compiled(words, entries.get))
    assert t.numbers(words).tolist() == list(range(len(words)))
    assert all(t.ids[t.first[i] : t.first[i + 1]].tolist() == entries[w] for i, w in enumerate(words))
    assert set(t.numbers([b"", b"th", b"thingss", b"x", b"\xc3", b"the\0"]).tolist()) == {-1}
    arcs, final = bpe.minimal_automaton(words)
    assert len({(f, a) for a, f in zip(arcs, final)}) == len(arcs)  # no two states are alike
    assert bpe.Transducer(bpe.Transducer.compiled([], entries.get)).numbers([b"a"]).tolist() == [-1]


def test_long_pieces_merge_alike(vocabulary):
    rnd = random.Random(2)
    for _ in range(200):
        piece = "".join(rnd.choice("aehinrst") for _ in range(rnd.randint(1, 64))).encode()
        assert vocabulary.merge(piece) == vocabulary._merge_long([vocabulary.byte_id[b] for b in piece])


# --- classifiers ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def held(spark, larger, found, column):
    docs, labels = larger
    rows = found.join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).select("score", column).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_quality_on_held_out_rows(spark, larger, odd, nothing):
    docs, labels = larger
    machine = quality.learn(docs, labels)
    p, y = held(spark, larger, quality.scored(docs, machine), "quality")
    assert ((p >= 0.5) == y).mean() > 0.95
    got = quality.scored(odd, machine).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got) and quality.scored(nothing, machine).count() == 0
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.95
    clash = quality.good(odd, labels.limit(0))  # nothing to learn from: all stay
    assert clash.columns == odd.columns and sorted(map(str, clash.collect())) == sorted(map(str, odd.collect()))


def test_commonest_word_is_counted_over_the_whole_text():
    at = quality.STATISTICS.index("commonest_word")
    words = [f"w{i}" for i in range(800)]
    for i in range(0, 800, 4):
        words[i + 1] = "often"  # never at a multiple of 100
    assert quality.statistics(" ".join(words))[0][at] == 200 / 800 and quality.statistics("")[0][at] == 0


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    size = quality.BUCKETS + 400
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), np.zeros(14), np.ones(14), np.zeros((14, 9)))
    at, x = rng.choice(size, 12, replace=False), rng.normal(size=12)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert abs(m.margin(at, x) - (0.3 + m.linear[at] @ x + pairs)) < 1e-9


def test_held_out_labels_are_never_learned(spark, larger):
    docs, labels = larger
    for target in ("quality", "toxic"):
        sample = common.sampled_labels(docs, labels, target, 50)
        assert sample.where(common.held_out(F.col("doc_id"))).count() == 0 and 0 < sample.count() < 120


def test_toxicity_on_held_out_rows(spark, larger, odd, nothing):
    docs, labels = larger
    lexicon = toxicity.learn(docs, labels)
    p, y = held(spark, larger, toxicity.scored(docs, lexicon), "toxic")
    flagged = p >= toxicity.THRESHOLD
    assert (flagged & (y == 0)).sum() <= 0.03 * (y == 0).sum() and (flagged & (y == 1)).sum() >= 0.5 * y.sum()
    got = toxicity.scored(odd, lexicon).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got) and toxicity.scored(nothing, lexicon).count() == 0
    empty = toxicity.learn(docs, labels.limit(0))
    assert empty.coefficients == toxicity.UNFITTED
    texts = [(1, "you 1d1ot and m0r0n, you stupid clown"), (2, "uоu iԁiоt you mоron you wоrthless"), (3, "s.t.u.p.i.d i-d-i-o-t stuuuupid"), (4, "a walk in the park on a sunny day"), (5, "put it in the trash can, said the class clown")]
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(texts, "doc_id long, text string"), lexicon).collect()}
    assert min(score[1], score[2], score[3]) >= 0.7 > max(score[4], score[5])


def test_folding():
    assert toxicity.fold("1D10T $tupid c1own")[0].split() == ["idiot", "ldlot", "stupid", "ciown", "clown"]
    assert toxicity.fold("i​diot ｉｄｉｏｔ мoron 2024 word$$$ THE!!")[0].split() == ["idiot", "idiot", "moron", "2024", "word", "the"]
    assert toxicity.fold("") == ("  ", 1)


def test_parquet_of_the_driver_is_as_described():
    assert pq.read_schema("/root/testdata/sf0.001/documents.parquet").names[:2] == ["doc_id", "text"]


def test_every_code_point_is_split_as_the_library_does():
    """Characters that the two Unicode tables class differently, next to letters, digits, marks and blanks."""
    import sys

    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    own = bpe.Encoder(bpe.Vocabulary(path), bpe.Transducer(bpe.Transducer.compiled([], lambda _: [])), bpe.newer_characters())
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    pre = library.pre_tokenizer
    spell = {b: c for c, b in bpe._byte_letters().items()}
    for at in range(0, len(chars), 4096):
        text = "".join(f"a{c}1{c}{c}b " for c in chars[at : at + 4096])
        want = [p for p, _ in pre.pre_tokenize_str(text)]
        got = ["".join(spell[b] for b in p.encode()) for p in own.pieces_of(text)]
        assert got == want, hex(at)


def test_texts_with_newer_characters_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path, rng = bpe.vocabulary_path(), random.Random(5)
    library = Tokenizer.from_file(path)
    own = bpe.Encoder(bpe.Vocabulary(path), bpe.Transducer(bpe.Transducer.compiled([], lambda _: [])), bpe.newer_characters())
    odd = ["\U00016EA0", "\u0558", "a", " ", "!", "1", "é", "日", "'s", "\n", "<|endoftext|>", " the"]
    texts = ["".join(rng.choices(odd, k=rng.randrange(1, 9))) for _ in range(3000)]
    for _ in range(2):  # what is remembered from the first time does not change the second
        for chunk in (texts[i : i + 7] for i in range(0, len(texts), 7)):
            for t, (ids, _) in zip(chunk, own.encode(chunk)):
                assert ids == ",".join(map(str, library.encode(t, add_special_tokens=False).ids)), ascii(t)


def test_stars_join_what_links_join():
    rng = random.Random(9)
    for n in (0, 1, 30, 400):
        pairs = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(n)]
        src, dst = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        a, b = simhash._stars(src, dst)
        root = {x: x for p in pairs for x in p}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            low, high = sorted((find(x), find(y)))
            root[high] = low
        assert sorted(zip(a.tolist(), b.tolist())) == sorted((find(x), x) for x in root if find(x) != x)
