"""Operators that SQL cannot express, and the pipeline, against brute-force versions."""

from __future__ import annotations

import random
import re
import time

import brute_pii
import pytest
from pyspark.sql import functions as F
from test_free import brute_components, brute_linked, brute_long
from test_native import words as brute_words

import corpus_pipeline
from tidebook.llm import bpe, common, decontamination, pii, quality, secrets, sharding, toxicity

SF = "/root/testdata/sf0.001"
KEY = "of the tests"


# --- surrogates -----------------------------------------------------------------------------------------------

PEOPLE = [
    "Smith said hi. John Smith left. Mr. John Smith came; SMITH'S dog, JOHN SMITH!", "Mr JOHN SMITH and MR. JOHN SMITH", "Mrs O'Brien met O'Brien; Mr. de Souza, Souza; Frau von der Leyen",
    "Г-н Иванов и Иванов, г-жа Анна Иванова. Κυρία Μαρία Παπαδοπούλου", "at 2001:db8::8a2e:370:7334 and FE80::1, ::1, 12:30:45, 2001:0db8:85a3:0000:0000:8a2e:0370:7334, std::abc",
    "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 ok", "Herr Dr. Müller, Prof. Dr. Anna Weber, Dr. J. R. Tolkien, John Q. Public, Mr. John Q. Public, Dr Müller",
    "a" * 70 + "@mail.example.com x", "Frau Müller and Dr Müller, Herr Müller \u0001 mark Mr. X\u0001 Frau Müller", "Mr John van Dyke saw van Dyke and Dyke", "Mrs O'Brien, O’Brien and O’BRIEN; Mr D’Arcy saw D'Arcy", "2001:db8::1 is 2001:DB8:0:0:0:0:0:1 and 2001:0db8::0:1; ::1, fe80::, 1:2:3:4:5:6:7:8", "call 5551234567 or 555-123-4567, not 1551234567", "7.88.85.226 +1 (504) 555-2652 4111 1111 1111 1111 078-05-1120", None, "", "Mr. ", "Dr Anna Weber and Mr. Anna Weber",
]


def test_surrogates_equal_brute_force(spark, docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()] + PEOPLE
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.replaced(df, KEY).orderBy("doc_id").collect()]
    want = brute_pii.replaced(texts, KEY)
    assert [(g, w) for g, w in zip(got, want) if g != w][:3] == []
    assert sum(t != g for t, g in zip(texts, got)) > 20


def test_no_known_name_stays_in_the_clear(spark):
    df = spark.createDataFrame(list(enumerate(PEOPLE)), "doc_id long, text string")
    whole = " ".join(r["text"] or "" for r in pii.replaced(df, KEY).collect())
    for secret in ("Smith", "SMITH", "Brien", "Souza", "Leyen", "Иванов", "Παπαδοπούλου", "2001:", "8a2e", "3704", "WEST", "Müller", "Weber", "Tolkien", "Public", "aaaa", "Dyke", "555-2652", "078-05"):
        assert secret not in whole, secret
    number = re.search(r"IBAN ([A-Z0-9 ]+) or", whole)[1].replace(" ", "")
    assert number.startswith("DE") and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def test_spellings_of_one_entity_share_a_surrogate(spark):
    rows = ["Mrs O'Brien and O’Brien", "at 2001:db8::1 or 2001:DB8:0:0:0:0:0:1 or 2001:0db8::0:1", "call 5551234567 or 555-123-4567"]
    got = [r["text"] for r in pii.replaced(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    first, second = re.fullmatch(r"Mrs (\w+) and (\w+)", got[0]).groups()
    assert first == second and "Brien" not in got[0]
    import ipaddress

    spellings = re.fullmatch(r"at (\S+) or (\S+) or (\S+)", got[1]).groups()
    assert len({ipaddress.ip_address(x) for x in spellings}) == 1 and "::" in spellings[0] and spellings[1].isupper() and "2001" not in got[1]
    one, other = re.fullmatch(r"call (\d{10}) or ([\d-]{12})", got[2]).groups()
    assert one == other.replace("-", "") != "5551234567"


def test_many_surnames_have_many_surrogates(spark):
    n = 100_000  # more than four parts of a surname tell apart
    name = F.concat(F.lit("Dr B"), *[F.substring(F.lit("aeiou"), F.expr(f"cast(id div {5**k} % 5 as int) + 1"), F.lit(1)) for k in range(8)])
    df = spark.range(n).select(F.col("id").alias("doc_id"), name.alias("text"))
    got = pii.replaced(df, KEY).agg(F.count_distinct("text").alias("n"), F.min(F.col("text").rlike("^Dr [A-Z][a-z]+$")).alias("ok")).first()
    assert got["n"] == n and got["ok"]


# --- toxicity -------------------------------------------------------------------------------------------------


def naive_features(text, lexicon):
    """Every entry and phrase at every place of the folded text."""
    folded, n = toxicity.fold(text)
    phrases = [toxicity.fold(p)[0] for p in lexicon.exceptions]
    inside = {i for p in phrases for at in range(len(folded)) if folded.startswith(p, at) for i in range(at, at + len(p) - 1)}
    hits = []
    for at in range(len(folded)):
        own = [w for e, w in lexicon.weights.items() if folded.startswith(e, at)]
        if own and at not in inside:
            hits.append(max(own))
    strong = [w for w in hits if w >= 4]
    import numpy as np

    return [sum(hits) / (n + 8), len(strong) / (n + 8), np.log1p(len(strong)), max(hits, default=0.0), np.log1p(sum(hits)), np.log1p(n)]


def test_matcher_equals_a_naive_one():
    rng = random.Random(5)
    pool = ["trash", "can", "trash can", "pond scum", "scum", "1d10t", "idi0ts", "i.d.i.o.t", "looooser", "clown fish", "clown", "sore loser", "the", "a", "стupid", "fool", "foolish", "@sshole", "basura orgánica", "b4sura", "​id​iot", "42", "x1"]
    weights = {f" {toxicity.fold(w)[0].strip()} ": 6.0 for w in toxicity.SEEDS} | {" fool": 2.0, " tras": 1.7, " th": 0.5}
    lexicon = toxicity.Lexicon(weights)
    automaton = lexicon.automaton()
    for _ in range(300):
        text = rng.choice([" ", "  ", ", ", "-"]).join(rng.choice(pool) for _ in range(rng.randrange(12)))
        assert toxicity.features(text, automaton) == pytest.approx(naive_features(text, lexicon)), text


@pytest.mark.parametrize("text", ["".join(chr(97 + i * i % 23) for i in range(1_000_000)), "".join(chr(0x4E00 + i * 7 % 5000) for i in range(1_000_000)), "trash can " * 100_000, "1a" * 500_000, "a.b.c.d.e.fg " * 50_000], ids=["letters", "cjk", "phrases", "digits", "spelled"])
def test_toxicity_is_linear_in_the_text(text):
    automaton = toxicity.Lexicon({f" {w} ": 6.0 for w in ("scum", "trash")}).automaton()
    start = time.time()
    toxicity.features(text, automaton)
    assert time.time() - start < 2


# --- shards ---------------------------------------------------------------------------------------------------


def test_shards_equal_a_greedy_deal(docs):
    rows = [r for r in sharding.shard(docs).collect()]
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 16 for r in docs.collect()}
    import zlib

    crc = {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in docs.collect()}
    slots = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["text_crc32"] == crc[r["doc_id"]]
        slots[r["virtual_slot"]] = slots.get(r["virtual_slot"], 0) + r["size"]
    loads, owner = [0] * sharding.SHARDS, {}
    for n, slot in sorted(((slots.get(s, 0), s) for s in range(sharding.SLOTS)), reverse=True):
        owner[slot] = loads.index(min(loads))
        loads[owner[slot]] += n
    assert all(r["shard"] == owner[r["virtual_slot"]] for r in rows)


# --- many matches in one text, copies of one text ---------------------------------------------------------------


def test_running_sums(spark):
    rows = [[], [5], [1, 2], list(range(1000))]
    df = spark.createDataFrame([(x,) for x in rows], "x array<int>")
    got = [r[0] for r in df.select(common.running_sums(F.col("x"))).collect()]
    assert got == [[sum(x[: i + 1]) for i in range(len(x))] for x in rows[:3]] + [[i * (i + 1) // 2 for i in range(1000)]]


def test_one_text_of_many_secrets_and_many_entities(spark):
    n = 20_000
    df = spark.createDataFrame([(1, " ".join(f"{i:016x}" for i in range(n))), (2, " ; ".join(f"a{i}@b.de" for i in range(2_000)))], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(df).collect()}
    assert time.time() - start < 30 and [(s["start"], s["end"]) for s in got[1]] == [(17 * i, 17 * i + 16) for i in range(n)] and got[2] == []
    made = pii.replaced(df.where("doc_id = 2"), KEY).first()["text"].split(" ; ")
    assert len(set(made)) == 2_000 and not set(made) & {f"a{i}@b.de" for i in range(2_000)}


@pytest.mark.parametrize("most", [0, 100_000])
def test_copies_of_one_text(spark, most, monkeypatch):
    """A third of all rows, and more, are one text; both ways of looking its findings up give the same."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    text = "one two three four five six seven eight nine ten password = abcdefghijklmnop, Dr Meyer, Meyer"
    df = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, text).otherwise(F.concat(F.lit("clean words number "), F.col("id").cast("string"))).alias("text"))
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten.")], "item_id long, text string")
    assert secrets.secrets(df).where(F.size("spans") == 1).count() == 4_000
    assert decontamination.report(df, bench).where("n_hit = 10").count() == 4_000
    assert decontamination.without_leaks(df, bench).count() == 2_000
    cut = decontamination.without_leaks(df, bench, spans=True)
    assert cut.count() == 6_000 and cut.where(F.col("text") == text[text.index("password") :]).count() == 4_000
    assert pii.replaced(df, KEY).where(F.col("text").contains("Meyer")).count() == 0


# --- lexicon of the tokenizer -----------------------------------------------------------------------------------


def test_frequent_pieces_are_the_most_frequent(spark):
    counts = {f"w{chr(97 + i % 26)}{chr(97 + i // 26)}": 1 + i * i for i in range(60)}
    df = spark.createDataFrame([(i, f" {w}" * n) for i, (w, n) in enumerate(counts.items())], "doc_id long, text string")
    for most in (0, 1, 10, 58, 60):
        got = bpe.frequent_pieces(df, most)
        assert len(got) == min(most, 59)
        assert set(got) == {f" {w}" for w, _ in sorted(counts.items(), key=lambda x: -x[1])[: len(got)]}


# --- the pipeline -----------------------------------------------------------------------------------------------


def brute_pipeline(spark, docs, labels, items):
    """doc_id -> ids of the documents that are left."""
    import public_tokenizers
    from tokenizers import Tokenizer

    machine = quality.learn(docs, labels)
    rows = [r for r in docs.collect() if machine.score(r["text"] or "") >= quality.THRESHOLD]
    marks = [brute_long(r["text"]) for r in rows]
    root = brute_components(range(len(rows)), lambda a, b: brute_linked(marks[a], marks[b]))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i], []).append(r)
    least = lambda own: min(own, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    rows = [least(own) for own in groups.values()]
    grams = {}
    for r in items:
        w = brute_words(r["text"])
        k = min(len(w), 10)
        grams.setdefault(k, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k)
    dirty = lambda w: any(tuple(w[i : i + k]) in own for k, own in grams.items() if k for i in range(len(w) - k + 1))
    rows = [r for r in rows if not dirty(brute_words(r["text"]))]
    texts = brute_pii.replaced([r["text"] for r in rows], pii.query_key(spark))
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    return sorted(((r["doc_id"], library.encode(t or "", add_special_tokens=False).ids) for r, t in zip(rows, texts)), key=str)


def piped(spark, tmp_path, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "exact"]
    return sorted(((r["doc_id"], list(r["ids"])) for r in got.collect()), key=str)


def test_pipeline_equals_brute_force(spark, docs, labels, benchmark, tmp_path):
    want = brute_pipeline(spark, docs, labels, benchmark.collect())
    got = piped(spark, tmp_path, docs, labels, benchmark)
    assert got == want and 50 < len(got) < docs.count()


def test_pipeline_on_odd_and_empty_tables(spark, odd, nothing, labels, benchmark, tmp_path):
    few = labels.limit(0)  # no label: every text scores one half and stays
    assert piped(spark, tmp_path / "odd", odd, few, benchmark) == brute_pipeline(spark, odd, few, benchmark.collect())
    assert piped(spark, tmp_path / "none", nothing, few, benchmark.limit(0)) == []
