"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

Folding undoes disguises: look-alike letters of other scripts, digits and signs for letters, spelled-out words,
stretched letters, invisible characters. The lexicon holds seed words and the words and word beginnings that labelled
texts show to go with toxicity, each weighted by its log odds; hits inside an exception phrase do not count. Weights
are learned from one half of a bounded sample of labelled rows and turned into a score by the other half.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import bounded_batches, held_out, materialize, read_table, sampled_labels

#: Labelled rows that are learned from at most.
MAX_LABELLED = 20_000
#: An entry needs so many toxic texts and such log odds.
LEAST_TEXTS, LEAST_ODDS = 4, 1.6
#: Word beginnings of these lengths may be entries.
BEGINNINGS = range(4, 11)
THRESHOLD = 0.7

#: Numbers that features() gives of a text.
N_FEATURES = 6

#: Seed words with the weight they have before any label is seen.
SEED_WEIGHT = 6.0
SEEDS = """idiot idiots moron morons stupid scum trash pathetic worthless disgusting loser losers clown clowns imbecile
dumbass asshole bastard bitch cretin degenerate filth fool retard scumbag vermin braindead subhuman idiotic moronic
idiota imbécil estúpido estúpida basura escoria inútil asqueroso payaso perdedor
abruti crétin débile ordure déchet pathétique connard salaud
dummkopf trottel abschaum versager idioten schwachkopf arschloch widerlich erbärmlich""".split()
#: Phrases in which a seed word says nothing bad.
EXCEPTIONS = """trash can|trash cans|trash bin|trash bag|trash bags|trash collection|class clown|circus clown|clown fish|clown shoes|
pond scum|soap scum|sore loser|losers bracket|fool proof|april fool|april fools|fool around|nobody s fool|basura orgánica|pathetic fallacy""".replace("\n", "").split("|")

#: Letters of other scripts that look like Latin ones.
_LOOKS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "и": "u", "у": "y", "х": "x", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ⅼ": "l", "ո": "n", "օ": "o", "ս": "u",
}
_LOOKS_TABLE = str.maketrans(_LOOKS)
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF])
_FAR = re.compile("[^\x00-\xac\xae-İĲ-ɏ]|\xad")
#: Digits and signs that stand for letters.
_STANDS = str.maketrans("03457@$", "oeastas")
_SIGNED = re.compile(r"(?<![^\W\d_])[@$](?=[^\W_])|(?<=[^\W_])[@$!|](?=[^\W_])")
_DIGIT = re.compile(r"\d")
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:([ .*_-])[^\W_])(?:\1[^\W_]){2,}(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_WORDS = re.compile(r"[^\W_]+")


def _undigit(word: str) -> str:
    """A word with digits as letters; 1, ! and | may be i or l, so both readings follow each other."""
    if word.isalpha() or word.isdigit() or not any(c.isalpha() for c in word):
        return word
    word = word.translate(_STANDS)
    return word if "1" not in word else word.replace("1", "i") + " " + word.replace("1", "l")


def fold(text: str) -> tuple[str, int]:
    """The folded words, each between blanks, and how many words the text has (at least 1)."""
    text = text.lower()
    if _FAR.search(text):
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).lower().translate(_LOOKS_TABLE)
    n = len(_WORDS.findall(text))
    if _SIGNED.search(text):
        text = _SIGNED.sub(lambda m: "1" if m.group() in "!|" else m.group().translate(_STANDS), text)
    if _SPELLED.search(text):
        text = _SPELLED.sub(lambda m: m.group().replace(m.group(1), ""), text)
    if _STRETCHED.search(text):
        text = _STRETCHED.sub(r"\1", text)
    words = _WORDS.findall(text)
    if _DIGIT.search(text):
        words = map(_undigit, words)
    return " " + " ".join(words) + " ", max(1, n)


@dataclass
class Lexicon:
    """Entries begin with a blank; those that end with one are whole words, the others beginnings."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: EXCEPTIONS)
    coefficients: list[float] | None = None

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            phrase = fold(phrase)[0]
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def features(text: str, automaton: ahocorasick.Automaton) -> list[float]:
    """Weight for each word, hits for each word, number of hits, largest weight, length; at one word the largest weight counts."""
    folded, n = fold(text)
    hits: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded) if len(automaton) else ():
        start = end + 1 - length
        if weight is None:
            covered.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    if covered and hits:
        covered.sort(reverse=True)
        until, left = -1, {}
        for s in sorted(hits):  # one sweep over places and phrases: until is the farthest end of those that begin before s
            while covered and covered[-1][0] <= s:
                until = max(until, covered.pop()[1])
            if s >= until:
                left[s] = hits[s]
        hits = left
    total, strong = sum(hits.values()), [w for w in hits.values() if w >= 4]
    return [total / (n + 8), len(strong) / (n + 8), np.log1p(len(strong)), max(hits.values(), default=0.0), np.log1p(total), np.log1p(n)]


def _entries_of(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {" " + w[:k] for w in words for k in BEGINNINGS if k < len(w)}


def entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, toxic, clean): in how many texts of either label an entry occurs. Counts are added up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(seen[0] | seen[1])
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])
            for s in seen:
                s.clear()
            return b

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[int(label == 1)].update(_entries_of(fold(text)[0]))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield out()
        yield out()

    return sample.select("text", "label").mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Mean, scale, weights and bias of a logistic regression by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) / len(z) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) / len(z) + ridge * w)
    return [*mean, *scale, *w]


def score(x: np.ndarray, coefficients: list[float]) -> np.ndarray:
    k = x.shape[1]
    c = np.asarray(coefficients)
    return 1 / (1 + np.exp(-np.clip(((x - c[:k]) / c[k : 2 * k]) @ c[2 * k : 3 * k] + c[3 * k], -30, 30)))


def _with_features(rows: DataFrame, lexicon: Lexicon, kept: list[str]) -> DataFrame:
    """The kept columns of rows and the list of features of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            x = [features(t or "", automaton) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*kept, "x"])

    types = dict(rows.dtypes)
    return rows.select(*kept, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", x array<double>")


#: Of a text without labels to learn from: about one strong hit in twelve words reaches the threshold.
UNFITTED = [0.0] * 6 + [1.0] * 6 + [2.0, 20.0, 1.2, 0.25, 0.0, 0.0, -4.0]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Lexicon:
    """The lexicon and its score, from at most max_rows labelled rows that are not held out.

    Without toxic or clean rows to learn from, the seed words and fixed coefficients remain.
    """
    sample = materialize(sampled_labels(docs, labels, "toxic", max_rows), "sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    sizes = {r[0]: r[1] for r in sample.where(half == 0).groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    weights = {f" {fold(w)[0].strip()} ": SEED_WEIGHT for w in SEEDS}
    if toxic and clean:
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0) / ((F.col("clean") + 0.5) / (clean + 1.0)))
        found = entry_counts(sample.where(half == 0)).where(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
        best = found.select("entry", "odds").collect()  # what LEAST_TEXTS of at most max_rows texts share with such odds
        weights |= {r["entry"]: float(r["odds"]) for r in best}
    lexicon = Lexicon(weights)
    rows = _with_features(sample.where(half == 1), lexicon, ["label"]).collect()  # at most max_rows short lists
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), N_FEATURES), np.array([r["label"] for r in rows], float)
    lexicon.coefficients = _fit_logistic(x, y) if 0 < y.sum() < len(y) else UNFITTED
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for each of docs: the probability that a text is toxic.

    Null and empty texts have no hits and the score of that. Rows with a null doc_id are scored too; repeated rows each
    get a row; extra columns are ignored.
    """
    rows = bounded_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            x = np.array([features(t or "", automaton) for t in b.column(1).to_pylist()]).reshape(b.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(x, lexicon.coefficients) if b.num_rows else [], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {types['doc_id']}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scored(docs, learn(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
