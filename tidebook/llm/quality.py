"""Quality by a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairs of features
interact through vectors of RANK numbers, and the sum-of-squares identity makes that linear in the features of a
text. The machine is fitted on a bounded sample of labelled rows; scoring is one pass over whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import bounded_batches, held_out, materialize, read_table, sampled_labels

#: Labelled rows that are learned from at most.
MAX_LABELLED = 8_000
#: Hash buckets of words, interaction rank, bins of each statistic.
BUCKETS, RANK, BINS = 1 << 14, 8, 10
THRESHOLD = 0.5
EPOCHS, BATCH, STEP, DECAY = 8, 64, 0.08, 1e-5
STATISTICS = ["bytes", "words", "lines", "word_bytes", "distinct_words", "distinct_lines", "upper", "digit", "mark", "sign", "bar", "beyond_ascii", "commonest_word", "long_words"]

_UPPER, _LOWER, _DIGIT, _BEYOND = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58], _BEYOND[128:] = True, True, True, True


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_MARK, _SIGN, _BAR = _set(b".,;:?'\"-()"), _set(b"%&$#*!@^~<>{}[]=+\\/"), _set(b"|_")


def statistics(text: str) -> tuple[list[float], set[str]]:
    """The numbers named in STATISTICS, all finite for any text, and the distinct lower-cased words."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    words = text.lower().split()
    counts = Counter(words)
    distinct = set(counts)
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    most = max(counts.values(), default=0)  # how much the commonest word repeats tells loops from prose
    share = lambda mask: float(raw[mask].sum()) / size
    return [
        np.log1p(raw.sum()), np.log1p(len(words)), np.log1p(len(lines)), size / n / 10, len(distinct) / n, len(set(lines)) / max(1, len(lines)),
        share(_UPPER), share(_DIGIT), share(_MARK), share(_SIGN), share(_BAR), share(_BEYOND), most / n, sum(len(w) > 24 for w in distinct) / n,
    ], distinct


def word_buckets(words: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), np.int64, len(words)))


@dataclass
class Machine:
    """w0, w and v of the machine; mean and scale of the statistics, and the edges of their bins."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray

    def row(self, numbers: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of a text: words share unit length, statistics come scaled and as bins."""
        k = len(STATISTICS)
        bins = np.array([np.searchsorted(e, x) for e, x in zip(self.edges, numbers)], np.int64)
        at = np.concatenate([buckets, BUCKETS + np.arange(k), BUCKETS + k + np.arange(k) * (BINS + 1) + bins])
        z = np.clip((numbers - self.mean) / self.scale, -4, 4) / np.sqrt(k)
        value = np.concatenate([np.full(len(buckets), 1 / np.sqrt(max(1, len(buckets)))), z, np.full(k, 1 / np.sqrt(k))])
        return at, value

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[at] * value[:, None]
        s = vx.sum(0)
        return float(self.bias + self.linear[at] @ value + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, text: str) -> float:
        numbers, words = statistics(text)
        return float(1 / (1 + np.exp(-np.clip(self.margin(*self.row(np.array(numbers), word_buckets(words))), -30, 30))))


def fitted(numbers: np.ndarray, buckets: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad over a sample that fits in memory (MAX_LABELLED bounds it)."""
    rng = np.random.default_rng(seed)
    k = len(STATISTICS)
    size = BUCKETS + k + k * (BINS + 1)
    mean, scale = numbers.mean(0), numbers.std(0) + 1e-6
    edges = np.quantile(numbers, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    m = Machine(float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)), mean, scale, edges)
    rows = [m.row(x, b) for x, b in zip(numbers, buckets)]
    # both classes weigh alike in sum, softened, so that the rare one is learned
    rare = np.where(labels > 0, np.sqrt(len(labels) / max(1.0, 2 * labels.sum())), np.sqrt(len(labels) / max(1.0, 2 * (len(labels) - labels.sum()))))
    g_bias, g_linear, g_factors = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            at = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            first = np.r_[0, np.flatnonzero(np.diff(of)) + 1]
            vx = m.factors[at] * value[:, None]
            s = np.add.reduceat(vx, first, axis=0)
            margin = m.bias + np.add.reduceat(m.linear[at] * value, first) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), first))
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) * rare[part] / len(part)
            each = err[of] * value
            own, where = np.unique(at, return_inverse=True)
            d_linear = np.bincount(where, each, len(own)) + DECAY * m.linear[own]
            grad = each[:, None] * (s[of] - vx)
            d_factors = np.stack([np.bincount(where, grad[:, f], len(own)) for f in range(RANK)], 1) + DECAY * m.factors[own]
            g_bias += err.sum() ** 2
            g_linear[own] += d_linear**2
            g_factors[own] += d_factors**2
            m.bias -= STEP * err.sum() / np.sqrt(g_bias)
            m.linear[own] -= STEP * d_linear / np.sqrt(g_linear[own])
            m.factors[own] -= STEP * d_factors / np.sqrt(g_factors[own])
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Machine:
    """The machine, from at most max_rows labelled rows that are not held out; features are made in the tasks.

    With no label at all every text scores one half.
    """
    sample = sampled_labels(docs, labels, "quality", max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [statistics(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in made], pa.list_(pa.float64())), pa.array([word_buckets(w) for _, w in made], pa.list_(pa.int64())), b.column(2)], ["label", "numbers", "buckets", "doc_id"])

    rows = materialize(bounded_batches(sample).select("text", "label", F.col("doc_id").cast("long")).mapInArrow(run, "label int, numbers array<double>, buckets array<long>, doc_id long"), "features")
    known = rows.orderBy("doc_id").toArrow().combine_chunks()  # the same order on every run
    y = known.column("label").to_numpy().astype(float)
    k = len(STATISTICS)
    if not len(y):
        size = BUCKETS + k + k * (BINS + 1)
        return Machine(0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros(k), np.ones(k), np.zeros((k, BINS - 1)))
    flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in known.column(name).chunks])
    lengths = np.concatenate([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in known.column("buckets").chunks])
    return fitted(flat("numbers").reshape(len(y), k), np.split(flat("buckets"), np.cumsum(lengths)[:-1]), y)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for each of docs: the probability that the quality label is 1.

    Null texts score as empty ones. Rows with a null doc_id are scored too (held_out, a hash of the id, is null for
    them); repeated rows each get a row; extra columns are ignored.
    """
    rows = bounded_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    shared = rows.sparkSession.sparkContext.broadcast(machine)  # about a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py() or "") for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score under the threshold; all columns, whatever their names, as before.

    A row goes through Python once, its text once in it, and only rows that stay come back.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(learn(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py() or "") >= threshold for t in b.column(at).cast(pa.string())], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scored(docs, learn(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
