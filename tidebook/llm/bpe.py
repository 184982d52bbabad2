"""Byte-level BPE by a minimal acyclic transducer of frequent words, with exact merging for the rest.

Pieces of the corpus are counted over all documents; the most frequent ones are compiled, with the ids that the
merges give them, into an acyclic automaton whose equal suffixes are shared. Each arc carries the number of words
it skips, so the sum along a path is the word's number and points at its ids. The arrays go to the executors as one
file that tasks map into memory; all new pieces of a batch walk the automaton in lock step. Pieces that it does not
hold are merged pair by pair, exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import sys
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import bounded_batches, filesystem, materialize, read_table, scratch_path

VOCABULARY = "byte_bpe_50k.json"
#: Words that the transducer holds at most, the most frequent first; all others are merged.
LEXICON_WORDS = 262_144
#: Longer pieces are not worth a place in the transducer.
LEXICON_BYTES = 48
#: Pieces that a worker remembers between batches, and characters that it encodes at a time.
REMEMBERED, CHARS_AT_ONCE = 250_000, 2 << 20
#: The pre-tokenizer's pattern, fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: The same pattern on texts of ASCII alone, where the standard library's engine can do it.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


def _ranges(chars: set[str]) -> str:
    """The given characters as the inside of a regular expression's class."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08X}" if a == b else f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


@lru_cache(maxsize=1)
def newer_characters() -> dict[str, str]:
    """For each class of PATTERN, the characters that the `regex` module counts in and the tokenizers library does not.

    Both have Unicode tables of their own, of different versions. All code points are put through the library's own
    splitter once; its tables may be older, not newer. Without the library nothing is known to differ.
    """
    try:
        from tokenizers import Regex, pre_tokenizers
    except ModuleNotFoundError:
        return {}
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF)
    parts, out = [every[i : i + 65_536] for i in range(0, len(every), 65_536)], {}
    for name in ("L", "N"):
        split = pre_tokenizers.Split(Regex(rf"[^\p{{{name}}}]+"), "removed")
        known = {c for part in parts for piece, _ in split.pre_tokenize_str(part) for c in piece}
        if newer := _ranges(set("".join(regex.findall(rf"\p{{{name}}}+", every))) - known):
            out[name] = newer
    return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks and bytes of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        unspell = lambda token: bytes(letters[c] for c in token)
        ids = {unspell(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            a, b = unspell(a), unspell(b)
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of the lowest rank, the leftmost of equals, is merged until none is left."""
        parts = [self.byte_id[b] for b in piece]
        if len(parts) > 64:
            return self._merge_long(parts)
        get, none = self.merges.get, (1 << 60, 0)
        pairs = [get(p, none) for p in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [best[1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get((parts[i], parts[i + 1]), none)
            if i:
                pairs[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap, for pieces of any length."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (m := self.merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (m := self.merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y], m[1]))
        return [p for p in parts if p >= 0]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


# --- transducer -----------------------------------------------------------------------------------------------


def minimal_automaton(words: list[bytes]) -> tuple[list[tuple[int, ...]], list[bool]]:
    """Arcs and final marks of the minimal acyclic automaton of sorted distinct words; the root is the last state.

    An arc is one number, its target times 256 plus its byte.
    """
    arcs: list[tuple[int, ...]] = []
    final: list[bool] = []
    known: dict[tuple[int, ...], int] = {}
    path: list[list] = [[False, []]]  # of the current word: final mark, finished arcs

    def settle(state: list) -> int:
        out = tuple(state[1])
        key = (-1, *out) if state[0] else out
        if (n := known.get(key)) is None:
            n = known[key] = len(arcs)
            arcs.append(out)
            final.append(state[0])
        return n

    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        while len(path) - 1 > common:
            state = path.pop()
            path[-1][1].append(settle(state) * 256 + last[len(path) - 1])
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = path.pop()
        path[-1][1].append(settle(state) * 256 + last[len(path) - 1])
    arcs.append(tuple(path[0][1]))
    final.append(path[0][0])
    return arcs, final


class Transducer:
    """Word -> ids over mapped arrays: arc keys (state, byte), targets, skips, final marks, and the words' ids."""

    def __init__(self, data: np.ndarray):
        head = data[:8]
        n_arcs, n_states, n_words, n_ids = (int(x) for x in head[:4])
        at = 8
        self.parts = []
        for n in (n_arcs, n_arcs, n_arcs, n_states, n_words + 1, n_ids):
            self.parts.append(data[at : at + n])
            at += n
        self.key, self.target, self.skip, self.final, self.first, self.ids = self.parts
        self.root = n_states - 1

    @staticmethod
    def compiled(words: list[bytes], ids_of: Callable[[bytes], list[int]]) -> np.ndarray:
        """The arrays, in one, of a transducer of sorted distinct words; compact ones throughout, as this runs on the driver."""
        arcs, final = minimal_automaton(words)
        below = array("i", bytes(4 * len(arcs)))  # words from a state on; targets come before their sources
        key, target, skip = array("i"), array("i"), array("i")
        for s, out in enumerate(arcs):
            n = int(final[s])
            for t, label in (divmod(a, 256) for a in out):
                key.append(s * 256 + label)
                target.append(t)
                skip.append(n)
                n += below[t]
            below[s] = n
        first, flat = array("i", [0]), array("i")
        for w in words:
            flat.extend(ids_of(w))
            first.append(len(flat))
        head = [len(key), len(arcs), len(words), len(flat), 0, 0, 0, 0]
        return np.concatenate([np.asarray(x, np.int32) for x in (head, key, target, skip, final, first, flat)])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the automaton does not hold it."""
        if not words or not len(self.key):
            return np.full(len(words), -1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths > 0)
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            if not len(live):
                break
            want = state[live] * 256 + text[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            there = self.key[arc] == want
            state[live[~there]] = -1
            live, arc = live[there], arc[there]
            state[live] = self.target[arc]
            number[live] += self.skip[arc]
        held = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        return np.where(held, number, -1)


# --- encoding -------------------------------------------------------------------------------------------------


class Encoder:
    """Encodes batches of texts; one for each worker, over a mapped transducer."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer, newer: dict[str, str] | None = None):
        """newer: what newer_characters() found; texts that hold such characters are split by a pattern without them."""
        self.vocabulary, self.transducer = vocabulary, transducer
        self._any, self._ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self._newer = self._exact = None
        if newer:
            letters, numbers = (f"[\\p{{{c}}}--[{newer[c]}]]" if c in newer else f"\\p{{{c}}}" for c in "LN")
            self._newer = regex.compile(f"[{''.join(newer.values())}]").search
            self._exact = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?[^\\s{letters}{numbers}]+|\\s+(?!\\S)|\\s+", regex.V1).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        """Forget all pieces but the special tokens."""
        special = self.vocabulary.special
        self.ids_of = {t: str(i) for t, i in special.items()}
        self.bytes_of = {t: self.vocabulary.bytes_of[i] for t, i in special.items()}

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces not met before, by the transducer or merged, and what those ids decode to."""
        new = [p for p in pieces if p not in self.ids_of]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        t, merge, token, text = self.transducer, self.vocabulary.merge, self.vocabulary.bytes_of, self.vocabulary.text_of
        for piece, word, number in zip(new, raw, t.numbers(raw).tolist()):
            ids = t.ids[t.first[number] : t.first[number + 1]].tolist() if number >= 0 else merge(word)
            self.ids_of[piece] = ",".join([text[i] for i in ids])
            self.bytes_of[piece] = b"".join([token[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids, in decimal and joined by commas, and the text that those ids decode to."""
        at = 0
        while at < len(texts):
            first, pieces, size = at, [], 0
            while at < len(texts) and size < CHARS_AT_ONCE:
                pieces.append(self._split(texts[at], self._fast))
                size += len(texts[at])
                at += 1
            if len(self.ids_of) > REMEMBERED:
                self.forget()
            # pieces that hold newer characters are never remembered, so they are always among the new ones
            odd = self._odd(set().union(*pieces))
            if odd:
                pieces = [self._split(t, self.pieces_of) for t in texts[first:at]]
                odd = self._odd(set().union(*pieces))
            self.learn(set().union(*pieces))
            ids, back = self.ids_of.__getitem__, self.bytes_of.__getitem__
            if odd:  # worked out before they are forgotten, as who asks may not come back after the last text
                made = [(",".join(map(ids, own)), b"".join(map(back, own)).decode("utf-8", "replace")) for own in pieces]
                for p in odd:
                    del self.ids_of[p], self.bytes_of[p]
                yield from made
                continue
            for own in pieces:
                yield ",".join(map(ids, own)), b"".join(map(back, own)).decode("utf-8", "replace")

    def _odd(self, pieces: set[str]) -> list[str]:
        """Pieces not met before that hold a character which the two Unicode tables class differently."""
        return [p for p in pieces - self.ids_of.keys() if not p.isascii() and self._newer(p)] if self._newer else []

    def _fast(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text)

    def pieces_of(self, text: str) -> list[str]:
        """Pieces of a text without special tokens, whatever characters it holds."""
        return self._exact(text) if self._newer and self._newer(text) else self._fast(text)

    def _split(self, text: str, pieces_of: Callable[[str], list[str]]) -> list[str]:
        """Pieces of a text; a special token's string is always a piece of its own."""
        if self.special is None or not self.special.search(text):
            return pieces_of(text)
        parts = enumerate(self.special.split(text))
        return [p for i, part in parts for p in ([part] if i % 2 else pieces_of(part))]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary file lies on this machine; it is installed alike on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _encoder(path: str, file: str, newer: tuple[tuple[str, str], ...]) -> Encoder:
    return Encoder(_vocabulary(path), Transducer(np.load(SparkFiles.get(file), mmap_mode="r")), dict(newer))


def frequent_pieces(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces over all documents that occur twice or more, at most `most` (a bounded list).

    How many pieces have each count (high counts in steps of about a hundredth) is a table of some thousand rows; it
    tells from which count on the pieces fit, so nothing is sorted and no task sees more than its share.
    """
    pieces = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(PATTERN), F.lit(0))).alias("piece"))
    counted = pieces.where(F.octet_length("piece") <= LEXICON_BYTES).groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("int")
    counted = materialize(counted.select("piece", step.alias("step")), "pieces")
    cut, taken = None, 0
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):
        taken += r["count"]
        if taken > most:
            break
        cut = r["step"]
    return [] if cut is None else counted.where(F.col("step") >= cut).select("piece").toArrow().column(0).to_pylist()


def lexicon_file(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> str:
    """Compile the lexicon and hand its file to all executors, later ones too; returns the file's name."""
    words = sorted(p.encode() for p in frequent_pieces(docs, most))
    folder, name = scratch_path(spark, "lexicon"), f"lexicon-{uuid.uuid4().hex}.npy"
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as sink:
        np.save(sink, Transducer.compiled(words, vocabulary.merge))
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encoded(docs: DataFrame, vocabulary: str | None = None, most: int = LEXICON_WORDS, digests: bool = False, checked: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each of docs; with digests, SHA-256 of ids and of the decoded text instead.
    checked adds token_ids, the array itself, and exact: whether what the ids give back is the text (empty for a null one).

    ids is the array of token ids, decoded is what the ids give back. Null and empty texts have no ids. Strings of special
    tokens in a text become those tokens. Repeated rows each get a row; extra columns are ignored; texts of any
    length are encoded whole.
    """
    path = vocabulary or vocabulary_path()
    newer = tuple(newer_characters().items())
    file = lexicon_file(docs.sparkSession, docs, Vocabulary(path), most)  # not kept: the driver has no further use for it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = _encoder(path, file, newer), lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        try:
            for b in batches:
                n, first, second, tokens, exact = [], [], [], [], []
                texts = [t or "" for t in b.column(1).to_pylist()]
                for text, (ids, back) in zip(texts, encoder.encode(texts)):
                    n.append(ids.count(",") + 1 if ids else 0)
                    first.append(sha(ids) if digests else np.fromstring(ids, np.int32, sep=",") if ids else [])
                    second.append(sha(back) if digests else back)
                    if checked:
                        tokens.append(np.fromstring(ids, np.int32, sep=",") if ids else [])
                        exact.append(back == text)
                kind = pa.string() if digests else pa.list_(pa.int32())
                more = [pa.array(tokens, pa.list_(pa.int32())), pa.array(exact, pa.bool_())] if checked else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, pa.string()), *more], ["doc_id", "n_tokens", "ids", "decoded", *(["token_ids", "exact"] if checked else [])])
        finally:
            encoder.forget()  # the worker lives on and does other work

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids {'string' if digests else 'array<int>'}, decoded string{', token_ids array<int>, exact boolean' if checked else ''}")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(read_table(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
