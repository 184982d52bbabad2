"""Phrase collocations by pivot partitioning: each phrase is counted where its rarest word is at home.

Words have one order, the most frequent first; the pivot of a phrase is its last word in that order. For each place of
a frequent word the text around it is rewritten to what phrases of that pivot can hold: at most three words to the
left that come before the pivot, three to the right that do not come after it, and nothing beyond the first word that
does. Equal fragments are summed before they travel to their pivot's partition, where phrases are mined locally and only
those that the pivot owns come out. A phrase with its pivot twice belongs to the first place, so none is counted again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import bounded_batches, filesystem, looked_up, materialize, read_table

#: Words of a phrase at most, and how often it occurs at least.
LONGEST, LEAST = 4, 30
#: A phrase inside a longer one goes if the longer one has at least so many percent of its occurrences.
INSIDE_PERCENT = 80
#: Scores are in this many parts of a mean of both sides; rows reported for each language.
SCALE, TOP = 2_000_000, 2000
#: Frequent words that each worker holds in memory, as 24 bytes each; with more of them, words meet their places in a salted join.
HELD_WORDS = 2_500_000
#: Words whose ids a task remembers at most, frequent or not, and words in a file of ids.
KNOWN_WORDS, FILE_WORDS = 400_000, 250_000
#: Words that a task counts, fragments that it sums and rows that it mines at a time.
WORDS_AT_ONCE, FRAGMENTS_AT_ONCE, ROWS_AT_ONCE = 200_000, 1 << 19, 1 << 16
#: A pivot with more occurrences than this is mined in several parts, whose counts are added.
HOT_PIVOT = 1 << 20
#: Bytes that end a piece become a full stop between blanks, and tabs a blank.
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")

_SIDE = LONGEST - 1
#: Columns of a fragment: words to the left, the nearest first, the pivot, words to the right. -1 is none.
FRAGMENT = [*(f"l{i}" for i in range(1, _SIDE + 1)), "p", *(f"r{i}" for i in range(1, _SIDE + 1))]
PHRASE = [f"w{i}" for i in range(1, LONGEST + 1)]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a full stop (which no word holds) where pieces end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BREAKS).replace(b".", b" . ").split()


def _of_lang(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return bounded_batches(docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(b".", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "f"])
        counts.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, counts.values())) >= WORDS_AT_ONCE:
                yield from out()
    yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) over all docs; tasks count in bounded memory and their counts are added."""
    return _of_lang(docs).mapInArrow(_count_batches, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def ordered_words(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, lang, word, f) of the words that occur `least` times: ids rise with rarity. Sorted by ranges, so no task holds all."""
    by_rarity = counts.where(F.col("f") >= least).orderBy(F.desc("f"), "lang", "word")
    return materialize(by_rarity.withColumn("id", F.monotonically_increasing_id()), "words")


# --- fragments ------------------------------------------------------------------------------------------------


def fragments_of(ids: np.ndarray, pivots: np.ndarray | None = None) -> list[np.ndarray]:
    """Columns of FRAGMENT, one row for each place that some phrase can stand around. ids: words in order of place, -1
    between pieces and for words that are not frequent. pivots: which places to look at, all if not given."""
    n = len(ids)
    padded = np.concatenate([np.full(_SIDE, -1, np.int64), ids, np.full(_SIDE, -1, np.int64)])
    left, right = [], []
    open_left = open_right = ids >= 0 if pivots is None else pivots & (ids >= 0)
    for i in range(1, _SIDE + 1):
        a, b = padded[_SIDE - i : _SIDE - i + n], padded[_SIDE + i : _SIDE + i + n]
        open_left, open_right = open_left & (a >= 0) & (a < ids), open_right & (b >= 0) & (b <= ids)
        left.append((open_left, a))
        right.append((open_right, b))
    some = np.flatnonzero(left[0][0] | right[0][0])
    keep = lambda side: [np.where(ok[some], word[some], -1) for ok, word in side]
    return [*keep(left), ids[some], *keep(right)]


def _summed(table: pa.Table, by: list[str], what: str = "n") -> pa.Table:
    return table.group_by(by, use_threads=False).aggregate([(what, "sum")]).rename_columns([*by, what])


class _Fragments:
    """Fragments of a task, equal ones summed; handed out whenever too many are held."""

    def __init__(self):
        self.new: list[pa.Table] = []
        self.rows, self.held = 0, None

    def add(self, ids: np.ndarray, pivots: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        columns = fragments_of(ids, pivots)
        self.new.append(pa.table([*columns, np.ones(len(columns[0]), np.int64)], names=[*FRAGMENT, "n"]))
        self.rows += len(columns[0])
        if self.rows >= FRAGMENTS_AT_ONCE:
            self._sum()
            if self.held.num_rows >= FRAGMENTS_AT_ONCE // 2:
                yield from self.out()

    def _sum(self) -> None:
        self.held = _summed(pa.concat_tables([*([self.held] if self.held is not None else []), *self.new]), FRAGMENT)
        self.new, self.rows = [], 0

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.new:
            self._sum()
        if self.held is not None:
            yield from self.held.combine_chunks().to_batches(1 << 16)
        self.held = None


_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in [*FRAGMENT, "n"]])


class _Ids:
    """Ids by two 64-bit hashes of language and word, from files (a, b, id)."""

    def __init__(self, files: list[str]):
        tables = []
        for file in files:
            fs, path = filesystem(file)
            with fs.open_input_file(path) as source:
                tables.append(pq.ParquetFile(source).read())
        columns = [np.concatenate([t.column(c).to_numpy() for t in tables] or [np.empty(0, np.int64)]) for c in ("a", "b", "id")]
        order = np.argsort(columns[0], kind="stable")
        self.a, self.b, self.id = (memoryview(c[order]) for c in columns)

    def find(self, lang: bytes, word: bytes) -> int:
        a, b = _hash(lang, word), _hash(word, lang)
        at = bisect_left(self.a, a)
        while at < len(self.a) and self.a[at] == a:
            if self.b[at] == b:
                return self.id[at]
            at += 1
        return -1


def _hash(first: bytes, second: bytes) -> int:
    """Spark's xxhash64 of two strings."""
    h = xxhash.xxh64_intdigest(second, xxhash.xxh64_intdigest(first, 42))
    return h - (h >> 63 << 64)


class _Known(dict):
    """Ids of the words of a language that a task has met, -1 for those that are not frequent."""

    def __init__(self, ids: _Ids, lang: str):
        self.ids, self.lang = ids, lang.encode("utf-8", "surrogatepass")

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.ids.find(self.lang, word)
        return found


def _held_fragments(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Fragments where hashes of all frequent words fit a worker's memory. Tasks read them from the shared folder, so none
    pass the driver."""
    keys = words.select(F.xxhash64("lang", "word").alias("a"), F.xxhash64("word", "lang").alias("b"), "id")
    files = materialize(keys.coalesce(-(-words.count() // FILE_WORDS) or 1), "word-ids").inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, own, found = _Ids(files), {}, _Fragments()
        for b in batches:
            ids = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang not in own:
                    own[lang] = _Known(ids_of, lang)
                if words := words_of(text.as_py()):
                    ids.append(np.fromiter(map(own[lang].__getitem__, words), np.int64, len(words)))
                    ids.append(np.full(1, -1, np.int64))
            if len(own) + sum(map(len, own.values())) > KNOWN_WORDS:
                own.clear()
            if ids:
                yield from found.add(np.concatenate(ids))
        yield from found.out()

    return _of_lang(docs).mapInArrow(run, _SCHEMA)


#: Places of a text whose words come together again after they met their ids in a join.
_STRETCH = 256


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            words = words_of(text.as_py())
            for at in range(0, len(words), 65_536):
                part = words[at : at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), pa.int64()), pa.array([lang] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.binary()).cast(pa.string())], ["doc", "lang", "at", "word"])


def _stretch_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    found, width = _Fragments(), size + 2 * _SIDE
    for b in batches:
        lines = np.full((b.num_rows, width), -1, np.int64)
        for line, stretch, places in zip(lines, b.column(0).to_pylist(), b.column(1)):
            line[places.values.field("at").to_numpy() - stretch * size + _SIDE] = places.values.field("id").to_numpy()
        pivots = np.zeros(lines.shape, bool)
        pivots[:, _SIDE:-_SIDE] = True
        yield from found.add(lines.ravel(), pivots.ravel())
    yield from found.out()


def _joined_fragments(docs: DataFrame, words: DataFrame, size: int = _STRETCH) -> DataFrame:
    """The same where there are more frequent words: each place meets its word's id in a salted join, and stretches of
    `size` places come together again with the margins of their neighbours, so no group is larger than that."""
    texts = materialize(_of_lang(docs).withColumn("doc", F.monotonically_increasing_id()), "texts")  # stored: an id must not change when a task is done again
    listed = bounded_batches(texts.select("doc", "lang", "text")).mapInArrow(_place_batches, "doc long, lang string, at long, word string").where("word <> '.'")
    keyed = words.select(F.struct("lang", "word").alias("k"), "id")
    met = looked_up(listed.select(F.struct("lang", "word").alias("k"), "doc", "at"), keyed, "k", F.struct("doc", "at"), how="inner")
    near = F.array_distinct(F.transform(F.array(F.lit(-_SIDE), F.lit(0), F.lit(_SIDE)), lambda x: F.floor((F.col("at") + x) / size)))
    dealt = met.select("doc", "at", "id", F.explode(near).alias("stretch")).where("stretch >= 0")
    stretches = dealt.groupBy("doc", "stretch").agg(F.collect_list(F.struct("at", "id")).alias("places"))
    return stretches.select("stretch", "places").mapInArrow(lambda batches: _stretch_batches(batches, size), _SCHEMA)


def fragments(docs: DataFrame, words: DataFrame, held_words: int = HELD_WORDS) -> DataFrame:
    """(l1 .. l3, p, r1 .. r3, n): the rewritten surroundings of pivots, equal ones of a task summed."""
    return (_held_fragments if words.count() <= held_words else _joined_fragments)(docs, words)


# --- local mining ---------------------------------------------------------------------------------------------


def mined_table(rows: pa.Table) -> pa.Table:
    """(p, w1 .. w4, n): every phrase around the pivots of whole fragments, with what it adds up to."""
    out = []
    column = {c: rows.column(c).to_numpy() for c in [*FRAGMENT, "n"]}
    for i in range(_SIDE + 1):
        for j in range(_SIDE + 1 - i):
            own = [*(f"l{k}" for k in range(i, 0, -1)), "p", *(f"r{k}" for k in range(1, j + 1))]
            if len(own) < 2:
                continue
            some = np.flatnonzero((column[own[0]] >= 0) & (column[own[-1]] >= 0))  # what lies nearer to the pivot is there too
            words = [column[c][some] for c in own] + [np.full(len(some), -1, np.int64)] * (LONGEST - len(own))
            out.append(pa.table([column["p"][some], *words, column["n"][some]], names=["p", *PHRASE, "n"]))
    return _summed(pa.concat_tables(out), ["p", *PHRASE])


def _mine_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows of FRAGMENT, n and part, sorted by pivot. The rows of a pivot that is not split (part -1) are all here, so
    its rare phrases end here; what a part of a split one finds is added up later."""
    waiting: list[pa.RecordBatch] = []
    held = 0

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for split in (False, True):
            own = rows.filter(pc.equal(pc.greater_equal(rows.column("part"), 0), split))
            if own.num_rows:
                found = mined_table(own)
                found = found if split else found.filter(pc.greater_equal(found.column("n"), least))
                yield from found.select([*PHRASE, "n"]).combine_chunks().to_batches(1 << 16)

    for b in batches:
        waiting.append(b)
        held += b.num_rows
        if held >= ROWS_AT_ONCE:
            rows = pa.Table.from_batches(waiting)
            pivots = rows.column("p").to_numpy()
            last = int(np.searchsorted(pivots, pivots[-1])) or (len(rows) if rows.column("part")[-1].as_py() >= 0 else 0)
            yield from out(rows.slice(0, last))
            waiting, held = rows.slice(last).combine_chunks().to_batches(), len(rows) - last
    if waiting:
        yield from out(pa.Table.from_batches(waiting))


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, held_words: int = HELD_WORDS, hot_pivot: int = HOT_PIVOT) -> DataFrame:
    """(w1 .. w4, n) of all phrases of two words or more that occur `least` times; words are ids, -1 where there is none.

    A pivot's fragments meet in one task unless it has over hot_pivot occurrences: then they are dealt over parts.
    """
    hot = materialize(words.where(F.col("f") > hot_pivot).select(F.col("id").alias("p"), F.ceil(F.col("f") / hot_pivot).alias("parts")), "hot")
    part = F.when(F.col("parts").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(*FRAGMENT), F.col("parts")))
    marked = looked_up(fragments(docs, words, held_words), hot, "p", F.struct(*FRAGMENT)).withColumn("part", part)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.select(*FRAGMENT, "n", "part").repartition(parts, "p", "part").sortWithinPartitions("p")
    kind = T.StructType([T.StructField(c, T.LongType()) for c in [*PHRASE, "n"]])
    mined = dealt.mapInArrow(lambda batches: _mine_batches(batches, least), kind)
    return mined.groupBy(*PHRASE).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- scores ---------------------------------------------------------------------------------------------------


def _key(names: list[str]) -> Column:
    """A part of a phrase, at most three words, as one value to join by."""
    return F.struct(*[(F.col(names[i]) if i < len(names) else F.lit(-1).cast("long")).alias(f"k{i}") for i in range(_SIDE)])


def _whole(n: Column) -> Column:
    return n.cast("decimal(20,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(w1 .. w4, a, l, r, score) of phrases (w1 .. w4, n): the cut with the lowest score, the first of equals.

    Every part of a phrase is a word or a phrase of the table. The joins are plain ones: parts of very many phrases are
    skewed keys, which adaptive execution splits. None is a broadcast: files of numbers are far smaller than the rows in
    memory that Spark takes them for.
    """
    single = words.select(_key(["id"]).alias("part"), F.col("f").alias("of"))
    known = single.unionByName(phrases.where("w4 < 0").select(_key(PHRASE[:3]).alias("part"), F.col("n").alias("of")))
    cuts = []
    for size in range(2, LONGEST + 1):
        own = (F.col(f"w{size}") >= 0) & (F.col(f"w{size + 1}") < 0 if size < LONGEST else F.lit(True))
        ways = F.array(*[F.struct(F.lit(k).alias("cut"), _key(PHRASE[:k]).alias("first"), _key(PHRASE[k:size]).alias("rest")) for k in range(1, size)])
        cuts.append(F.when(own, ways))
    listed = phrases.select(*PHRASE, F.col("n").alias("a"), F.inline(F.coalesce(*cuts)))
    listed = listed.join(known.select(F.col("part").alias("first"), F.col("of").alias("l")).hint("merge"), "first").join(known.select(F.col("part").alias("rest"), F.col("of").alias("r")).hint("merge"), "rest")
    score = (F.lit(SCALE).cast("decimal(10,0)") * _whole(F.col("a"))).alias("x"), (_whole(F.col("l")) + _whole(F.col("r"))).alias("y")
    listed = listed.select(*PHRASE, "a", "cut", "l", "r", *score).withColumn("score", F.expr("x div y"))
    best = listed.groupBy(*PHRASE).agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("best"))
    return best.select(*PHRASE, "best.a", "best.l", "best.r", "best.score")


def standing(phrases: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """phrases (w1 .. w4, a, ...) without those inside a longer one that has `percent` of their occurrences."""
    inside = []
    for size in range(3, LONGEST + 1):
        own = (F.col(f"w{size}") >= 0) & (F.col(f"w{size + 1}") < 0 if size < LONGEST else F.lit(True))
        inside.append(F.when(own, F.array(*[_key(PHRASE[i : i + n]) for n in range(2, size) for i in range(size - n + 1)])))
    longer = phrases.where("w3 >= 0").select(F.explode(F.coalesce(*inside)).alias("part"), "a").groupBy("part").agg(F.max("a").alias("longer"))
    own = F.when(F.col("w4") < 0, _key(PHRASE[:3]))
    met = phrases.withColumn("part", own).join(longer.hint("merge"), "part", "left")
    goes = _whole(F.col("longer")) * 100 >= _whole(F.col("a")) * percent
    return met.where(~F.coalesce(goes, F.lit(False))).drop("part", "longer")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each lang with their rank, over ever fewer parts, so no task sorts all rows of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in (int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4, 1):
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))) if parts > 1 else Window.partitionBy("lang")
        rows = rows.withColumn("rank", F.row_number().over(by.orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, least: int = LEAST, percent: int = INSIDE_PERCENT, top: int = TOP, held_words: int = HELD_WORDS, hot_pivot: int = HOT_PIVOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each language in docs (lang, text).

    Words are split by blanks and tabs inside pieces that punctuation and line feeds end; a phrase has two to four words
    of one piece and occurs `least` times. Null texts are empty, a null lang is 'und', texts are read whole, repeated
    rows count as often as they stand there, ties go by phrase. Extra columns are ignored; an empty table, or one without
    frequent phrases, gives an empty result.
    """
    counts = materialize(word_counts(docs), "word-counts")
    words = ordered_words(counts, least)
    phrases = materialize(phrase_counts(docs, words, least, held_words, hot_pivot), "phrases")
    kept = standing(scored(phrases, words), percent)
    for i, c in enumerate(PHRASE):
        text = words.select(F.col("id").alias(c), F.col("word").alias(f"t{i}"), *([F.col("lang")] if not i else []))
        kept = kept.join(text.hint("merge"), c, "left" if i > 1 else "inner")
    kept = kept.select("lang", F.concat_ws(" ", *[f"t{i}" for i in range(LONGEST)]).alias("phrase"), "a", "l", "r", "score")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return _first(kept, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by listing every run of words.
ORACLE_SQL = f"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, list_filter(string_split_regex(p, '[ \t]'), lambda x: x <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))
  WHERE len(words) > 0
), places AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, words[i : i + k - 1] AS g, count(*) AS f FROM places, (SELECT unnest([1, 2, 3, {LONGEST}]) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM grams WHERE len(g) = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM grams WHERE f >= {LEAST}
), candidates AS (
  SELECT * FROM frequent WHERE len(g) > 1
), cuts AS (
  SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM candidates
), parts AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, CAST(({SCALE}::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN frequent y ON y.lang = c.lang AND y.g = c.g[c.k + 1 :]
), best AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[i : i + n - 1] AS g, max(f) AS longer FROM (
    SELECT lang, g, f, n, unnest(range(1, len(g) - n + 2)) AS i FROM (SELECT lang, g, f, unnest(range(2, len(g))) AS n FROM candidates WHERE len(g) > 2))
  GROUP BY 1, 2
), kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100 * i.longer < {INSIDE_PERCENT} * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
