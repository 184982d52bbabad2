"""SimHash near-duplicates: 64-bit fingerprints compared by bit planes and carry-save counters.

A fingerprint bit is 1 where over half the XXH64 hashes of a text's 3-word shingles have it. Distinct
fingerprints meet in buckets that fix two of radius + 2 bands (any two fingerprints within the radius agree on at
least two bands, so no link is lost); inside a bucket, fingerprints lie as vertical bit planes and distances of many
lanes at a time rise in carry-save counters, a block being left once every lane is over the radius.

Where near-duplicates are dropped, fingerprints are longer (several words of 64 bits, each from other hashes of the
distinct 5-word shingles), so their distance tells the shared share of shingles; they meet wherever a word agrees in two bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import bounded_batches, looked_up, materialize, read_table, salted_left_join
from tidebook.llm.components import connected_components

#: Bits by which linked fingerprints of one word may differ.
RADIUS = 2
#: Where near-duplicates are dropped: words in a shingle, 64-bit words in a fingerprint, bands that each is cut into, and
#: bits by which linked ones may differ. A similarity of 0.8 has 29 of 192 bits differ on average, with a deviation of 5.
DROP_SHINGLE, DROP_WORDS, DROP_BANDS, DROP_RADIUS = 5, 3, 7, 33
#: Buckets with more distinct fingerprints are dealt again by two of radius + 2 bands of their open bits. What then
#: meets shares about 32 bits (radius 2) or 34 bits (radius 4).
HOT_BUCKET = 4096
#: The same where near-duplicates are dropped and a bucket's parts meet in pairs: fewer parts find fewer links twice.
DROP_HOT_BUCKET = 8192
#: Rows that a task gathers before it compares them.
GATHER = 1 << 16


def bands(radius: int, bits: int, start: int = 0) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 2 bands of nearly equal width."""
    n = radius + 2
    edges = [start + bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def fingerprint(text: str | None) -> int:
    """SimHash of one text: A-Z lower-cased, split at ASCII white space, 3-word shingles with repeats.

    Fewer than three words: the whole sequence is the one shingle. No word (or null): 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, counts = 0, np.zeros(64, np.int64)
    if len(words) < 3:
        shingles: Iterator[bytes] = iter((b" ".join(words),))
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    while True:
        part = np.fromiter(map(xxhash.xxh64_intdigest, (s for _, s in zip(range(65536), shingles)), repeat(42)), np.uint64)
        if not len(part):
            break
        n += len(part)
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes that fill a later word of a fingerprint: h, moved and mixed (constants of the SplitMix64 generator)."""
    h = h + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def long_fingerprint(text: str | None) -> list[int]:
    """DROP_WORDS words of SimHash over the distinct 5-word shingles of a text, words as in fingerprint().

    Fewer than five words: the whole sequence is the one shingle. No word (or null): all zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * DROP_WORDS
    shingles = map(b" ".join, zip(*[words[i:] for i in range(DROP_SHINGLE)])) if len(words) >= DROP_SHINGLE else iter((b" ".join(words),))
    hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))
    counts = np.zeros((DROP_WORDS, 64), np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        for w in range(DROP_WORDS):
            h = _mixed(part, w) if w else part
            counts[w] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return [int.from_bytes(row.tobytes(), "big") for row in np.packbits(counts * 2 > len(hashes), axis=1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([_signed(fingerprint(t.as_py())) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One row out for each row in; nulls and empty texts give 0."""
    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _long_column(texts: pa.Array) -> pa.Array:
    found = np.array([long_fingerprint(t.as_py()) for t in texts], np.uint64).reshape(-1, DROP_WORDS).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(found.T)], LONG_FP.names)


def _long_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _long_column(b.column(1))], ["doc_id", "fp"])


LONG_FP = T.StructType([T.StructField(f"w{i}", T.LongType()) for i in range(DROP_WORDS)])


def long_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is a struct of DROP_WORDS signed longs. One row out for each row in."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_long_batches, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", LONG_FP)]))


# --- comparison inside a bucket ------------------------------------------------------------------------------


def _bit_rows(fps: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint; one of several words is a row of fps."""
    return np.unpackbits(np.ascontiguousarray(fps.reshape(len(fps), -1)).astype(">u8").view(np.uint8), axis=1)


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical store: row b holds bit b of every fingerprint, packed eight lanes to a byte."""
    return np.packbits(_bit_rows(fps), axis=0).T.copy()


def _against(store: np.ndarray, lag: int, lanes: int) -> Iterator[np.ndarray]:
    """For each plane, where lane i differs from lane i + lag: the plane moved by lag bits, over itself."""
    size, (byte, bit) = (lanes + 7) // 8, divmod(lag, 8)
    for p in store:
        q = p[byte : byte + size + 1]
        if bit:
            q = (q << bit) | (np.append(q[1:], np.uint8(0)) >> (8 - bit))
        yield p[:size] ^ q[:size]


def lanes_within(diff: Iterator[np.ndarray], width: int, done: np.ndarray | None = None, radius: int = RADIUS) -> np.ndarray:
    """Which lanes differ in at most `radius` planes. diff yields one packed row per bit plane.

    The counters of each lane are bit planes as well: a difference is added as a carry through them. over is sticky
    from the first difference beyond the radius on. The block is abandoned as soon as every lane is over.
    """
    size, beyond = (width + 7) // 8, radius + 1
    counter, over = [np.zeros(size, np.uint8) for _ in range(beyond.bit_length())], np.zeros(size, np.uint8)
    if done is not None:
        over |= done
    if width % 8:
        over[-1] |= 0xFF >> (width % 8)
    for i, d in enumerate(diff):
        carry, full = d, None
        for k, c in enumerate(counter):
            out = c & carry
            c ^= carry
            carry = out
            same = c if beyond >> k & 1 else ~c
            full = same if full is None else full & same
        over |= full
        if i % 4 == 3 and (over == 0xFF).all():
            break
    return np.unpackbits(~over)[:width].astype(bool)


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join each component of one bucket, all to its first fingerprint: breadth-first, each fingerprint is the query once.

    A component that meets in many buckets gets the same links from most of them, so few are left once equal ones go.
    """
    n = len(fps)
    store, full = planes(fps), np.array([0, 0xFF], np.uint8)
    bits = _bit_rows(fps)
    seen, links = np.zeros(n, bool), []
    for start in range(n):
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            q = todo.pop()
            near = lanes_within((p ^ full[b] for p, b in zip(store, bits[q])), n, np.packbits(seen), radius) & ~seen
            for j in np.nonzero(near)[0]:
                links.append((start, int(j)))
                todo.append(int(j))
            seen |= near
    return links


#: Groups of up to this many fingerprints are compared all at once over what a task has gathered.
SMALL = 32


def _links_of(groups: np.ndarray, names: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links as names. groups: a number per row, ascending. fps (a row for each name) are distinct within a group.

    Small groups of like size lie in one vertical store, which is compared with itself at every lag.
    """
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    sizes = np.diff(edge)
    src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    size_of = np.repeat(sizes, sizes)
    top = 2
    while top <= SMALL:
        at = np.flatnonzero((size_of > top // 2) & (size_of <= top))
        own, store = groups[at], planes(fps[at]) if len(at) else None
        for lag in range(1, min(top, len(at))):
            same = own[lag:] == own[:-lag]
            hit = np.flatnonzero(lanes_within(_against(store, lag, len(same)), len(same), np.packbits(~same), radius))
            src.append(names[at[hit]])
            dst.append(names[at[hit + lag]])
        top *= 2
    for g in np.flatnonzero(sizes > SMALL):
        own = edge[g] + np.argsort(names[edge[g] : edge[g + 1]], kind="stable")  # the first of a component is the same in all buckets
        if links := spanning_links(fps[own], radius):
            pairs = np.array(links)
            src.append(names[own][pairs[:, 0]])
            dst.append(names[own][pairs[:, 1]])
    return _stars(np.concatenate(src), np.concatenate(dst))


def _stars(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same components as the given ones: each node with the smallest of its component, once."""
    nodes, at = np.unique(np.r_[src, dst], return_inverse=True)
    a, b, label = at[: len(src)], at[len(src) :], np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[some]], nodes[some]


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int, words: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (k, sub, name, words of the fingerprint; one word may be the name itself) sorted by k and sub.

    Rows are gathered over batches; the last group waits for the rest of it, and the longer it is the longer.
    """
    waiting: list[np.ndarray] = []
    held, enough = 0, GATHER

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
        a, b = _links_of(np.cumsum(new), rows[:, 2], rows[:, -words:].copy().view(np.uint64), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
        held += b.num_rows
        if held < enough:
            continue
        rows = np.concatenate(waiting)
        last = np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(1))[0]
        yield from out(rows[:last])
        waiting, held = [rows[last:]], len(rows) - last
        enough = max(GATHER, 2 * held)
    if waiting:
        yield from out(np.concatenate(waiting))


def _bits(pieces: list[tuple[int, int]], fp: str = "fp") -> Column:
    """The given (first bit, width) pieces of fp, side by side."""
    out, shift = F.lit(0).cast("long"), 0
    for first, width in pieces:
        out = out + F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")) * F.lit(1 << shift).cast("long")
        shift += width
    return out


def _keys(cut: list[list[tuple[int, int]]], fp: str = "fp", first: int = 0) -> Column:
    """A key for each two of the bands; a band is a list of pieces, and the pair's number, counted from first, is on top."""
    return F.array(*[F.lit(c << 48).cast("long") + _bits([*cut[i], *cut[j]], fp) for c, (i, j) in enumerate(combinations(range(len(cut)), 2), first)])


def _cut_open(open_bits: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """The open bits, which need not lie together, cut into n bands of nearly equal width."""
    bits = [first + i for first, width in open_bits for i in range(width)]
    edges = [len(bits) * i // n for i in range(n + 1)]
    out = []
    for a, b in zip(edges, edges[1:]):
        pieces: list[tuple[int, int]] = []
        for bit in bits[a:b]:
            if pieces and sum(pieces[-1]) == bit:
                pieces[-1] = (pieces[-1][0], pieces[-1][1] + 1)
            else:
                pieces.append((bit, 1))
        out.append(pieces)
    return out


def _sub_keys(radius: int) -> Column:
    """Keys from two bands of the bits that a bucket leaves open; the bucket's number tells which those are."""
    own, out = bands(radius, 64), None
    for c, (i, j) in enumerate(combinations(range(len(own)), 2)):
        hit, keys = F.shiftright("k", 48) == c, _keys(_cut_open([b for x, b in enumerate(own) if x not in (i, j)], radius + 2))
        out = F.when(hit, keys) if out is None else out.when(hit, keys)
    return out


def fingerprint_links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET, radius: int = RADIUS) -> DataFrame:
    """Distinct fp -> (src, dst) links within `radius` bits that join all components (not all pairs)."""
    keyed = distinct.select("fp", F.explode(_keys([[b] for b in bands(radius, 64)])).alias("k"))
    sizes = materialize(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket), "hot")  # few: each has over hot_bucket fingerprints
    marked = looked_up(keyed, sizes, "k", F.col("fp"))
    sub = F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(_sub_keys(radius))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.select("k", F.explode(sub).alias("sub"), "fp").repartition(parts, "k", "sub").sortWithinPartitions("k", "sub", "fp")
    return dealt.mapInArrow(lambda batches: _link_batches(batches, radius), "src long, dst long")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of the fingerprints in rows (doc_id, fp) that more than one row reaches."""
    seen = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(fingerprint_links(seen.select("fp"), radius=radius))
    of = seen.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    shared = of.where("linked or n > 1")
    names = shared.groupBy("root").agg(F.min("first").alias("component_id"))
    return salted_left_join(shared.select("fp", "root"), names, "root", F.col("fp")).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable.

    Texts that are null or hold no word have fingerprint zero and are linked by it. Rows whose doc_id is null
    are kept and take part as members but never name a component (null only where no member has an id).
    Repeated rows each get a row. Extra columns are ignored. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs), "fp")
    named = _components(rows, radius).select("fp", "component_id")
    return salted_left_join(rows, named, "fp", F.col("doc_id")).select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def long_links(classes: DataFrame, hot_bucket: int = DROP_HOT_BUCKET) -> DataFrame:
    """Distinct (node, fp) -> (src, dst) nodes: links that join all components of the long fingerprints.

    Two are linked where some word agrees in two of its DROP_BANDS bands and at most DROP_RADIUS bits differ in all. The
    rows of a bucket with over hot_bucket fingerprints are dealt into parts, and any two parts meet in a group of their
    own, so every pair of a bucket is compared at any size.
    """
    cut = [[b] for b in bands(DROP_BANDS - 2, 64)]
    pairs = len(cut) * (len(cut) - 1) // 2
    keys = F.flatten(F.array(*[_keys(cut, f"fp.{name}", i * pairs) for i, name in enumerate(LONG_FP.names)]))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = classes.repartition(parts, "node").select("node", "fp", F.explode(keys).alias("k"))  # narrow rows become many, so they are spread first
    sizes = materialize(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket), "hot")
    marked = looked_up(keyed, sizes, "k", F.col("node"))
    n_parts = F.ceil(F.col("n") / hot_bucket)
    part = F.pmod(F.xxhash64("node"), n_parts)
    met = F.transform(F.sequence(F.lit(0).cast("long"), n_parts - 1), lambda q: F.shiftleft(F.least(part, q), 32) + F.greatest(part, q))
    sub = F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(met)
    dealt = marked.select("k", F.explode(sub).alias("sub"), "node", "fp.*").repartition(parts, "k", "sub").sortWithinPartitions("k", "sub")
    return dealt.mapInArrow(lambda batches: _link_batches(batches, DROP_RADIUS, DROP_WORDS), "src long, dst long")


def _long_components(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the long fingerprints in rows (doc_id, fp) that more than one row reaches."""
    seen = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = materialize(seen.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = connected_components(long_links(seen.select("node", "fp")))
    of = seen.join(roots, "node", "left").select("fp", "first", "n", "node", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked"))
    shared = of.where("linked or n > 1")
    names = shared.groupBy("root").agg(F.min("first").alias("component_id"))
    return salted_left_join(shared.select("fp", "node", "root"), names, "root", F.col("node")).select("fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component of long_links the row with the smallest doc_id stays, once.

    Texts that are null or hold no word are one component. Of a component whose rows have no id, one stays. Rows of one
    doc_id with different texts are different rows. All columns, whatever their names, and texts are left as they are.
    """
    rows = materialize(long_fingerprints(docs), "fp")
    shared = materialize(_long_components(rows), "components")
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():  # ids name rows, so texts need not be hashed again
        gone = looked_up(rows, shared, "fp", F.col("doc_id"), how="inner").where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    carried, at = bounded_batches(docs).select(F.struct(*docs.columns).alias("row")), docs.columns.index("text")
    hashed = lambda batches: (pa.RecordBatch.from_arrays([b.column(0), _long_column(b.column(0).field(at).cast(pa.string()))], ["row", "fp"]) for b in batches)  # noqa: E731  the text goes to Python once, in its row
    with_fp = carried.mapInArrow(hashed, T.StructType([carried.schema["row"], T.StructField("fp", LONG_FP)]))
    all_rows = looked_up(with_fp, shared, "fp", F.col("row.doc_id"))
    name, own = F.coalesce("component_id", "row.doc_id"), F.col("row.doc_id")
    first = all_rows.where(own.eqNullSafe(name)).select("root", F.when(F.col("root").isNull(), F.col("fp")).alias("single"), "row")
    return first.groupBy("root", "single").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
