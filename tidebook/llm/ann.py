"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes, reranked with the vectors.

Vectors are lifted to one length (a last coordinate fills them up to the largest norm), so the largest inner product is
the smallest angle. Principal axes turned by learned rotations, which bring the signs close to the values, give BITS
bits. A code is cut into substrings of 16 bits, each with an index of its own: buckets by the substring's value, dealt
over the cluster by its first bits. Codes within a radius share some substring up to a fraction of it (pigeonhole), so a
query probes the buckets of near values only and finds every code within the radius, each at the first substring
that qualifies. What it finds is ranked by the vectors themselves. The radius is learned: on a bounded sample of
queries, compared with all rows in blocks, it takes in TARGET of their true neighbours. Queries that find too few
rows ask again with twice the radius, in the end with all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import looked_up, materialize, read_table, salted_left_join

#: Neighbours returned, and which rows are queries: those whose vec_id this number divides.
NEIGHBOURS, QUERY_STEP = 20, 20
#: Bits of a code and of a substring.
BITS, SUB = 128, 16
SUBSTRINGS = BITS // SUB
#: Rows that the rotations are learned from at most, and queries that the radius is learned from at most.
FIT_ROWS, FIT_QUERIES = 4096, 256
#: Share of the sampled queries' true neighbours that the radius takes in.
TARGET = 0.98
#: Points of a block on average, queries that meet a block in one task at most, and first bits of a substring that deal at most.
BLOCK, QUERIES_AT_ONCE, MOST_SLICE_BITS = 16_384, 16_384, 12
#: A query's blocks are merged in so many parts first.
MERGES = 64
#: Query and point pairs that a task looks at at a time.
PAIRS_AT_ONCE = 1 << 20
ROUNDS = 30


# --- codes ----------------------------------------------------------------------------------------------------


class Codes:
    """What turns vectors of one length into codes: the largest norm, a centre and BITS directions."""

    def __init__(self, sample: np.ndarray, norm: float, seed: int = 11):
        self.norm = norm
        lifted = self.lifted(sample)
        self.centre = lifted.mean(0)
        x, rng = lifted - self.centre, np.random.default_rng(seed)
        _, vectors = np.linalg.eigh(x.T @ x)
        axes = vectors[:, ::-1][:, : min(x.shape[1], 64)]
        parts, n = [], 0
        while n < BITS:
            parts.append(axes @ self._rotation(x @ axes, rng))
            n += axes.shape[1]
        self.directions = np.concatenate(parts, axis=1)[:, :BITS]

    @staticmethod
    def _rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
        """The rotation that iterative quantisation ends at: signs for the turned points, then the best turn for the signs."""
        turn = np.linalg.qr(rng.normal(size=(x.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
            turn = (u @ v).T
        return turn

    def lifted(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        """Unit vectors with one more coordinate: points are filled up to the largest norm, queries have only a direction."""
        square = np.einsum("ij,ij->i", x, x)
        if queries:
            return np.c_[x / np.sqrt(square)[:, None], np.zeros(len(x))]
        return np.c_[x / self.norm, np.sqrt(np.maximum(0, 1 - square / self.norm**2))]

    def of(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        """Codes as rows of BITS / 64 words."""
        bits = (self.lifted(x, queries) - self.centre) @ self.directions > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def substrings(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view("<u2")


def radii(radius: int) -> np.ndarray:
    """Radius of each substring: two codes within `radius` bits are within it in at least one; -1 is never probed."""
    each, rest = divmod(radius, SUBSTRINGS)
    return np.array([min(SUB, each if j <= rest else each - 1) for j in range(SUBSTRINGS)])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _first(group: np.ndarray, most: int, *order: np.ndarray) -> np.ndarray:
    """Places of the first `most` of each group by the given order, the main one first."""
    at = np.lexsort([*reversed(order), group])
    own = group[at]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, int)
    return at[np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)])) < most]


# --- the learned radius ---------------------------------------------------------------------------------------


def _learned_radius(points: DataFrame, queries: DataFrame, codes: Codes, k: int) -> int:
    """The Hamming radius that takes in TARGET of the true neighbours of at most FIT_QUERIES queries, which meet all rows in blocks."""
    sample = queries.orderBy(F.xxhash64("vk"), "vk").limit(FIT_QUERIES).select("vk", "vec").toArrow()
    names, vectors = sample.column("vk").to_numpy(), _matrix(sample.column("vec"))
    own = codes.of(vectors, queries=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        for b in batches:
            if not b.num_rows:
                continue
            x, vk = _matrix(b.column(1)), b.column(0).to_numpy()
            score = vectors @ x.T
            score[names[:, None] == vk[None]] = -np.inf
            at = np.argpartition(-score, min(k, len(vk)) - 1, axis=1)[:, :k]
            q = np.arange(len(names)).repeat(at.shape[1])
            at = at.ravel()
            far = np.bitwise_count(own[q] ^ codes.of(x)[at]).sum(1).astype(np.int64)
            new = [q, score[q, at], vk[at], far]
            best = [np.concatenate(c) for c in zip(best, new)]
            keep = _first(best[0], k, -best[1], best[2])
            best = [c[keep] for c in best]
        some = np.isfinite(best[1])
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in best], ["q", "score", "vk", "far"])

    found = points.select("vk", "vec").mapInArrow(run, "q long, score double, vk long, far long")
    true = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vk"))).where(F.col("n") <= k)
    far = np.sort([r["far"] for r in true.select("far").collect()])  # at most FIT_QUERIES x k numbers
    return int(far[int(np.ceil(TARGET * len(far))) - 1]) if len(far) else BITS


# --- the index ------------------------------------------------------------------------------------------------


def _slices(rows: DataFrame, bits: int) -> np.ndarray:
    """How many rows (c0, c1) have each leading part of each substring: SUBSTRINGS x 2**bits counts, a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((SUBSTRINGS, 1 << bits), np.int64)
        for b in batches:
            for j, own in enumerate(substrings(_codes_of(b)).T >> (SUB - bits)):
                count[j] += np.bincount(own, minlength=1 << bits)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()[at])], ["at", "n"])

    out = np.zeros(SUBSTRINGS << bits, np.int64)
    for r in rows.select("c0", "c1").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(SUBSTRINGS, -1)


def _codes_of(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b.column("c0").to_numpy(), b.column("c1").to_numpy()], axis=1).view("<u8")


def _dealt(rows: DataFrame, kind: str, bits: int, near: np.ndarray | None, parts: np.ndarray, chunks: np.ndarray) -> DataFrame:
    """rows with the groups they go to. Points go to their slice of each substring (one part, all chunks of queries);
    queries, where near holds each substring's radius, to all slices near theirs (all parts, one chunk)."""
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vk, own = b.column("vk").to_numpy(), substrings(_codes_of(b)) >> (SUB - bits)
            spread = (vk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for j in range(SUBSTRINGS):
                if near is None:
                    row, part_slice = np.arange(len(vk)), own[:, j].astype(np.int64)
                    copies = chunks[j, part_slice]
                else:
                    row, part_slice = np.nonzero(np.bitwise_count(own[:, j, None] ^ np.arange(1 << bits, dtype=np.uint16)) <= near[j]) if near[j] >= 0 else (np.empty(0, int),) * 2
                    copies = parts[j, part_slice]
                each = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                row, part_slice = row.repeat(copies), part_slice.repeat(copies)
                fixed = spread[row] % (parts if near is None else chunks)[j, part_slice]
                part, chunk = (fixed, each) if near is None else (each, fixed)
                for at in range(0, len(row), 8192):
                    s = slice(at, at + 8192)
                    group = [np.full(len(row[s]), j, np.int32), *(c[s].astype(np.int32) for c in (part_slice, part, chunk))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, group), *(c.take(pa.array(row[s])) for c in b.columns)], ["j", "slice", "part", "chunk", *names])

    return rows.mapInArrow(run, f"j int, slice int, part int, chunk int, {kind}")


def probed(points: pa.Table, queries: pa.Table, j: int, radius: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vec_id, score) of the best `most` entries of each query among the points of one block of index j.

    Points have columns c0, c1, vec and ids (ascending), queries c0, c1 and vec. Buckets of the block's values of the
    substring are probed within its radius; a point within the whole radius counts where no earlier substring finds it.
    """
    each, px, qx = radii(radius), _codes_of(points), _codes_of(queries)
    ps, qs, pv, qv = substrings(px), substrings(qx), _matrix(points.column("vec")), _matrix(queries.column("vec"))
    lists = points.column("ids").combine_chunks()
    first, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    ids = lists.values.to_numpy()
    order = np.argsort(ps[:, j], kind="stable")
    values, bucket = np.unique(ps[order, j], return_index=True)
    filled = np.diff(np.r_[bucket, len(order)])
    out: list[list[np.ndarray]] = [[], [], []]
    step = max(1, PAIRS_AT_ONCE // max(1, len(order)))
    for at in range(0, len(qx), step):
        q, v = np.nonzero(np.bitwise_count(qs[at : at + step, j, None] ^ values) <= each[j])
        n = filled[v]
        x = order[np.repeat(bucket[v] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        q = q.repeat(n) + at
        ok = np.bitwise_count(qx[q] ^ px[x]).sum(1) <= radius
        q, x = q[ok], x[ok]
        if j:
            new = ~(np.bitwise_count(qs[q, :j] ^ ps[x, :j]) <= each[:j]).any(1)
            q, x = q[new], x[new]
        score = np.concatenate([np.einsum("ij,ij->i", qv[q[s : s + 65_536]], pv[x[s : s + 65_536]]) for s in range(0, len(q), 65_536)] or [np.empty(0)])
        keep = _first(q, most, -score, ids[first[x]] if len(x) else x)
        q, x, score = q[keep], x[keep], score[keep]
        n = sizes[x]
        entry = np.repeat(first[x] - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, score, own = q.repeat(n), score.repeat(n), ids[entry]
        keep = _first(q, most, -score, own)
        for column, found in zip(out, (q, own, score)):
            column.append(found[keep])
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)


ENTRIES = "array<struct<less: double, vec_id: bigint>>"


def _merged(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """rows (by, found) with one list for each key: the first `most` entries of its lists."""
    return rows.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, most).alias("found"))


def _round(points: DataFrame, queries: DataFrame, n: int, radius: int, most: int) -> DataFrame:
    """(vk, found): the best `most` entries (less: minus the score) of each query among points whose codes lie within the radius."""
    bits = min(MOST_SLICE_BITS, max(0, int(np.ceil(np.log2(max(1, n) / BLOCK)))))
    near = radii(radius)
    held, asked = _slices(points, bits), _slices(queries, bits)
    place = np.arange(1 << bits, dtype=np.uint16)
    reach = lambda j: np.concatenate([(np.bitwise_count(place[i : i + 256, None] ^ place) <= near[j]) @ asked[j] for i in range(0, len(place), 256)])
    arriving = np.stack([reach(j) if near[j] >= 0 else 0 * asked[j] for j in range(SUBSTRINGS)])
    parts = np.maximum(1, -(-held // (2 * BLOCK)))
    chunks = -(-arriving // QUERIES_AT_ONCE)  # none where no query comes
    kind = points.schema["vec"].dataType.simpleString()
    by = ["j", "slice", "part", "chunk"]
    left = _dealt(points.select("vk", "c0", "c1", "vec", "ids"), f"vk long, c0 long, c1 long, vec {kind}, ids array<bigint>", bits, None, parts, chunks)
    right = _dealt(queries.select("vk", "c0", "c1", "vec"), f"vk long, c0 long, c1 long, vec {kind}", bits, near, parts, chunks)

    def meet(own: pa.Table, ask: pa.Table) -> pa.Table:
        if not own.num_rows or not ask.num_rows:
            q, vec_id, score = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        else:
            q, vec_id, score = probed(own, ask, own.column("j")[0].as_py(), radius, most)
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        entries = pa.StructArray.from_arrays([pa.array(-score), pa.array(vec_id)], ["less", "vec_id"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(q)].astype(np.int32)), entries)
        vk = ask.column("vk").to_numpy()[q[first]] if len(q) else np.empty(0, np.int64)
        part = (own if own.num_rows else ask).select(["slice", "part"]).slice(0, 1).to_pylist()
        return pa.table({"vk": pa.array(vk), "merge": pa.array(np.full(len(vk), (part[0]["slice"] + part[0]["part"]) % MERGES if part else 0), pa.int32()), "found": lists})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"vk long, merge int, found {ENTRIES}")
    return _merged(_merged(found, ["vk", "merge"], most), ["vk"], most)


def _nearest_of_length(points: DataFrame, norm: float, n: int, entries: int, k: int) -> DataFrame | None:
    """(vk, found): for each query point of one vector length its best k + 1 entries, nearest first."""
    sample = points.orderBy(F.xxhash64("vk"), "vk").limit(FIT_ROWS).select("vec").toArrow()
    codes, kind = Codes(_matrix(sample.column("vec")), norm), points.schema["vec"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"))
            c, q = codes.of(x).view("<i8"), codes.of(x, queries=True).view("<i8")
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(w)) for w in (*c.T, *q.T))], [*b.schema.names, "c0", "c1", "q0", "q1"])

    made = points.select("vk", "vec", "ids", "asks").mapInArrow(coded, f"vk long, vec {kind}, ids array<bigint>, asks boolean, c0 long, c1 long, q0 long, q1 long")
    made = materialize(made, "codes")
    queries = made.where("asks").select("vk", "vec", F.col("q0").alias("c0"), F.col("q1").alias("c1"))
    if queries.isEmpty():
        return None
    radius, most, out = _learned_radius(made, queries, codes, k), min(k + 1, entries), None
    for _ in range(ROUNDS):
        radius = min(radius, BITS)
        found = materialize(_round(made, queries, n, radius, most), "nearest")
        full = found.where(F.size("found") >= most)
        out = full if out is None else out.unionByName(full)
        queries = queries.join(full.select("vk"), "vk", "left_anti")
        if radius >= BITS or queries.isEmpty():
            return out
        queries, radius = materialize(queries, "asked"), 2 * radius + 1
    raise RuntimeError("the radius did not reach all bits")


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id that `step` divides its k nearest rows, nearest first, ties to smaller ids.

    Nearness is the inner product of the vectors in double precision. Null and zero vectors, those with null or
    non-finite components and rows with a null vec_id take no part; vectors of different lengths are not compared.
    Equal vectors are one point of the index with its k + 1 smallest ids, which is all that any query can return. Equal
    rows count once; of one id with several vectors the one with the least hash counts. A query has fewer than k rows only where there are fewer candidates. Extra columns are ignored; an
    empty table gives an empty result. The rotations and the radius are learned on bounded samples (FIT_ROWS,
    FIT_QUERIES), everything else covers all rows.
    """
    e = F.col("embedding")
    square = F.aggregate(e.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    sound = F.coalesce((square > 0) & (square < float("inf")), F.lit(False)) & F.col("vec_id").isNotNull()
    key = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), e).alias("b"))
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("vec"), key.alias("key"), square.alias("square"))
    pairs = rows.groupBy("vec_id").agg(F.min("key").alias("key"))
    least = pairs.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = least.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    own = rows.groupBy("key").agg(F.min("vec").alias("vec"), F.max("square").alias("square"), F.max(F.col("vec_id") % step == 0).alias("asks"))
    points = materialize(own.join(ids, "key").withColumn("vk", F.monotonically_increasing_id()), "points")
    asking = looked_up(pairs.where(F.col("vec_id") % step == 0), points.where("asks").select("key", "vk"), "key", F.col("vec_id"), how="inner").select("vec_id", "vk")
    found = None
    sizes = points.groupBy(F.size("vec").alias("size")).agg(F.max("square").alias("square"), F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("entries"))
    for r in sorted(sizes.collect()):  # one round for each vector length
        part = _nearest_of_length(points.where(F.size("vec") == r["size"]), float(np.sqrt(r["square"])), r["n"], r["entries"], k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return asking.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where(F.lit(False))
    met = salted_left_join(asking.withColumnRenamed("vec_id", "query_id"), found, "vk", F.col("query_id"), how="inner")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return met.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
