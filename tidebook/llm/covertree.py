"""Exact embedding near-duplicates by dual traversal of cover trees.

Equal vectors are one point with a multiplicity. Points are dealt to cells around pivots, cells to blocks of bounded
size. Each block becomes a cover tree of nested levels with halving radii, which is filed in the shared folder once.
Pairs of blocks that covering-radius and bisector bounds cannot rule out are dealt over tasks as pairs of file names,
so no vector travels more than once, and a task holds the trees of a few blocks. Two trees are walked at once: a pair
of nodes is dropped when their distance exceeds both radii and the threshold, taken whole when even the farthest
points are linked, and opened otherwise. Pairs of points near the threshold are decided by the cosine in double precision.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import filesystem, looked_up, materialize, read_table, salted_left_join, scratch_path
from tidebook.llm.components import connected_components

COSINE = 0.95
#: Points in a block at most on average.
BLOCK = 4096
#: A task compares so many blocks with as many others at most, fewer where those of a side take more bytes.
TILE, TILE_BYTES = 8, 32 << 20
#: Pivots at most; beyond this many blocks a cell is split by hash, which is exact as well.
MOST_PIVOTS = 1024
TOP_RADIUS, LEVELS = 2.0, 7
#: Slack of bounds in single precision, in squared distance.
SLACK = 1e-4
#: Slack of bounds in double precision, in squared distance; a distance near zero is off by the root of its noise.
NOISE = 1e-6
#: Node pairs that are opened at a time, and components of vectors that are gathered for it at a time.
PAIRS_AT_ONCE, NUMBERS_AT_ONCE = 1 << 20, 1 << 22
#: Points that are compared with all pivots at a time.
POINTS_AT_ONCE = 1024
#: Tasks that pairs of blocks are dealt over at most.
MOST_TASKS = 10_000


# --- trees ----------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Points in depth-first order; each level's nodes cover consecutive points [low, high) around one of them.

    The children of a node are nodes of the next level; levels where no node splits are left out. The last level
    is the points themselves, and a node of one point is as good as that point at any level.
    """

    points: np.ndarray  # unit vectors, double
    order: np.ndarray  # place in the input of each point
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # centre, low, high, radius

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node of a level, and one past the last, as places in the next level."""
        _, low, high, _ = self.levels[level]
        below = self.levels[level + 1][1]
        return np.searchsorted(below, low), np.searchsorted(below, high)


def _net(points: np.ndarray, centres: np.ndarray, radius: float) -> np.ndarray:
    """For each point the centre that covers it. The given centres stay, and points that none of them covers become
    centres greedily in order, so that no two centres of the level are within the radius."""
    n = len(points)
    single = points.astype(np.float32)
    owner = np.full(n, -1)
    owner[centres] = centres
    left = np.flatnonzero(owner < 0)
    least = np.float32(1 - radius * radius / 2)  # cosine at the radius
    for at in range(0, len(left), 1024):
        part = left[at : at + 1024]
        cos = single[part] @ single[centres].T
        best = cos.argmax(1)
        hit = cos[np.arange(len(part)), best] >= least
        owner[part[hit]] = centres[best[hit]]
    left = left[owner[left] < 0]
    while len(left):
        head = left[:256]
        near = single[head] @ single[left].T >= least
        for i in range(len(head)):
            if owner[head[i]] < 0:
                hit = left[near[i]]
                owner[hit[owner[hit] < 0]] = head[i]
                owner[head[i]] = head[i]
        left = left[owner[left] < 0]
    return owner


def covers(points: np.ndarray) -> list[np.ndarray]:
    """For each level, from the coarsest, the centre that covers each point; every centre is one of all finer levels.

    The centres of a level are more than its radius apart, over the whole level, and cover every point within it. A
    centre's parent is the centre that covers it one level up. Ends where all points are centres or radii are least.
    """
    n = len(points)
    cover, radius = np.zeros(n, int), TOP_RADIUS
    found = [cover]
    for _ in range(LEVELS):
        radius /= 2
        centres = np.flatnonzero(cover == np.arange(n))
        if len(centres) == n:
            break
        cover = _net(points, centres, radius)
        found.append(cover)
    return found


def build(points: np.ndarray) -> Tree:
    """A cover tree of unit vectors: one net of radius 1, 1/2, 1/4 ... over all points for each level, each in the next.

    A node holds the points whose chain of covering centres passes through it; the radius kept with a node is the
    largest distance to its centre that occurs. Levels that split no node are left out.
    """
    n = len(points)
    chain = np.arange(n)
    chains = [chain]
    for cover in reversed(covers(points)):
        chain = cover[chain]
        if (chain != chains[-1]).any():
            chains.append(chain)
    order = np.lexsort(chains)  # the coarsest level counts most
    at = np.empty(n, int)
    at[order] = np.arange(n)
    sorted_points = points[order]
    levels = []
    for chain in reversed(chains):
        own = chain[order]
        low = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if n else np.empty(0, int)
        high = np.r_[low[1:], n].astype(int)
        centre = at[own[low]]
        cos = np.einsum("ij,ij->i", sorted_points, sorted_points[np.repeat(centre, high - low)])
        far = np.sqrt(np.maximum(0, 2 - 2 * cos) + SLACK * (high - low > 1).repeat(high - low))
        levels.append((centre, low, high, np.where(high - low > 1, np.maximum.reduceat(far, low), 0.0) if n else np.empty(0)))
    return Tree(sorted_points, order, levels)


class Links:
    """What the traversal finds: links of each point (weighted), and sets of points that hang together."""

    def __init__(self, n: int):
        self.count = np.zeros(n + 1, np.int64)
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union of many pairs: the larger root points at the smaller until all agree."""
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))


def traverse(left: Tree, right: Tree, weights: tuple[np.ndarray, np.ndarray], cosine: float, same: bool) -> Links:
    """Links between the points of two trees, or within one (same). Points of right follow those of left.

    weights: how many equal vectors each point stands for, in the order of the trees.
    """
    n = len(left.points)
    shift = 0 if same else n
    links = Links(n if same else n + len(right.points))
    if not n or not len(right.points):
        return links
    reach = float(np.sqrt(2 - 2 * cosine))
    sums = [np.r_[0, np.cumsum(w)] for w in weights]
    single = (left.points.astype(np.float32), right.points.astype(np.float32))
    last = len(left.levels) - 1, len(right.levels) - 1

    def settle(la: int, lb: int, a: np.ndarray, b: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drops or takes whole what bounds decide; returns the pairs to open."""
        (_, alo, ahi, ar), (_, blo, bhi, br) = left.levels[la], right.levels[lb]
        radii = ar[a] + br[b]
        near = squared <= (radii + reach) ** 2 + SLACK
        a, b, squared, radii = a[near], b[near], squared[near], radii[near]
        alone = (ahi[a] - alo[a] == 1) & (bhi[b] - blo[b] == 1)
        if alone.any():  # two points: the cosine itself decides
            i, j = alo[a[alone]], blo[b[alone]]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            hit = _dots(left.points, i, right.points, j) >= cosine
            i, j = i[hit], j[hit]
            np.add.at(links.count, i, weights[1][j])
            np.add.at(links.count, j + shift, weights[0][i])
            links.join(i, j + shift)
            a, b, squared, radii = a[~alone], b[~alone], squared[~alone], radii[~alone]
        whole = (np.sqrt(np.maximum(squared, 0)) + radii + SLACK**0.5 <= reach) & ~(same & (a == b) & (la == lb))
        for i, j in zip(a[whole], b[whole]):
            if same and la == lb and i > j:
                continue
            p, q, r, s = alo[i], ahi[i], blo[j], bhi[j]
            links.count[p:q] += sums[1][s] - sums[1][r]
            links.count[r + shift : s + shift] += sums[0][q] - sums[0][p]
            links.join(np.r_[np.arange(p, q), np.full(s - r, p)], np.r_[np.full(q - p, r + shift), np.arange(r + shift, s + shift)])
        return a[~whole], b[~whole]

    todo = [(0, 0, np.zeros(1, int), np.zeros(1, int))]
    while todo:
        la, lb, a, b = todo.pop()
        # both sides go down together; the side that is at its points waits for the other
        na, nb = min(la + 1, last[0]), min(lb + 1, last[1])
        if (la, lb) == (na, nb):
            settle(la, lb, a, b, _squared(single, left.levels[la][0][a], right.levels[lb][0][b]))
            continue
        af, at = left.children(la) if na > la else (np.arange(len(left.levels[la][0])), np.arange(len(left.levels[la][0])) + 1)
        bf, bt = right.children(lb) if nb > lb else (np.arange(len(right.levels[lb][0])), np.arange(len(right.levels[lb][0])) + 1)
        wide = (at[a] - af[a]) * (bt[b] - bf[b])
        for i, j in zip(a[wide > 4096], b[wide > 4096]):  # many children on both sides: one matrix product
            ra, rb = left.levels[na][3], right.levels[nb][3]
            for rows, cols in product(_by_width(af[i], at[i], ra), _by_width(bf[j], bt[j], rb)):
                y = single[1][right.levels[nb][0][cols]]
                for k in range(0, len(rows), max(1, PAIRS_AT_ONCE // len(cols))):
                    part = rows[k : k + max(1, PAIRS_AT_ONCE // len(cols))]
                    cos = single[0][left.levels[na][0][part]] @ y.T
                    if ra[part[0]] or rb[cols[0]]:
                        bound = ra[part].astype(np.float32)[:, None] + (rb[cols] + reach).astype(np.float32)
                        bound *= bound
                        hit = 2 - 2 * cos <= bound + np.float32(SLACK)
                    else:  # points on both sides have one bound
                        hit = cos >= np.float32(1 - (reach * reach + SLACK) / 2)
                    x, z = np.divmod(np.flatnonzero(hit), len(cols))
                    if same and i == j:
                        up = part[x] <= cols[z]
                        x, z = x[up], z[up]
                    pa_, pb = settle(na, nb, part[x], cols[z], 2 - 2 * cos[x, z])
                    if len(pa_):
                        todo.append((na, nb, pa_, pb))
        narrow = np.flatnonzero(wide <= 4096)
        ends = np.cumsum(wide[narrow])
        start = 0
        while start < len(narrow):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE)))
            own = narrow[start:stop]
            start = stop
            x, z = _products(a[own], b[own], af, at, bf, bt)
            if same and la == lb:
                up = x <= z
                x, z = x[up], z[up]
            pa_, pb = settle(na, nb, x, z, _squared(single, left.levels[na][0][x], right.levels[nb][0][z]))
            if len(pa_):
                todo.append((na, nb, pa_, pb))
    return links


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of x with the rows j of y, which are copied a few at a time."""
    out, step = np.empty(len(i), x.dtype), max(1, NUMBERS_AT_ONCE // x.shape[1])
    for at in range(0, len(i), step):
        out[at : at + step] = np.einsum("ij,ij->i", x[i[at : at + step]], y[j[at : at + step]])
    return out


def _squared(single: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 2 - 2 * _dots(single[0], a, single[1], b)


def _by_width(low: int, high: int, radius: np.ndarray) -> list[np.ndarray]:
    """The nodes from low to high in two parts, as far as they have any: those of radius zero and the others."""
    nodes = np.arange(low, high)
    return [x for x in (nodes[radius[low:high] == 0], nodes[radius[low:high] > 0]) if len(x)]


def _products(a: np.ndarray, b: np.ndarray, af: np.ndarray, at: np.ndarray, bf: np.ndarray, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a[i] and a child of b[i]."""
    ka, kb = at[a] - af[a], bt[b] - bf[b]
    k = ka * kb
    of = np.repeat(np.arange(len(a)), k)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    return af[a][of] + inside // kb[of], bf[b][of] + inside % kb[of]


# --- distribution ---------------------------------------------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length, none of them null, as the rows of a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _packed(tree: Tree, vk: np.ndarray, weight: np.ndarray) -> bytes:
    """A tree with the names and weights of its points, in its order, as a file's bytes."""
    out = io.BytesIO()
    np.savez(out, points=tree.points, vk=vk[tree.order], weight=weight[tree.order], **{f"level{i}_{j}": x for i, level in enumerate(tree.levels) for j, x in enumerate(level)})
    return out.getvalue()


def _unpacked(data: bytes) -> tuple[Tree, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        levels = [tuple(found[f"level{i}_{j}"] for j in range(4)) for i in range(sum(x.endswith("_0") for x in found.files))]
        return Tree(found["points"], np.arange(len(found["vk"])), levels), found["vk"], found["weight"]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, POINTS_AT_ONCE):
            yield b.slice(at, POINTS_AT_ONCE)


def _filed_blocks(points: DataFrame, n: int, cosine: float, folder: str) -> DataFrame:
    """(block, file, others): the blocks of points, which are of one length, filed in folder as trees; others are the blocks
    that some point of the block can have a link to, itself included."""
    k = min(max(1, -(-n // BLOCK)), MOST_PIVOTS)
    pivots = np.stack([np.asarray(r[0], np.float64) for r in points.orderBy(F.xxhash64("vk"), "vk").limit(k).select("unit").collect()])
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The points of each cell in a task and the farthest. Pivots that tie but for noise all reach the point: any may get it."""
        count, far = np.zeros(k, np.int64), np.full(k, -1.0)
        for b in _slices(batches):
            squared = np.maximum(0, 2 - 2 * (_matrix(b.column(0)) @ pivots.T))
            tied = squared <= squared.min(1, keepdims=True) + NOISE
            far = np.maximum(far, np.sqrt(np.where(tied, squared, -1.0).max(0), where=tied.any(0), out=np.full(k, -1.0)))
            count += np.bincount(squared.argmin(1), minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(count, pa.int64()), pa.array(far, pa.float64())], ["cell", "n", "far"])

    sizes = {r["cell"]: (r["n"], r["far"]) for r in points.select("unit").mapInArrow(cells, "cell int, n long, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()}
    radius = np.array([sizes.get(c, (0, -1.0))[1] for c in range(k)])
    parts = np.array([max(1, -(-sizes.get(c, (0, 0))[0] // BLOCK)) for c in range(k)])
    first = np.r_[0, np.cumsum(parts)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            vk, cell = b.column(0).to_numpy(), (_matrix(b.column(2)) @ pivots.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + (vk * 0x9E3779B1 >> 7) % parts[cell], pa.int32()), *b.columns], ["block", "vk", "weight", "unit"])

    def file(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        cell = int(np.searchsorted(first, block, "right")) - 1
        gap = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots[cell]))
        x, reached = _matrix(table.column("unit")), np.arange(k) == cell
        for at in range(0, len(x), POINTS_AT_ONCE):
            squared = np.maximum(0, 2 - 2 * (x[at : at + POINTS_AT_ONCE] @ pivots.T))
            # within reach of the bisector with each pivot; not divided by the gap, which may be all noise
            may = (radius >= 0) & (np.sqrt(squared) <= radius + reach) & (squared - squared[:, [cell]] <= 2 * gap * reach + NOISE)
            reached |= may.any(0)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{block}-{uuid.uuid4().hex}.npz"  # a task that is done again files its own
        with fs.open_output_stream(f"{root}/{name}") as sink:
            sink.write(_packed(build(x), table.column("vk").to_numpy(), table.column("weight").to_numpy()))
        others = np.concatenate([np.arange(first[c], first[c + 1]) for c in np.flatnonzero(reached)])
        return pa.table({"block": pa.array([block], pa.int32()), "file": [name], "others": pa.array([others], pa.list_(pa.int32()))})

    dealt = points.select("vk", "weight", "unit").mapInArrow(deal, "block int, vk long, weight long, unit array<double>")
    return materialize(dealt.groupBy("block").applyInArrow(file, "block int, file string, others array<int>"), "blocks")


def _tiles(blocks: DataFrame, side: int) -> DataFrame:
    """(pairs), one array of file names (low, high) for each task: all pairs of blocks that can be linked from both sides."""
    seen = blocks.select("block", F.explode("others").alias("other"))
    both = seen.groupBy(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).count().where("count = 2 or low = high")
    files = [F.broadcast(blocks.select(F.col("block").alias(c), F.col("file").alias(f"{c}_file"))) for c in ("low", "high")]
    named = both.join(files[0], "low").join(files[1], "high")
    across, down = (F.floor(F.col(c) / side).alias(f"{c}_tile") for c in ("low", "high"))
    tiles = materialize(named.groupBy(across, down).agg(F.collect_list(F.struct(F.col("low_file").alias("low"), F.col("high_file").alias("high"))).alias("pairs")), "tiles")
    return tiles.repartitionByRange(max(1, min(tiles.count(), MOST_TASKS)), "low_tile", "high_tile").select("pairs")  # by number: rows are small, their work is not


def _tile_links(folder: str, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for tile in (x for b in batches for x in b.column(0).to_pylist()):
            held: dict[str, tuple[Tree, np.ndarray, np.ndarray]] = {}
            for pair in tile:
                for name in pair.values():
                    if name not in held:
                        with fs.open_input_stream(f"{root}/{name}") as source:
                            held[name] = _unpacked(source.read())
                same = pair["low"] == pair["high"]
                (left, vk, weight), (right, more, other) = held[pair["low"]], held[pair["high"]]
                links = traverse(left, right, (weight, other), cosine, same)
                names = vk if same else np.concatenate([vk, more])
                some = np.flatnonzero(links.count[: len(names)])
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[links.find(some)]), pa.array(links.count[some])], ["vk", "root", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors (vec_id, embedding).

    n_links counts the other rows with a cosine of at least the threshold, equal vectors included; component_id is
    the smallest vec_id reachable. Null and zero vectors, and those with null or non-finite components, have no links
    and their own id. Vectors of different lengths are not compared. Repeated rows each get a row. Rows with a null
    vec_id are counted and named by the others. Extra columns are ignored; an empty table gives an empty result.
    """
    e = F.col("embedding").cast("array<double>")
    square = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    valid = F.coalesce((square > 0) & (square < float("inf")), F.lit(False))  # null or non-finite components make it false
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), square.alias("square"), valid.alias("valid"))
    rows = rows.select("vec_id", F.when(F.col("valid"), F.struct(F.xxhash64("e").alias("a"), F.xxhash64(F.lit(1), F.col("e")).alias("b"))).alias("key"), F.when(F.col("valid"), F.transform("e", lambda x: x / F.sqrt(F.col("square")))).alias("unit"))
    points = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.min("unit").alias("unit"))
    points = materialize(points.withColumn("vk", F.monotonically_increasing_id()), "points")
    found = None
    for length, n in points.groupBy(F.size("unit")).count().collect():  # one round for each vector length
        own = points.where(F.size("unit") == length)
        folder = scratch_path(vectors.sparkSession, "trees")
        tiles = _tiles(_filed_blocks(own, n, cosine, folder), max(1, min(TILE, TILE_BYTES // (BLOCK * length * 8))))
        part = tiles.mapInArrow(_tile_links(folder, cosine), "vk long, root long, n long")
        found = part if found is None else found.unionByName(part)
    narrow = rows.select("vec_id", "key")
    if found is None:
        return narrow.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = materialize(found, "links")
    roots = connected_components(found.select(F.col("vk").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("vk").agg(F.sum("n").alias("n"))
    named = points.select("vk", "key", "first", "weight").join(counts, "vk", "left").join(roots.withColumnRenamed("node", "vk"), "vk", "left").withColumn("root", F.coalesce("root", "vk"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(salted_left_join(named.where("weight > 1 or n > 0"), least, "root", F.col("vk")).select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "named")
    return looked_up(narrow, of, "key", F.col("vec_id")).select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


#: Links by comparing all pairs, components by following links; for tables as small as those that correctness is checked on.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), checked AS (
  SELECT vec_id, CASE WHEN len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 THEN list_transform(e, lambda x: coalesce(x, 0.0)) END AS e FROM v
), sound AS (
  SELECT vec_id, e, CASE WHEN e IS NOT NULL THEN sqrt(list_inner_product(e, e)) END AS norm FROM checked WHERE e IS NOT NULL
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}
), reach AS (
  SELECT vec_id AS src, vec_id AS dst FROM v
  UNION
  SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src
), named AS (SELECT src, min(dst) AS component_id FROM reach GROUP BY src),
counted AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, n.component_id, v.vec_id = n.component_id AS kept
FROM v JOIN named n ON n.src = v.vec_id LEFT JOIN counted c ON c.src = v.vec_id
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
