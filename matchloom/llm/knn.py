"""The k most similar vectors of every vector, by multiprobe p-stable hashing.

h(x) = floor((a.x + b) / w) with normally distributed a. Each table hashes twice. A few wide functions give a vector's
cell, which is all that is shuffled by: a vector is sent to its own cell, as an item and as a query, and as a query to the
cells across its nearest borders, in the order of their estimated success, the sum of squared distances to the crossed
borders, as far as that lies within reach. Within a cell narrower functions give buckets; each query visits its own bucket
and the likeliest perturbed ones there, which costs no shuffle. What cells and tables give is merged and ranked by exact
distance.

Vectors are scaled to unit length, where Euclidean distance and cosine give the same order, and held as 24-bit fixed
point numbers. Exact copies (and scaled ones) stand for one point, so a group of copies never makes a cell large. Cells
beyond cell_rows are cut into chunks that all their queries visit, so nothing is capped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import BROADCAST_ROWS, bounded_broadcast, checkpointed

#: Unrelated vectors that share a cell; the number of wide functions follows from it.
CELL_TARGET = 30_000
#: By what factor one more function of this width thins out unrelated unit vectors (measured).
WIDE, WIDE_THINNING = 2.0, 2.2
NARROW, NARROW_THINNING = 1.2, 2.9
#: How many deviations a bucket's border may be away to be visited.
DEVIATIONS = 2.5
#: Vectors that one task compares.
VECTORS_PER_TASK = 20_000
#: Steps of a unit vector's numbers.
_STEPS = float((1 << 23) - 1)


def functions_for(points: int, target: int, thinning: float) -> int:
    return max(0, round(math.log(points / target, thinning))) if points > target else 0


@lru_cache(maxsize=16)
def projections(dim: int, tables: int, functions: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, tables * functions)), rng.random(tables * functions) * width


@lru_cache(maxsize=64)
def perturbations(functions: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """The likeliest sets of positions in the list of the 2 * functions border distances in rising order, for expected
    distances; the set of position i and its opposite 2m-1-i, which cross both borders of one function, is left out."""
    m2 = 2 * functions
    if not m2:
        return ()
    expected = [(j + 1) * (j + 2) / (4 * (functions + 1) * (functions + 2)) if j < functions else 1 - (m2 - j) / (functions + 1) + (m2 - j) * (m2 - j + 1) / (4 * (functions + 1) * (functions + 2)) for j in range(m2)]
    out: list[tuple[int, ...]] = []
    heap = [(expected[0], (0,))]
    while heap and len(out) < probes:
        score, s = heapq.heappop(heap)
        if not any(m2 - 1 - i in s for i in s):
            out.append(s)
        last = s[-1]
        if last + 1 < m2:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*s, last + 1)))
    return tuple(out)


def bucket_ids(x: np.ndarray, tables: int, functions: int, width: float, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home bucket, probed buckets, squared distance to each) of each row: int64 arrays of shape (n, tables) and
    (n, tables, probes), and a float array like the second. Without functions all rows are in one bucket of each table."""
    a, b = projections(x.shape[1], tables, functions, width, seed)
    p = ((x @ a + b) / width).reshape(len(x), tables, functions)
    h = np.floor(p)
    f = p - h
    h = h.astype(np.int64)
    mult = np.random.default_rng(seed + 1).integers(1, 1 << 62, (tables, functions), dtype=np.int64) * 2 + 1
    salt = np.random.default_rng(seed + 2).integers(1, 1 << 62, tables, dtype=np.int64)
    sets = perturbations(functions, probes)
    with np.errstate(over="ignore"):
        home = (h * mult).sum(axis=2) + salt
        if not sets:
            return home, np.empty((*home.shape, 0), np.int64), np.empty((*home.shape, 0))
        # border distances in rising order; crossing the lower border is -1, the upper +1
        distance = np.concatenate([f, 1 - f], axis=2)
        order = np.argsort(distance, axis=2, kind="stable")
        near = np.square(np.take_along_axis(distance, order, axis=2) * width)
        step = np.where(order < functions, -1, 1) * np.take_along_axis(np.broadcast_to(np.tile(mult, 2), order.shape), order, axis=2)
        probed = np.stack([home + step[:, :, list(s)].sum(axis=2) for s in sets], axis=2)
        far = np.stack([near[:, :, list(s)].sum(axis=2) for s in sets], axis=2)
    return home, probed, far


def encode(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as rows of 3 bytes for each number."""
    whole = np.round(unit * _STEPS).astype("<i4")
    return np.ascontiguousarray(whole.view(np.uint8).reshape(*unit.shape, 4)[:, :, :3]).reshape(len(unit), 3 * unit.shape[1])


def decode(codes: np.ndarray, dim: int) -> np.ndarray:
    """Rows of encode() as float32 vectors."""
    wide = np.zeros((len(codes), dim, 4), np.uint8)
    wide[:, :, 1:] = codes.reshape(len(codes), dim, 3)
    return (wide.view("<i4")[:, :, 0] >> 8).astype(np.float32) / np.float32(_STEPS)


def _codes(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _normaliser(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("__v").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
            top = np.abs(x).max(axis=1)
            ok = np.isfinite(top) & (top > 0)
            if not ok.any():
                continue
            x = x[ok] / top[ok][:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            codes = encode(x)
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in codes), np.uint8).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([b.column("__i").filter(pa.array(ok)), _binary(keys), _binary(codes)], ["__i", "key", "vec"])

    return run


def _sender(dim: int, tables: int, functions: int, probes: int, reach: float, seed: int):
    """Rows (cell, kind, point): kind 0 for the own cell of each table, 1 for the probed ones; point is id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                codes = _codes(part.column("vec"), 3 * dim)
                ids = part.column("__i").to_numpy(zero_copy_only=False).astype("<i8")
                points = np.concatenate([ids.view(np.uint8).reshape(-1, 8), codes], axis=1)
                home, probed, far = bucket_ids(decode(codes, dim), tables, functions, WIDE, probes, seed)
                q, t, p = np.nonzero(far <= reach * reach)
                rows = np.concatenate([np.repeat(np.arange(len(ids)), tables), q])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([home.ravel(), probed[q, t, p]])), pa.array(np.repeat(np.array([0, 1], np.int8), [home.size, len(q)])), _binary(points[rows])], ["cell", "kind", "point"]
                )

    return run


def _homes(dim: int, tables: int, functions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                home, _, _ = bucket_ids(decode(_codes(b.column("vec"), 3 * dim), dim), tables, functions, WIDE, 0, seed)
                yield pa.RecordBatch.from_arrays([pa.array(home.ravel())], ["cell"])

    return run


class _Cell:
    """The vectors of a cell (or of a chunk of a large one) in the order of their buckets."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bucket_rows: int, seed: int) -> None:
        self.functions, self.seed = functions_for(len(ids), bucket_rows, NARROW_THINNING), seed
        home, _, _ = bucket_ids(x, 1, self.functions, NARROW, 0, seed)
        order = np.lexsort((ids, home[:, 0]))
        self.ids, self.x = ids[order], x[order]
        self.buckets, self.starts = np.unique(home[order, 0], return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))

    def nearest(self, qids: np.ndarray, q: np.ndarray, k: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, neighbour, cosine) of each query's k best, itself left out; equals by the smaller id."""
        home, probed, far = bucket_ids(q, 1, self.functions, NARROW, probes, self.seed)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # what the own bucket gives bounds what is worth keeping from the others
        bound = np.full(len(q), -2.0, np.float32)
        for rows, c, s in self._products(q, home, np.ones(home.shape, bool)):
            keep = min(k + 1, s.shape[1])
            top = np.argpartition(s, s.shape[1] - keep, axis=1)[:, -keep:] if keep < s.shape[1] else np.broadcast_to(np.arange(keep), (len(rows), keep))
            best = np.take_along_axis(s, top, 1)
            got.append((np.repeat(rows, keep), (top + c).ravel(), best.ravel()))
            if keep == k + 1:
                bound[rows] = np.maximum(bound[rows], best.min(axis=1) - np.float32(1e-6))
        # a projection's differences are normal with the distance as their deviation: beyond DEVIATIONS of the distance so
        # far, a border is hardly crossed by anything nearer
        worth = far[:, 0] <= DEVIATIONS**2 * (2 - 2 * bound.astype(np.float64))[:, None]
        for rows, c, s in self._products(q, probed[:, 0], worth):
            r, x = np.nonzero(s >= bound[rows][:, None])
            got.append((rows[r], x + c, s[r, x]))
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        gq, gx, gs = (np.concatenate(parts) for parts in zip(*got, strict=True))
        order = np.lexsort((-gs, gq))
        gq, gx = gq[order], gx[order]
        few = _place(gq) < k + 4
        gq, gx = gq[few], gx[few]
        exact = np.einsum("nd,nd->n", q[gq].astype(np.float64), self.x[gx].astype(np.float64))
        names = self.ids[gx]
        other = names != qids[gq]
        gq, names, exact = gq[other], names[other], exact[other]
        order = np.lexsort((names, -np.round(exact, 9), gq))
        order = order[_place(gq[order]) < k]
        return qids[gq[order]], names[order], exact[order]

    def _products(self, q: np.ndarray, want: np.ndarray, worth: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(rows of q, first vector, products) for every bucket in `want`, a column of which names one for each query, as
        far as it is worth it."""
        at = np.minimum(np.searchsorted(self.buckets, want), len(self.buckets) - 1)
        qi, col = np.nonzero((self.buckets[at] == want) & worth)
        bucket = at[qi, col]
        order = np.argsort(bucket, kind="stable")
        qi, bucket = qi[order], bucket[order]
        for lo, hi in zip(*_runs(bucket), strict=True):
            start, end = self.starts[bucket[lo]], self.ends[bucket[lo]]
            for a in range(lo, hi, 1024):
                rows = qi[a : min(hi, a + 1024)]
                for c in range(start, end, 8192):
                    yield rows, c, q[rows] @ self.x[c : min(end, c + 8192)].T


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin and end."""
    if not len(sorted_values):
        return np.empty(0, int), np.empty(0, int)
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sorted_values)]])


def _place(sorted_values: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal values."""
    n = np.arange(len(sorted_values))
    first = np.concatenate([[True], np.diff(sorted_values) != 0]) if len(sorted_values) else np.empty(0, bool)
    return n - np.maximum.accumulate(np.where(first, n, 0))


def _ranker(dim: int, k: int, probes: int, bucket_rows: int, seed: int):
    """Within partitions sorted by (cell, kind): the cell's own vectors come first, then queries from elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = cell = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            """The cell is complete: its own vectors are its first queries."""
            nonlocal cell, held
            if held:
                ids, x = (np.concatenate(parts) for parts in zip(*held, strict=True))
                ids, first = np.unique(ids, return_index=True)  # repeated rows count once
                cell, held = _Cell(ids, x[first], bucket_rows, seed), []
                if len(ids) > 1:
                    yield from found(cell.ids, cell.x)

        def found(ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ids), 8192):
                out = cell.nearest(ids[at : at + 8192], q[at : at + 8192], k, probes)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], ["q", "n", "sim"])

        for b in batches:
            if not b.num_rows:
                continue
            cells, kinds = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind"))
            points = _codes(b.column("point"), 8 + 3 * dim)
            ids, x = np.ascontiguousarray(points[:, :8]).view("<i8")[:, 0], decode(points[:, 8:], dim)
            change = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(ids)], strict=True):
                if cells[lo] != now:
                    yield from close()
                    now, cell = cells[lo], None
                if kinds[lo] == 0:
                    held.append((ids[lo:hi], x[lo:hi]))
                else:
                    yield from close()
                    if cell is not None:
                        yield from found(ids[lo:hi], x[lo:hi])
        yield from close()

    return run


def nearest(df: DataFrame, item: str, vector: str, dim: int, k: int = 5, tables: int = 2, cell_probes: int = 2, reach: float = 0.5, bucket_rows: int = 400, bucket_probes: int = 20, cell_rows: int = 1 << 17, functions: int | None = None, seed: int = 11) -> DataFrame:
    """For every usable vector the k most similar others by cosine: item, neighbour, similarity, rank (from 1).

    Usable are vectors of dim finite numbers that are not all zero; other rows, and null items, give nothing and are
    nobody's neighbour. item is an integer. An item counts once (of different vectors under one item, any one); it is not
    its own neighbour. Equal cosines come in the order of the smaller item; vectors that agree to 7 digits after scaling
    to unit length count as equal. With fewer than k others all of them come out; an empty table gives an empty result.
    bucket_rows is how many unrelated vectors share a bucket; the number of narrow functions follows from it and from the
    cell. Approximate: a neighbour that shares no visited bucket in any table is missed.
    """
    raw = df.select(F.col(item).cast("long").alias("__i"), F.col(vector).cast("array<double>").alias("__v"))
    raw = raw.filter(F.col("__i").isNotNull() & (F.size("__v") == dim) & ~F.exists("__v", lambda x: x.isNull()))
    unit = raw.mapInArrow(_normaliser(dim), "__i long, key binary, vec binary")
    # an item of which there are several rows stands where its first key puts it
    member = checkpointed(unit.groupBy("__i").agg(F.min("key").alias("key"), F.count("*").alias("rows")))
    classes = member.groupBy("key").agg(F.min("__i").alias("rep"), F.count("*").alias("size"), F.sum("rows").alias("rows"))
    points, surplus = classes.agg(F.count("*"), F.sum("rows") - F.count("*")).first()
    several = checkpointed(classes.filter("size > 1").select("key", "rep"))
    copies = member.join(_small(several, surplus), "key").select("key", "__i", "rep")
    if (surplus or 0) <= BROADCAST_ROWS:
        # what doesn't stand for its class is left out by a broadcast list of at most BROADCAST_ROWS
        v = unit.join(F.broadcast(copies.filter("__i <> rep").select("__i")), "__i", "left_anti")
        v = v.join(F.broadcast(member.filter("rows > 1").select(F.col("__i").alias("i2"), F.col("key").alias("k2"))), F.col("__i") == F.col("i2"), "left").filter("k2 is null or k2 = key").select("__i", "vec")
    else:
        v = checkpointed(unit.groupBy("key").agg(F.first("vec").alias("vec")).join(classes, "key").select(F.col("rep").alias("__i"), "vec"))
    m = functions if functions is not None else functions_for(points, CELL_TARGET, WIDE_THINNING)
    homes = v.mapInArrow(_homes(dim, tables, m, seed), "cell long")
    # a cell in this list holds more than cell_rows vectors, so there are at most points * tables / cell_rows
    large = homes.groupBy("cell").count().filter(F.col("count") > cell_rows).select(F.col("cell").alias("lc"), F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks"))
    large = bounded_broadcast(checkpointed(large))
    sent = v.mapInArrow(_sender(dim, tables, m, cell_probes, reach, seed), "cell long, kind byte, point binary").join(large, F.col("cell") == F.col("lc"), "left")
    # of a large cell's chunks a vector is an item in one and a query in all
    own = F.pmod(F.xxhash64("point"), F.col("chunks")).cast("int")
    visits = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.xxhash64("cell", c).alias("cell"), F.when(c == own, F.col("kind")).otherwise(F.lit(1)).cast("byte").alias("kind")))
    visit = F.explode(F.when(F.col("lc").isNull(), F.array(F.struct("cell", "kind"))).otherwise(visits))
    # the work is in products, not in bytes, so the number of tasks follows the number of vectors
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-points * tables // VECTORS_PER_TASK))
    placed = sent.select(visit.alias("at"), "point").select("at.cell", "at.kind", "point").repartition(tasks, "cell").sortWithinPartitions("cell", "kind")
    found = placed.mapInArrow(_ranker(dim, k, bucket_probes, bucket_rows, seed + 100), "q long, n long, sim double")
    # the k best different neighbours of each point, from all cells and tables
    w_q = Window.partitionBy("q").orderBy(F.desc(F.round("sim", 9)), "n")
    best = found.repartition("q").dropDuplicates(["q", "n"]).withColumn("r", F.row_number().over(w_q)).filter(F.col("r") <= k).drop("r")
    # points back to items: a point's own copies come first, and each neighbour brings its copies
    first = copies.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("__i"))).filter(F.col("r") <= k + 1)
    ids = checkpointed(first.groupBy("rep").agg(F.array_sort(F.collect_list("__i")).alias("ids")))
    every = best.join(_small(ids, surplus).withColumnRenamed("rep", "n"), "n", "left").select("q", F.explode(F.coalesce("ids", F.array("n"))).alias("nid"), "sim")
    near = every.unionByName(ids.select(F.col("rep").alias("q"), F.explode("ids").alias("nid"), F.lit(1.0).alias("sim")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("sim", 9)), "nid"))).filter(F.col("r") <= k + 1).drop("r")
    # every copy but the one that stands for its class takes over its neighbours
    others = copies.filter("__i <> rep").select("__i", F.col("rep").alias("q")).join(near, "q")
    all_near = near.select(F.col("q").alias("__i"), "nid", "sim").unionByName(others.select("__i", "nid", "sim")).filter(F.col("__i") != F.col("nid"))
    w_i = Window.partitionBy("__i").orderBy(F.desc(F.round("sim", 9)), "nid")
    out = all_near.withColumn("rank", F.row_number().over(w_i)).filter(F.col("rank") <= k)
    return out.select(F.col("__i").alias(item), F.col("nid").alias("neighbour"), F.col("sim").alias("similarity"), "rank")


def _small(df: DataFrame, rows: int | None) -> DataFrame:
    """df, whose rows `rows` bounds, with a broadcast hint if these are few."""
    return F.broadcast(df) if (rows or 0) <= BROADCAST_ROWS else df


def unordered_pairs(neighbours: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """Distinct pairs a < b of which one is among the other's neighbours."""
    return neighbours.select(F.least(item, "neighbour").alias(a), F.greatest(item, "neighbour").alias(b)).distinct()
