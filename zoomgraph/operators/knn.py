"""k-nearest-neighbour graphs over points(node_id, x).

All points against all points is worked in strips of packed blocks: a task holds the points of one strip and the
k best of each so far, and all blocks stream past it from their checkpoint, so only finished neighbours leave it. No
side is broadcast, and no block is written more than once however many strips there are.
Ties go to the smaller neighbour id, and a point is never its own neighbour."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from .graph import both, checkpointed

BLOCK = 512
#: Blocks of a strip, at most: every strip reads each block once.
STRIP = 16
#: Planes of a tree of the approximate search; a point's sides of them are one 64-bit code.
BITS = 62


def default_k(n: int) -> int:
    return min(max(10, min(int(n**0.5), 50)), max(0, n - 1))


def blocks(points: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    """(part, at, ids, xs): at most ``size`` points a row, packed where they are read, so that nothing is shuffled."""

    def pack(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            lengths = pc.unique(pc.list_value_length(b.column(1)))
            if len(lengths) > 1:
                raise ValueError("points of unlike dimensions")
            ids, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for own in np.array_split(np.argsort(ids, kind="stable"), -(-b.num_rows // size)) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([x[own].tobytes()])], ["part", "at", "ids", "xs"])
                at += 1

    rows = points.select("node_id", F.col("x").cast("array<double>").alias("x")).coalesce(max(1, -(-n // size)))
    return rows.mapInArrow(pack, "part int, at int, ids binary, xs binary")


def _least(d: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m least values of each row, in order, of equal ones the earlier: whole rows are sorted only where
    more than m columns reach the m-th value."""
    if m >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    at = np.sort(np.argpartition(d, m - 1, axis=1)[:, :m], axis=1)
    v = np.take_along_axis(d, at, 1)
    tied = np.flatnonzero((d <= v.max(1, keepdims=True)).sum(1) > m)
    at = np.take_along_axis(at, np.argsort(v, axis=1, kind="stable"), 1)
    at[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :m]
    return at


class _Best:
    """The k nearest so far of the points of one block.

    A product of matrices gives, row by row, a key in the order of the distances; pairs whose key is within rounding of
    the row's k-th best are measured from their differences, so copies have equal distances."""

    def __init__(self, block: int, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
        self.block, self.ids, self.x, self.k, self.metric = block, ids, x, k, metric
        self.xx = (x * x).sum(1)
        self.left = np.column_stack([x, self.xx, np.ones(len(x))])
        self.limit = np.full((len(x), 1), np.inf)
        self.at, self.j, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.held, self.count = [], 0

    def meet(self, block: int, ids: np.ndarray, y: np.ndarray, yy: np.ndarray, right: np.ndarray, slack: float) -> None:
        key = self.left @ right
        if block == self.block:
            key[self.ids[:, None] == ids[None, :]] = np.inf
        limit = self.limit
        if not np.isfinite(limit).all() and self.k < len(ids):
            limit = np.minimum(limit, self._loose(np.partition(key, self.k - 1, axis=1)[:, self.k - 1 : self.k])) if (self.xx < 1).all() or self.metric == "euclidean" else limit
        i, c = np.divmod(np.flatnonzero(key <= limit + slack * (1 + self.xx.max())), len(ids))
        for s in range(0, len(i), 1 << 15):
            a, b = i[s : s + (1 << 15)], c[s : s + (1 << 15)]
            d = np.sqrt(((self.x[a] - y[b]) ** 2).sum(1))
            if self.metric == "poincare":
                d = 2 * np.arcsinh(d / np.sqrt((1 - self.xx[a]) * (1 - yy[b])))
            ok = np.isfinite(d) & (self.ids[a] != ids[b])
            self.held.append((a[ok], ids[b[ok]], d[ok]))
            self.count += int(ok.sum())
        if self.count > self.k * len(self.ids):
            self.settle()

    @staticmethod
    def _loose(key: np.ndarray) -> np.ndarray:
        return key + 1e-9 * np.abs(key)

    def settle(self) -> None:
        at, j, d = (np.concatenate([one, *more]) for one, more in zip((self.at, self.j, self.d), zip(*self.held) if self.held else ((), (), ()), strict=True))
        order = np.lexsort((j, d, at))
        at, j, d = at[order], j[order], d[order]
        starts = np.searchsorted(at, np.arange(len(self.ids)))
        rank = np.arange(len(at)) - starts[at]
        keep = rank < self.k
        self.at, self.j, self.d, self.rank = at[keep], j[keep], d[keep], rank[keep]
        last = self.rank == self.k - 1
        far, xx = self.d[last], self.xx[self.at[last]]
        # outside the ball keys have no order, and nothing is ruled out
        far = far**2 if self.metric == "euclidean" else np.where(xx < 1, np.sinh(far / 2) ** 2 * (1 - xx), np.inf)
        self.limit[self.at[last], 0] = self._loose(far)
        self.held, self.count = [], 0

    def rows(self) -> pa.RecordBatch:
        self.settle()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.at]), pa.array(self.j), pa.array(self.d), pa.array((self.rank + 1).astype(np.int32))], ["i", "j", "d", "rank"])


def _nearest(k: int, metric: str):
    """Rows (strip, far, block, ids, xs), the strip's own blocks first -> rows (i, j, d, rank)."""

    def meet(own: list[_Best], block: int, ids: np.ndarray, y: np.ndarray) -> None:
        yy = (y * y).sum(1)
        a = np.ones(len(y)) if metric == "euclidean" else 1 / (1 - yy)
        right = np.vstack([(-2 * a[:, None] * y).T, a, a * yy])
        slack = 1e-13 * float(np.abs(a).max() * (1 + yy.max()))
        for one in own:
            one.meet(block, ids, y, yy, right, slack)

    def run(batches):
        strip, own, met = None, [], False
        with np.errstate(all="ignore"):
            for b in batches:
                for s, far, block, ids, xs in zip(*(b.column(c).to_pylist() for c in ("strip", "far", "block", "ids", "xs")), strict=True):
                    if s != strip:
                        yield from _finished(own, met, meet)
                        strip, own, met = s, [], False
                    ids = np.frombuffer(ids, np.int64)
                    x = np.frombuffer(xs).reshape(len(ids), -1)
                    if not far:
                        if met:
                            raise RuntimeError("a strip's own blocks come first")
                        own.append(_Best(block, ids, x, k, metric))
                        continue
                    if not met:
                        _meet_own(own, meet)
                        met = True
                    meet(own, block, ids, x)
            yield from _finished(own, met, meet)

    return run


def _meet_own(own: list[_Best], meet) -> None:
    for other in own:
        meet(own, other.block, other.ids, other.x)


def _finished(own: list[_Best], met: bool, meet):
    if not met:
        _meet_own(own, meet)
    for one in own:
        yield one.rows()


def knn(points: DataFrame, k: int | None = None, metric: str = "poincare", n: int | None = None) -> DataFrame:
    """(i, j, d, rank): the k nearest neighbours j of every i, rank from 1."""
    if metric not in ("poincare", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    n = points.count() if n is None else n
    k = default_k(n) if k is None else min(k, max(0, n - 1))
    schema = "i long, j long, d double, rank int"
    if n <= 1 or k < 1:
        return points.sparkSession.createDataFrame([], schema)
    packed = checkpointed(blocks(points, n))
    parts = dict(packed.groupBy("part").count().collect())
    first, count = [0] * (1 + max(parts)), 0  # the number of each part's first block
    for part in sorted(parts):
        first[part], count = count, count + parts[part]
    packed = packed.select((F.lit(first)[F.col("part")] + F.col("at")).alias("block"), "ids", "xs")
    # the tasks of the strips fill the cores evenly
    cores = max(1, points.sparkSession.sparkContext.defaultParallelism)
    strips = min(count, -(--(-count // STRIP) // cores) * cores) if count > cores else count
    # one partition of blocks (twice: for their own strip, then for the others) times a partition for each strip: every
    # task streams the left side from the checkpoint and holds one row of the right
    turn = lambda far: packed.withColumn("far", F.lit(far)).coalesce(1)
    numbers = points.sparkSession.range(0, strips, 1, strips).select(F.col("id").cast("int").alias("strip"))
    meets = F.col("far") == (F.col("block") % strips != F.col("strip"))
    sent = turn(False).union(turn(True)).coalesce(1).join(numbers.hint("shuffle_replicate_nl"), meets)
    return sent.select("strip", "far", "block", "ids", "xs").mapInArrow(_nearest(k, metric), schema)


def _codes(planes: list[tuple[np.ndarray, np.ndarray]]):
    """Rows (part, code, node_id, x): a row of each tree for each point; the code's bits tell the sides of its planes."""

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float)
            if not len(x):
                continue
            flat = arrays.log_map(np.zeros((1, x.shape[1])), x)
            for part, (normal, offset) in enumerate(planes):
                side = (flat @ normal.T >= offset).astype(np.int64)
                code = side @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(code), b.column(0), b.column(1)], ["part", "code", "node_id", "x"])

    return run


def _runs(batches, size: int):
    """(part, ids, x) for each run of at most ``size`` neighbouring rows of one part."""
    part, ids, xs = None, [], []
    for b in batches:
        for p, i, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if ids and (p != part or len(ids) == size):
                yield part, np.array(ids), np.array(xs, float)
                ids, xs = [], []
            part = p
            ids.append(i)
            xs.append(x)
    if ids:
        yield part, np.array(ids), np.array(xs, float)


def knn_approx(points: DataFrame, k: int | None = None, oversampling: int = 3, n: int | None = None, trees: int = 8, size: int = BLOCK, sample: int = 4096, seed: int = 42) -> DataFrame:
    """Filter and refine: k * oversampling neighbours in the tangent space at the origin, ranked by distance.

    The filter is a forest of random planes, each midway between two of ``sample`` points drawn by hash (the one bounded
    fit; every point is indexed). A tree orders all points by the sides they are on, and a point is compared with its
    own run of ``size`` points in that order and with the runs before and after it. Runs are cut from ranges of the
    order, so no cell is too large for a task, and the cost is trees * 3 * size distances a point."""
    n = points.count() if n is None else n
    k = default_k(n) if k is None else min(k, max(0, n - 1))
    spark = points.sparkSession
    if n <= 1 or k < 1:
        return spark.createDataFrame([], "i long, j long, d double, rank int")
    points = points.select("node_id", F.col("x").cast("array<double>").alias("x"))
    drawn = points.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(sample).collect()
    at = np.array([r["x"] for r in drawn], float)
    at = arrays.log_map(np.zeros((1, at.shape[1])), at)
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(trees):
        one = rng.integers(len(at), size=BITS)
        two = (one + rng.integers(1, len(at), size=BITS)) % len(at)
        normal = at[one] - at[two]
        planes.append((normal, (normal * (at[one] + at[two])).sum(1) / 2))
    order = ["part", "code", "node_id"]
    rows = points.mapInArrow(_codes(planes), "part int, code long, node_id long, x array<double>")
    want = k * oversampling

    def compare(part, own, others):
        ids, x = own
        ids2, x2 = np.concatenate([o[0] for o in others]), np.concatenate([o[1] for o in others])
        zero = np.zeros((1, x.shape[1]))
        t = arrays.distances(arrays.log_map(zero, x), arrays.log_map(zero, x2), "euclidean")
        t[ids[:, None] == ids2[None, :]] = np.inf
        m = min(want, len(ids2))
        near = _least(t, m)
        d = np.take_along_axis(arrays.distances(x, x2), near, 1).ravel()
        i, j, t = np.repeat(ids, m), ids2[near].ravel(), np.take_along_axis(t, near, 1).ravel()
        ok = np.isfinite(t)
        return pa.RecordBatch.from_arrays([pa.array(i[ok]), pa.array(j[ok]), pa.array(t[ok]), pa.array(d[ok])], ["i", "j", "t", "d"])

    def search(batches):
        held: list[tuple] = []  # the run before, and the run whose turn is next
        for part, ids, x in _runs(batches, size):
            if held and held[-1][0] != part:
                yield compare(part, held[-1][1:], [h[1:] for h in held])
                held = []
            held.append((part, ids, x))
            if len(held) > 1:
                yield compare(part, held[-2][1:], [h[1:] for h in held])
                held = held[-2:]
        if held:
            yield compare(held[-1][0], held[-1][1:], [h[1:] for h in held])

    near = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(search, "i long, j long, t double, d double")
    # one exchange by i serves the merge of the trees and both rankings
    near = near.repartition("i").groupBy("i", "j").agg(F.min("t").alias("t"), F.min("d").alias("d"))
    first = F.row_number().over(Window.partitionBy("i").orderBy("t", "j"))
    near = near.withColumn("first", first).where(F.col("first") <= want).select("i", "j", "d")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def halves(near: DataFrame) -> DataFrame:
    """(i, j, d) with i < j: every edge once, where either end has the other as a neighbour. ``near`` is worked out once."""
    one = near.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    return one.repartition("i").groupBy("i", "j").agg(F.min("d").alias("d"))


def symmetric(near: DataFrame) -> DataFrame:
    """(i, j, d): the edges of halves in both directions."""
    return both(halves(near))


def median(values: DataFrame, bins: int = 4096) -> float | None:
    """The exact median of the one column of ``values``, which is read once for every factor of ``bins``: counts by
    equal ranges, then by the ranges of the one that holds the middle. No task gathers the values."""
    v = values.select(F.col(values.columns[0]).cast("double").alias("v")).where("v is not null")
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    found = []
    one, two = (n - 1) // 2, n // 2  # places from 0
    while low < high:
        width = (high - low) / bins
        if not width > 0 or low + width == low:
            rows = v.where(F.col("v").between(low, high)).groupBy("v").count().orderBy("v").collect()
            rows = [(r["v"], r["v"], r["count"]) for r in rows]
        else:
            at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
            rows = v.where(F.col("v").between(low, high)).groupBy(at.alias("bin")).agg(F.min("v"), F.max("v"), F.count("*")).orderBy("bin").collect()
            rows = [tuple(r)[1:] for r in rows]
        seen = 0
        for small, large, c in rows:
            if one < seen + c:
                break
            seen += c
        if two == seen + c:  # the second is the least of the next range
            found = [large, rows[rows.index((small, large, c)) + 1][0]]
            break
        low, high, one, two = small, large, one - seen, two - seen
    return (found[0] + found[1]) / 2 if found else low


def tau(near: DataFrame, mode: str = "symmetric") -> DataFrame:
    """(tau): median distance over the symmetric edges or over the directed neighbours, 1e-10 at least."""
    if mode not in ("symmetric", "directed"):
        raise ValueError(f"unknown mode {mode!r}")
    d = halves(near) if mode == "symmetric" else near
    return near.sparkSession.createDataFrame([(_tau(checkpointed(d)),)], "tau double")


def _tau(rows: DataFrame) -> float:
    """Of edges in both directions, each with the same distance, one direction has the same median."""
    return max(median(rows.select("d")) or 0.0, 1e-10)


def knn_graph(points: DataFrame, k: int | None = None, metric: str = "poincare", weighted: bool = True, tau_mode: str = "symmetric", tau_value: float | None = None, approx: bool = False, half: bool = False) -> DataFrame:
    """(i, j, d, w), both directions or with ``half`` i < j only: exp(-d^2 / (2 tau^2)), or 1.0 unweighted.

    Where tau is worked out, the neighbours are searched once and what tau is read from is checkpointed: edges once each."""
    if tau_mode not in ("symmetric", "directed"):
        raise ValueError(f"unknown mode {tau_mode!r}")
    near = knn_approx(points, k) if approx else knn(points, k, metric)
    turned = (lambda edges: edges) if half else both
    if not weighted:
        return turned(halves(near)).withColumn("w", F.lit(1.0))
    if tau_value is None and tau_mode == "directed":
        near = checkpointed(near)
        tau_value = _tau(near)
    edges = halves(near)
    if tau_value is None:
        edges = checkpointed(edges)
        tau_value = _tau(edges)
    return turned(edges.withColumn("w", F.exp(-F.col("d") * F.col("d") / (2 * tau_value * tau_value))))
