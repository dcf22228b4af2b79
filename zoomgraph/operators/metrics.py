"""Partition, ranking and correlation metrics as aggregations that return one row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import checkpointed
from .hierarchy import uniform


def contingency(pairs: DataFrame) -> DataFrame:
    """(t, p, n) of pairs(t, p)."""
    return pairs.groupBy("t", "p").agg(F.count("*").alias("n"))


def _margins(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = contingency(pairs)
    return c, c.groupBy("t").agg(F.sum("n").alias("n")), c.groupBy("p").agg(F.sum("n").alias("n"))


def adjusted_rand_index(pairs: DataFrame) -> DataFrame:
    """(ari); 1 where both labelings are trivial alike."""
    c2 = lambda: F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    c, t, p = _margins(pairs)
    x = c.agg(c2().alias("both"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(t.agg(c2().alias("st"))).crossJoin(p.agg(c2().alias("sp")))
    pairs_n = F.col("n") * (F.col("n") - 1) / 2
    expected = F.when(pairs_n > 0, F.col("st") * F.col("sp") / pairs_n).otherwise(0.0)
    top = (F.col("st") + F.col("sp")) / 2 - expected
    return x.select(F.when(top == 0, 1.0).otherwise((F.col("both") - expected) / F.when(top == 0, 1.0).otherwise(top)).alias("ari"))


def _entropies(pairs: DataFrame) -> DataFrame:
    """(h, ht, hp) in nats; zeros for no pairs."""
    c, t, p = _margins(pairs)
    n = c.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("all"))

    def h(d: DataFrame, name: str) -> DataFrame:
        q = F.col("n") / F.col("all")
        return d.crossJoin(F.broadcast(n)).agg(F.coalesce(F.sum(-q * F.log(q)), F.lit(0.0)).alias(name))

    return h(c, "h").crossJoin(h(t, "ht")).crossJoin(h(p, "hp"))


def variation_of_information(pairs: DataFrame) -> DataFrame:
    """(vi) = 2 H(T,P) - H(T) - H(P), at least 0; 0 for no pairs."""
    return _entropies(pairs).select(F.greatest(2 * F.col("h") - F.col("ht") - F.col("hp"), F.lit(0.0)).alias("vi"))


def normalized_mutual_info(pairs: DataFrame) -> DataFrame:
    """(nmi) with the arithmetic mean of the entropies; 1 where both are 0."""
    m = (F.col("ht") + F.col("hp")) / 2
    return _entropies(pairs).select(F.when(m <= 0, 1.0).otherwise((F.col("ht") + F.col("hp") - F.col("h")) / F.when(m <= 0, 1.0).otherwise(m)).alias("nmi"))


def _earlier_and_less(v: np.ndarray, w: np.ndarray, g: np.ndarray) -> float:
    """The sum of w[i] * w[j] over j before i with v[j] < v[i] and equal g, for whole numbers from 0: one pass a bit of v."""
    bits = int(v.max()).bit_length()
    key, out = g << bits | v, 0.0
    for bit in range(bits):
        order = np.argsort(key >> (bit + 1), kind="stable")
        group, high, x = key[order] >> (bit + 1), (key[order] >> bit & 1).astype(bool), w[order]
        low = np.cumsum(np.where(high, 0, x))
        start = np.searchsorted(group, group)
        before = np.where(start > 0, low[start - 1], 0)
        out += float((x * (low - before))[high].sum())
    return out


def _concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray, g: np.ndarray) -> float:
    """The sum over pairs with equal g of sign(dx) * sign(dy) * w * w."""
    if not len(x):
        return 0.0
    v = np.unique(y, return_inverse=True)[1]
    up, down = np.lexsort((-v, x)), np.lexsort((v, x))  # within one x no pair counts
    return _earlier_and_less(v[up], w[up], g[up]) - _earlier_and_less(v.max() - v[down], w[down], g[down])


def kendall_tau(rows: DataFrame, grid: int = 256) -> DataFrame:
    """(tau) b over rows(x, y): 0 for less than two rows or where one side is constant.

    Equal (x, y) are counted first. About ``grid`` cuts of each side make blocks: cut values alone and the open
    intervals between them. Pairs that differ in both blocks are counted from the table of block counts (at most
    (2 * grid + 1)^2 rows, on the driver); the others are within one block of x or of y, a share of about 1 / grid of
    the distinct rows, and are counted there by sorting. No rows meet pairwise."""
    c = checkpointed(rows.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").cast("double").alias("n")))
    both = c.where("x is not null and y is not null")
    cuts = [np.unique(q) for q in both.approxQuantile(["x", "y"], [i / grid for i in range(1, max(2, grid))], 0.0005)]

    def label(batches):
        for t in batches:
            out = []
            for name, q in zip(("x", "y"), cuts, strict=True):
                v = t.column(name).to_numpy()
                lo, hi = np.searchsorted(q, v, "left"), np.searchsorted(q, v, "right")
                out.append(pa.array((lo + hi).astype(np.int32)))  # odd: a cut value alone
            yield pa.RecordBatch.from_arrays([*out, t.column("x"), t.column("y"), t.column("n")], ["bx", "by", "x", "y", "n"])

    def inside(t: pa.Table) -> pa.Table:
        """Pairs within a block; a block of x leaves those of one block of y as well to that."""
        x, y, n, by = (t.column(k).to_numpy() for k in ("x", "y", "n", "by"))
        s = _concordance(x, y, n, np.zeros(len(x), np.int64))
        if t.column("a")[0].as_py() >= 0:
            some = by % 2 == 0
            s -= _concordance(x[some], y[some], n[some], by[some].astype(np.int64))
        return pa.table({"s": [s]})

    met = both.mapInArrow(label, "bx int, by int, x double, y double, n double")
    count = np.zeros((2 * len(cuts[0]) + 1, 2 * len(cuts[1]) + 1))
    for r in met.groupBy("bx", "by").agg(F.sum("n").alias("n")).collect():
        count[r["bx"], r["by"]] = r["n"]
    left = np.vstack([np.zeros((1, count.shape[1])), np.cumsum(count, 0)[:-1]])
    less = np.cumsum(left, 1) - left
    more = left.sum(1, keepdims=True) - less - left
    across = float((count * (less - more)).sum())
    block = lambda at, a, b: F.when(F.col(at) % 2 == 0, F.struct(a.alias("a"), b.alias("b")))
    blocks = F.filter(F.array(block("bx", F.col("bx"), F.lit(-1)), block("by", F.lit(-1), F.col("by"))), lambda k: k.isNotNull())
    near = met.withColumn("g", F.explode(blocks)).select("g.*", "x", "y", "n", "by")
    s = near.groupBy("a", "b").applyInArrow(inside, "s double").agg((F.coalesce(F.sum("s"), F.lit(0.0)) + F.lit(across)).alias("s"))
    ties = lambda *k: c.groupBy(*k).agg(F.sum("n").alias("n"))
    tie = lambda d, name: d.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias(name))
    n = c.agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("n0"))
    den = F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))
    return s.crossJoin(n).crossJoin(tie(ties("x"), "tx")).crossJoin(tie(ties("y"), "ty")).select(F.when(den > 0, F.col("s") / F.when(den > 0, den)).otherwise(0.0).alias("tau"))


def running(counts: DataFrame, col: str, n: str = "n") -> DataFrame:
    """counts(col, n) with ``upto``: the sum of n up to and with each value of col. Values are summed range by range, so
    no task sees all of them."""
    ranged = checkpointed(counts.repartitionByRange(col).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = ranged.groupBy("part").agg(F.sum(n).alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("in", F.sum(n).over(within)).join(F.broadcast(base), "part").withColumn("upto", F.col("in") + F.col("base")).drop("in", "base", "part")


def ranks(rows: DataFrame, col: str, out: str) -> DataFrame:
    """rows with average ranks of col. Values are counted first; only distinct values are ordered."""
    c = running(rows.groupBy(col).agg(F.count("*").alias("n")), col)
    return rows.join(c.select(col, (F.col("upto") - (F.col("n") - 1) / 2).alias(out)), col)


def spearman(rows: DataFrame) -> DataFrame:
    """(rho) over rows(x, y)."""
    return ranks(ranks(rows, "x", "rx"), "y", "ry").agg(F.corr("rx", "ry").alias("rho"))


def pearson(rows: DataFrame) -> DataFrame:
    """(r) over rows(x, y): 0 for less than three rows or a deviation under 1e-10."""
    return rows.agg(F.when((F.count("*") < 3) | (F.stddev_pop("x") < 1e-10) | (F.stddev_pop("y") < 1e-10), 0.0).otherwise(F.corr("x", "y")).alias("r"))


def hit_at(detected: DataFrame, true: DataFrame, hops: float) -> DataFrame:
    """(hit): the share of detected(d) within ``hops`` of some true(t); 0 where either is empty.

    Swapping the two gives the recall. Of the true values, cells half as wide as ``hops`` keep their least and greatest,
    which are the nearest ones of any value outside the cell; a value inside is near enough anyway."""
    d, t = detected.groupBy("d").agg(F.count("*").alias("n")), true.where("t is not null")
    if hops > 0:
        cell = lambda x: F.floor(F.col(x) / (hops / 2))
        cells = t.groupBy(cell("t").alias("cell")).agg(F.min("t").alias("low"), F.max("t").alias("high"))
        asked = d.withColumn("off", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("cell", cell("d") + F.col("off"))
        close = (F.col("off") == 0) | (F.least(F.abs(F.col("d") - F.col("low")), F.abs(F.col("d") - F.col("high"))) <= hops)
        near = asked.join(cells, "cell").where(close).groupBy("d").agg(F.first("n").alias("n"))
    else:
        near = d.join(t, F.col("d") == F.col("t"), "left_semi")
    return near.agg(F.sum("n").alias("hits")).crossJoin(detected.agg(F.count("*").alias("all"))).select(F.when(F.col("all") > 0, F.coalesce("hits", F.lit(0)) / F.col("all")).otherwise(0.0).alias("hit"))


def mean_reciprocal_rank(true: DataFrame, ranked: DataFrame) -> DataFrame:
    """(mrr) of ranked(qid, item, rank) against true(qid, item): queries with no true item are left out,
    a miss counts 0; no queries give 0."""
    q = true.select("qid").distinct().join(ranked.select("qid").distinct(), "qid", "left_semi")
    best = ranked.join(true.distinct(), ["qid", "item"], "left_semi").groupBy("qid").agg(F.min("rank").alias("r"))
    return q.join(best, "qid", "left").agg(F.coalesce(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def wilcoxon(rows: DataFrame) -> DataFrame:
    """(n, w, z, p) of the signed ranks of x - y over rows(x, y): equal pairs are left out, ties share their mean rank, w sums
    the ranks of positive differences; z by the normal approximation with its correction for ties, p two-sided, both null
    without a difference. Differences are counted first; only distinct sizes are ordered."""
    d = rows.select((F.col("x") - F.col("y")).alias("d")).where("d <> 0")
    c = d.groupBy(F.abs("d").alias("a")).agg(F.count("*").cast("double").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    c = running(c, "a", "t").withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2)
    none, n, t = F.lit(0.0), F.col("n"), F.col("t")
    s = c.agg(F.coalesce(F.sum("t"), none).alias("n"), F.coalesce(F.sum(F.col("up") * F.col("rank")), none).alias("w"), F.coalesce(F.sum(t * t * t - t), none).alias("ties"))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    s = s.withColumn("z", F.when(n > 0, (F.col("w") - n * (n + 1) / 4) / F.sqrt(F.when(var > 0, var))))
    p = F.udf(lambda z: None if z is None else math.erfc(abs(z) / math.sqrt(2)), "double")  # one row
    return s.select(n.cast("long").alias("n"), "w", "z", p("z").alias("p"))


def reciprocal_ranks(peaks: DataFrame, above: DataFrame, nodes: DataFrame, salts: int = 64) -> DataFrame:
    """(peak, rr): for each of peaks(peak, focus, depth_hat, x), the reciprocal rank of the focus' first ancestor (of
    above(node, ancestor)) among all nodes(node_id, depth, x) of the rounded depth, by distance from x, then by id.

    x is the focus' own point or its summary at the peak. Halves round to even. No node or no ancestor at that depth
    gives 0; a focus without ancestors has no row. A depth's nodes meet its peaks in ``salts`` parts, so a depth with most
    of the nodes is not one task."""
    up = above.select(F.col("node").alias("focus"), F.col("ancestor").alias("node_id")).distinct()
    p = peaks.withColumn("depth", F.bround("depth_hat").cast("int")).join(up.select("focus").distinct(), "focus", "left_semi")
    n = nodes.select("node_id", F.col("depth").cast("int").alias("depth"), F.col("x").alias("xn"))
    at = F.struct(G.poincare_distance("x", "xn").alias("d"), F.col("node_id").alias("id"))
    first = p.join(up, "focus").join(n, ["node_id", "depth"]).groupBy("peak").agg(F.min(at).alias("first"))
    asked = p.join(first, "peak").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = asked.join(n.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(salts)).cast("int")), ["depth", "salt"])
    rank = met.where(at <= F.col("first")).groupBy("peak").agg(F.count("*").alias("rank"))
    return p.select("peak").join(rank, "peak", "left").select("peak", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))


def hierarchy_preservation(points: DataFrame, pairs: DataFrame, seed: int = 42) -> DataFrame:
    """(share, n): pairs(a, b) of linked nodes that are nearer than a with a hash-drawn node other than both.

    points(node_id, idx, x) number the nodes from 0."""
    n = points.count()
    if n < 3:
        return pairs.sparkSession.createDataFrame([(0.0, 0)], "share double, n long")
    rnd = F.floor(uniform("a", "b", seed=seed) * n).cast("long")
    p = pairs.withColumn("draw", rnd)
    x = lambda name: points.select(F.col("node_id").alias(name), F.col("x").alias("x" + name))
    third = points.select(F.col("idx").alias("draw"), F.col("node_id").alias("r"), F.col("x").alias("xr"))
    j = p.join(x("a"), "a").join(x("b"), "b").join(third, "draw").where("r <> a and r <> b")
    return j.agg(F.coalesce(F.avg((G.poincare_distance("xa", "xb") < G.poincare_distance("xa", "xr")).cast("double")), F.lit(0.0)).alias("share"), F.count("*").alias("n"))
