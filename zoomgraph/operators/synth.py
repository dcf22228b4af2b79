"""Synthetic graphs and controls; all draws are hashes of ids and a seed, whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hierarchy import uniform


def check(n: int, macro: int, meso: int, micro: int, r: float) -> int:
    """Nodes of a block, or an error."""
    if n <= 0 or macro <= 0 or meso <= 0 or micro <= 0 or r <= 0:
        raise ValueError("sizes and r must be positive")
    blocks = macro * meso * micro
    if n % blocks:
        raise ValueError(f"{n} nodes can't be dealt to {blocks} blocks")
    return n // blocks


def hsbm_labels(spark: SparkSession, n: int = 1024, macro: int = 2, meso: int = 4, micro: int = 8, r: float = 20.0) -> DataFrame:
    """(node_id, macro, meso, micro): blocks are contiguous ranges of ids."""
    size = check(n, macro, meso, micro, r)
    block = F.floor(F.col("id") / size)
    return spark.range(n).select(F.col("id").alias("node_id"), F.floor(block / (meso * micro)).cast("int").alias("macro"), F.floor(block / micro).cast("int").alias("meso"), block.cast("int").alias("micro"))


def hsbm_edges(spark: SparkSession, n: int = 1024, macro: int = 2, meso: int = 4, micro: int = 8, r: float = 20.0, seed: int = 42) -> DataFrame:
    """(src, dst), src < dst: a hierarchical block model with probabilities 2r, 8, 2 and 0.5 over n."""
    size = check(n, macro, meso, micro, r)
    p = [min(0.99, x / n) for x in (2.0 * r, 8.0, 2.0, 0.5)]
    rows = spark.range(n).select(F.col("id").alias("src")).repartition(max(1, n // 256), "src")
    e = rows.where(F.col("src") < n - 1).select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    same = lambda k: F.floor(F.col("src") / (size * k)) == F.floor(F.col("dst") / (size * k))
    prob = F.when(same(1), p[0]).when(same(micro), p[1]).when(same(micro * meso), p[2]).otherwise(p[3])
    return e.where(uniform("src", "dst", seed=seed) < prob)


def random_points(nodes: DataFrame, dim: int = 10, sigma: float = 0.1, seed: int = 42) -> DataFrame:
    """(node_id, x): independent normal coordinates by Box-Muller of two hashes each."""
    def normal(k: int):
        u, v = uniform("node_id", F.lit(2 * k), seed=seed), uniform("node_id", F.lit(2 * k + 1), seed=seed)
        return sigma * F.sqrt(-2 * F.log1p(-u)) * F.cos(2 * math.pi * v)

    return nodes.select("node_id", F.array(*[normal(k) for k in range(dim)]).alias("x"))
