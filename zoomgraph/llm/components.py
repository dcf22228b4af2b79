"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges(a, b) reach, for every id that has an edge.

    Large-star and small-star steps alternate: each hooks every neighbour of a node to the least one it
    knows, until all edges lead straight to their component's least id. The least neighbours are pre-aggregated, the
    joins with them are ones that Spark splits where a node has many neighbours, and the edge list never grows.
    A round is one job: the number of its edges and the sum of their hashes, taken on the way, tell its end."""
    mark = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y"))
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), *mark)
    while now.measured["n"]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the least one
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node's smaller neighbours, and the node, go to the least one
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        new = cut(small.where("a <> b").distinct(), *mark)
        if new.measured == now.measured:
            release(new)
            break
        release(now)
        now = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
