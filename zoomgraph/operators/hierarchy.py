"""Hierarchies as edge tables hier(child, parent); a child may have several parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, undirected


def uniform(*parts, seed: int = 42) -> Column:
    """A number in [0, 1) from the values of parts, the same on every engine that has md5."""
    text = F.concat(*[x for p in parts for x in ((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(":"))], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def ancestors(hier: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, hops): everything above each node once, with the fewest hops; cycles end by themselves."""
    edge = hier.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    if nodes is not None:
        edge = edge.join(nodes.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")
    edge = checkpointed(edge.where("node <> ancestor").distinct().withColumn("hops", F.lit(1)))
    seen, hop, up = edge, 1, hier.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    while edge.limit(1).count():
        hop += 1
        new = edge.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).where("node <> ancestor").distinct()
        edge = checkpointed(new.join(seen, ["node", "ancestor"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.union(edge)
    return seen


def nodes(hier: DataFrame) -> DataFrame:
    return hier.select(F.explode(F.array("child", "parent")).alias("node_id")).distinct()


def depths(hier: DataFrame, most: int = 10_000) -> DataFrame:
    """(node_id, depth): the longest path down from a root. A cycle is an error after ``most`` levels."""
    below = hier.select(F.col("parent").alias("node_id"), "child")
    level = checkpointed(nodes(hier).join(hier.select(F.col("child").alias("node_id")), "node_id", "left_anti"))
    every, d = level.withColumn("depth", F.lit(0)), 0
    while level.limit(1).count():
        d += 1
        if d > most:
            raise ValueError("the hierarchy has a cycle")
        level = checkpointed(level.join(below, "node_id").select(F.col("child").alias("node_id")).distinct())
        every = every.union(level.withColumn("depth", F.lit(d)))
    return every.groupBy("node_id").agg(F.max("depth").alias("depth"))


def leaves(hier: DataFrame) -> DataFrame:
    return nodes(hier).join(hier.select(F.col("parent").alias("node_id")), "node_id", "left_anti")


def subtree(hier: DataFrame, depth: DataFrame, max_depth: int) -> DataFrame:
    """hier without nodes deeper than max_depth, and without links that lead to them."""
    kept = depth.where(F.col("depth") <= max_depth).select("node_id")
    return hier.join(kept.withColumnRenamed("node_id", "child"), "child", "left_semi").join(kept.withColumnRenamed("node_id", "parent"), "parent", "left_semi").select("child", "parent")


def to_undirected(hier: DataFrame) -> DataFrame:
    return undirected(hier.select(F.col("child").alias("src"), F.col("parent").alias("dst")))


def sibling_counts(hier: DataFrame) -> DataFrame:
    """(parent, n, pairs) of parents with two children or more; the pairs are counted, not listed."""
    return hier.distinct().groupBy("parent").agg(F.count("*").alias("n")).where("n >= 2").withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))


def sibling_sample(hier: DataFrame, seed: int = 42) -> DataFrame:
    """(parent, a, b): each child with the next one in hash order, the last with the first.

    A pair a child, so that a parent with many children stays linear."""
    w = Window.partitionBy("parent").orderBy("u", "child")
    s = hier.distinct().withColumn("u", uniform("child", seed=seed))
    s = s.withColumn("b", F.coalesce(F.lead("child").over(w), F.first("child").over(w)))
    return s.where("b <> child").select("parent", F.col("child").alias("a"), "b")


def stratified_leaves(leaf_depths: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """(node_id, depth): n leaves from at most ten quantile bins of depth, the same number from each, then
    filled up; drawn by hash of (node_id, seed)."""
    kinds = leaf_depths.select("depth").distinct().limit(10).count()
    if not kinds:
        return leaf_depths.select("node_id", "depth")
    cuts = leaf_depths.agg(F.percentile("depth", F.array(*[F.lit(i / kinds) for i in range(kinds + 1)])).alias("p")).first()["p"]
    cuts[-1] += 1
    bin_ = F.lit(None).cast("int")
    for i in range(kinds - 1, -1, -1):
        bin_ = F.when((F.col("depth") >= cuts[i]) & (F.col("depth") < cuts[i + 1]), F.lit(i)).otherwise(bin_)
    d = leaf_depths.withColumn("bin", bin_).withColumn("u", uniform("node_id", seed=seed))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy("u", "node_id")))
    # quotas first, then whoever is next by hash
    per = max(1, n // kinds)
    return d.orderBy((F.col("r") > per).cast("int"), "u", "node_id").limit(n).select("node_id", "depth")


def sigma_to_depth(sigma: Column, low: float, high: float, max_depth: int) -> Column:
    """Linear in log scale and inverted: the largest scale is depth 0."""
    frac = 1 - (F.log(sigma) - F.log(F.lit(low))) / (F.log(F.lit(high)) - F.log(F.lit(low)) + 1e-10)
    return F.greatest(F.lit(0.0), F.least(F.lit(float(max_depth)), frac * max_depth))


def nearest_ancestor_depth(detected: DataFrame, above: DataFrame, depth: DataFrame) -> DataFrame:
    """detected(focus, depth_hat) with nearest: the depth of an ancestor nearest to it, of two the shallower."""
    a = above.join(depth.withColumnRenamed("node_id", "ancestor"), "ancestor").select(F.col("node").alias("focus"), "depth").distinct()
    return detected.join(a, "focus", "left").groupBy("focus", "depth_hat").agg(F.min_by("depth", F.struct(F.abs(F.col("depth") - F.col("depth_hat")), F.col("depth"))).alias("nearest"))
