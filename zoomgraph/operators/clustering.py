"""Spectral clustering at a fixed number of clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm


def features(eigvals: DataFrame, eigvecs: DataFrame, k: int, sigma: float | None = None) -> DataFrame:
    """(node_id, f): modes 1..k, scaled by the heat kernel at sigma if given, each row of unit length."""
    x = F.slice("phi", 2, k)
    d = eigvecs
    if sigma is not None:
        lam = eigvals.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lambda"))), lambda r: r["lambda"]).alias("lam"))
        d = d.crossJoin(F.broadcast(lam))
        x = F.zip_with(x, F.slice("lam", 2, k), lambda a, b: a * F.exp(-sigma * b))
    d = d.select("node_id", x.alias("f"))
    return d.withColumn("f", F.when(norm("f") > 0, F.transform("f", lambda a: a / norm("f"))).otherwise(F.col("f")))


def spectral_clusters(eigvals: DataFrame, eigvecs: DataFrame, k: int, sigma: float | None = None, runs: int = 10, seed: int = 42) -> DataFrame:
    """(node_id, label): the best of ``runs`` k-means of the features; all 0 without a usable mode."""
    f = features(eigvals, eigvecs, k, sigma).withColumn("vec", array_to_vector("f")).cache()
    width = f.agg(F.max(F.size("f"))).first()[0] or 0
    if width < 1:
        return eigvecs.select("node_id", F.lit(0).alias("label"))
    fits = [KMeans(k=k, seed=seed + i, featuresCol="vec", predictionCol="label", maxIter=100).fit(f) for i in range(runs)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(f).select("node_id", "label")


def small_spectral_clusters(eigvecs: DataFrame, keys: list[str], k: int, seed: int = 42, runs: int = 10) -> DataFrame:
    """(keys, node_id, label): the same for many small graphs, one Arrow group each."""
    kinds = dict(eigvecs.dtypes)

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t.column("phi").to_pylist(), float)[:, 1 : k + 1]
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        best, label = np.inf, np.zeros(len(x), int)
        for r in range(runs):
            rng = np.random.default_rng(seed + r)
            c = x[[int(rng.integers(len(x)))]]
            while len(c) < min(k, len(x)):
                d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
                c = np.vstack([c, x[int(rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None))]])
            for _ in range(100):
                a = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                new = np.array([x[a == i].mean(0) if (a == i).any() else c[i] for i in range(len(c))])
                if np.allclose(new, c):
                    break
                c = new
            cost = ((x - c[a]) ** 2).sum()
            if cost < best:
                best, label = cost, a
        return pa.table({**{n: t.column(n) for n in keys}, "node_id": t.column("node_id"), "label": pa.array(label.astype(np.int32))})

    schema = ", ".join(f"{n} {kinds[n]}" for n in keys) + ", node_id long, label int"
    return eigvecs.groupBy(*keys).applyInArrow(run, schema)
