"""Scoring one configuration of a sweep: scan from a focus, best peak, clusters at its scale, agreement with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .clustering import spectral_clusters
from .graph import checkpointed
from .scan import best_peak, boundary_scan


def score_config(points: DataFrame, eigvals: DataFrame, eigvecs: DataFrame, labels: DataFrame, focus: int = 0, levels: dict[str, int] | None = None, alpha=(1 / 3, 1 / 3, 1 / 3), peak_alpha: float = 1.0, grid: DataFrame | None = None, runs: int = 10) -> DataFrame:
    """One row (n_peaks, sigma_best, k_star_best, ari_<level>, nmi_<level> ...) of the scan from ``focus``.

    levels: columns of labels(node_id, ...) and their numbers of clusters, by default macro 2 and meso 8. The eigenpairs
    may be of the kNN graph's Laplacian or of the graph's own; the points are the same for both."""
    spark = points.sparkSession
    one = spark.createDataFrame([(focus,)], "focus long")
    scan = checkpointed(boundary_scan(points, eigvals, eigvecs, one, grid, alpha, peak_alpha)["scan"])
    best = best_peak(scan).first()
    out = scan.agg(F.count_if("is_peak").alias("n_peaks")).select("n_peaks", F.lit(best["sigma"]).alias("sigma_best"), F.lit(best["k_star"]).alias("k_star_best"))
    for level, k in (levels or {"macro": 2, "meso": 8}).items():
        found = spectral_clusters(eigvals, eigvecs, k, best["sigma"], runs)
        pairs = checkpointed(labels.select("node_id", F.col(level).alias("t")).join(found.withColumnRenamed("label", "p"), "node_id").select("t", "p"))
        out = out.crossJoin(metrics.adjusted_rand_index(pairs).toDF(f"ari_{level}")).crossJoin(metrics.normalized_mutual_info(pairs).toDF(f"nmi_{level}"))
    return out
