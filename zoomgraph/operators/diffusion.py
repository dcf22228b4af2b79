"""Heat-kernel weights of a focus node over a graph, from eigenpairs, by polynomials of the Laplacian or by powers of the
adjacency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import total
from .graph import Packed, both


def heat_weights(eigvals: DataFrame, eigvecs: DataFrame, foci: DataFrame, grid: DataFrame) -> DataFrame:
    """(focus, sigma_idx, sigma, node_id, w): sum_k exp(-sigma lambda_k) phi_k(focus) phi_k(node).

    Negative values become 0 and the rest is normalised; where all are 0 the weights are uniform. foci(focus)
    and grid(sigma_idx, sigma) are small. With fewer modes than nodes the kernel is truncated."""
    lam = eigvals.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lambda"))), lambda x: x["lambda"]).alias("lam"))
    heat = foci.join(eigvecs.withColumnRenamed("node_id", "focus"), "focus").withColumnRenamed("phi", "phi_f")
    heat = heat.crossJoin(F.broadcast(lam)).crossJoin(F.broadcast(grid))
    heat = heat.select("focus", "sigma_idx", "sigma", F.zip_with("phi_f", "lam", lambda p, x: p * F.exp(-F.col("sigma") * x)).alias("h"))
    raw = eigvecs.crossJoin(F.broadcast(heat)).select("focus", "sigma_idx", "sigma", "node_id", F.greatest(total(F.zip_with("phi", "h", lambda a, b: a * b)), F.lit(0.0)).alias("u"))
    by = Window.partitionBy("focus", "sigma_idx")
    z, n = F.sum("u").over(by), F.count("*").over(by)
    return raw.select("focus", "sigma_idx", "sigma", "node_id", F.when(z > 0, F.col("u") / z).otherwise(1.0 / n).alias("w"))


def heat_weights_at(eigvals: DataFrame, eigvecs: DataFrame, focus: int, sigma: float) -> DataFrame:
    """(node_id, w) of one focus and scale; at scale 0 exactly the focus. An unknown focus is an error."""
    spark = eigvecs.sparkSession
    if not eigvecs.where(F.col("node_id") == focus).limit(1).count():
        raise ValueError(f"no node {focus}")
    if sigma == 0:
        return eigvecs.select("node_id", (F.col("node_id") == focus).cast("double").alias("w"))
    one = spark.createDataFrame([(focus,)], "focus long")
    return heat_weights(eigvals, eigvecs, one, spark.createDataFrame([(0, float(sigma))], "sigma_idx int, sigma double")).select("node_id", "w")


def chebyshev(sigmas: list[float], bound: float) -> np.ndarray:
    """Coefficients [sigma, m] of exp(-sigma x) on [0, bound] in Chebyshev polynomials, as far as they exceed 1e-17.

    They are Bessel functions: I_m(z) exp(-z) (-1)^m, twice for m > 0, by downward recurrence at z = sigma * bound / 2."""
    rows = []
    for z in (s * bound / 2 for s in sigmas):
        n = int(12 * z**0.5) + 60
        c = np.zeros(n + 2)
        c[n if z else 0] = 1e-300 if z else 1.0
        for m in range(n if z else 0, 0, -1):
            c[m - 1] = c[m + 1] + 2 * m / z * c[m]
            if c[m - 1] > 1e200:
                c /= c[m - 1]
        c[1:] *= 2
        rows.append(c / c.sum() * (-1.0) ** np.arange(len(c)))
    out = np.zeros((len(rows), max(map(len, rows), default=1)))
    for r, c in zip(out, rows, strict=True):
        r[: len(c)] = c
    return out[:, : 1 + max(np.flatnonzero(np.abs(out).max(0, initial=0) > 1e-17), default=0)]


def heat_weights_exact(nodes: DataFrame, laplacian: DataFrame, foci: DataFrame, grid: DataFrame, bound: float | None = None) -> DataFrame:
    """(focus, sigma_idx, sigma, node_id, w) as by heat_weights from all eigenpairs, but without any: exp(-sigma L) e_focus
    in Chebyshev polynomials of L, to the rounding of doubles, so all modes count.

    bound: no eigenvalue is larger (2 for a normalised Laplacian); the largest absolute row sum if not given. All scales
    share one product a degree; about sigma * bound / 2 + 20 are needed at small scales. A focus that is no node has no rows."""
    packed = Packed(nodes, laplacian)
    return _by_polynomials(packed, packed.times, foci, grid, bound or packed.bound() or 1.0)


def heat_weights_of_graph(nodes: DataFrame, halves: DataFrame, foci: DataFrame, grid: DataFrame) -> DataFrame:
    """heat_weights_exact for the normalised Laplacian of edges(i, j, w), each there once: the weights are packed and the
    degrees are one product, so no entry is joined with a degree."""
    packed = Packed(nodes, both(halves.select("i", "j", F.col("w").alias("v"))))
    degree = packed.times(np.ones(len(packed.ids)))
    s = np.divide(1, np.sqrt(degree), out=np.zeros(len(degree)), where=degree > 0)[:, None]
    return _by_polynomials(packed, lambda x: x - s * packed.times(s * x), foci, grid, 2.0)


def _by_polynomials(packed: Packed, times, foci: DataFrame, grid: DataFrame, bound: float) -> DataFrame:
    """Chebyshev polynomials of the matrix that ``times`` multiplies by."""
    at = {f: int(i) for f in sorted({r[0] for r in foci.collect()}) if (i := np.searchsorted(packed.ids, f)) < len(packed.ids) and packed.ids[i] == f}
    scales = sorted((r["sigma_idx"], r["sigma"]) for r in grid.collect())
    coef = chebyshev([s for _, s in scales], bound)
    now = np.zeros((len(packed.ids), len(at)))
    now[list(at.values()), range(len(at))] = 1
    first, u = now, coef[:, 0, None, None] * now
    for m in range(1, coef.shape[1] if at else 0):
        y = times(now)
        if m == 1:
            own = (y * first).sum(0)
            alone = ~((y != 0) & (first == 0)).any(0)
        turned = 2 / bound * y - now
        before, now = now, turned if m == 1 else 2 * turned - before
        u += coef[:, m, None, None] * now
    if coef.shape[1] > 1 and at:  # what an isolated focus keeps may be less than the rounding of 1
        u[:, :, alone] = (np.exp(-np.outer([s for _, s in scales], own))[:, None] * first)[:, :, alone]
    u = np.maximum(u, 0)
    z = u.sum(1, keepdims=True)
    w = np.where(z > 0, u / np.where(z > 0, z, 1), 1 / max(1, len(packed.ids)))
    labels = [(f, i, s) for i, s in scales for f in at]
    return packed.table(np.moveaxis(w, 2, 1).reshape(len(labels), -1), labels, "focus long, sigma_idx int, sigma double")


def heat_weights_by_powers(nodes: DataFrame, affinity: DataFrame, focus: int, sigma: float, terms: int | None = None) -> DataFrame:
    """(node_id, w) without eigenpairs: exp(-sigma) sum_m sigma^m / m! A^m e_f for L = I - A.

    Each power is one pass over packed rows, so this serves graphs that no single task can hold."""
    terms = terms or int(sigma + 6 * sigma**0.5 + 10)
    packed = Packed(nodes, affinity)
    power = (packed.ids == focus).astype(float)
    out, coef = power.copy(), 1.0
    for m in range(1, terms + 1):
        coef *= sigma / m
        power = packed.times(power)
        out += coef * power
    total = out.sum()
    return packed.table(out[None] / total if total else out[None] * np.nan, [()], "")
