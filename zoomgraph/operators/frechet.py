"""Weighted Fréchet means in the ball and what is built of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import geometry as G
from .graph import checkpointed


def _plain(t: pa.Table, keys: list[str], mean: np.ndarray) -> pa.Table:
    return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "x": pa.array([mean.tolist()])})


def check_ball(points: DataFrame) -> None:
    """Raise if a point is not inside the unit ball."""
    if points.where(~(G.sq_norm("x") < 1)).limit(1).count():
        raise ValueError("points must lie inside the unit ball; use project_to_ball")


def frechet_means(weights: DataFrame, points: DataFrame, keys: list[str], metric: str = "poincare", n_iter: int = 15, tol: float = 1e-6) -> DataFrame:
    """(keys, x): the mean of points(node_id, x) under weights(keys, node_id, w), for each key.

    Groups are summaries of one scale and hold each node once; ties of the largest weight go to the least id."""
    kinds = dict(weights.dtypes)

    def mean(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node_id").to_numpy(), kind="stable")
        x = np.array(t.column("x").to_pylist(), float)[order]
        return _plain(t, keys, arrays.frechet_mean(x, t.column("w").to_numpy()[order], n_iter, tol=tol, metric=metric))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x array<double>"
    return weights.join(points.select("node_id", "x"), "node_id").groupBy(*keys).applyInArrow(mean, schema)


def frechet_mean_distributed(points: DataFrame, n_iter: int = 15, tol: float = 1e-6) -> list[float]:
    """The mean of points(node_id, x, w) where they are too many for one task: a partial sum a step."""
    total = points.agg(F.sum("w"), F.min("w")).first()
    if total[0] is None or total[1] < 0 or total[0] <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    mean = np.array(points.orderBy(F.desc("w"), "node_id").limit(1).first()["x"])
    for _ in range(n_iter):
        v = G.log_map(F.array(*[F.lit(float(c)) for c in mean]), F.col("x"))
        row = points.select((F.col("w") / total[0]).alias("w"), v.alias("v")).agg(*[F.sum(F.col("w") * F.col("v")[i]) for i in range(len(mean))]).first()
        step = np.array(row)
        mean = arrays.exp_map(mean, step)
        if np.linalg.norm(step) < tol:
            break
    return arrays.project(mean).tolist()


def scale_summary(eigvals: DataFrame, eigvecs: DataFrame, points: DataFrame, foci: DataFrame, grid: DataFrame) -> DataFrame:
    """(focus, sigma_idx, sigma, x): the combined operator, weights then mean, at each scale."""
    from .diffusion import heat_weights

    return frechet_means(heat_weights(eigvals, eigvecs, foci, grid), points, ["focus", "sigma_idx", "sigma"])


def multi_center(points: DataFrame, k: int, rounds: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Riemannian k-means of points(node_id, x): (assignment(node_id, center), centers(center, x)).

    Centres start at the k points of least hash; each round assigns every point to the nearest centre and
    moves the centre one Karcher step, a partial sum over tasks. Only the k centres go to the driver."""
    rows = points.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(k).collect()
    centers = np.array([r["x"] for r in rows], float)
    d = centers.shape[1] if len(centers) else 0

    def assign(sent):
        def run(batches):
            for b in batches:
                x = np.array(b.column("x").to_pylist(), float).reshape(-1, d)
                at = arrays.distances(x, sent).argmin(1) if len(x) else np.zeros(0, int)
                v = arrays.log_map(sent[at], x) if len(x) else x
                yield pa.RecordBatch.from_arrays([b.column("node_id"), pa.array(at.astype(np.int32)), pa.array(v.tolist(), pa.list_(pa.float64()))], ["node_id", "center", "v"])

        return run

    flat = points.select("node_id", "x")
    for _ in range(rounds if len(centers) else 0):
        step = flat.mapInArrow(assign(centers), "node_id long, center int, v array<double>")
        sums = {r["center"]: np.array(r[1:]) for r in step.groupBy("center").agg(*[F.avg(F.col("v")[i]) for i in range(d)]).collect()}
        moved = np.array([arrays.exp_map(c, sums[i]) if i in sums else c for i, c in enumerate(centers)])
        done = np.abs(moved - centers).max() < 1e-9
        centers = moved
        if done:
            break
    out = checkpointed(flat.mapInArrow(assign(centers), "node_id long, center int, v array<double>").select("node_id", "center"))
    return out, points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "center int, x array<double>")
