"""Numpy twins of the geometry, for whole blocks inside Arrow functions."""

from __future__ import annotations

import numpy as np

EDGE = 1 - 1e-7


def project(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(n >= 1 - eps, x * ((1 - eps) / np.maximum(n, 1e-300)), x)


def distances(x: np.ndarray, y: np.ndarray, metric: str = "poincare") -> np.ndarray:
    """All distances between the rows of x and of y. Near pairs are recomputed without cancellation."""
    if metric not in ("poincare", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    d2 = np.maximum(xx[:, None] + yy[None, :] - 2 * x @ y.T, 0)
    near = np.argwhere(d2 < 1e-6 * (1 + xx[:, None]))
    if len(near):
        i, j = near.T
        d2[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    if metric == "euclidean":
        return np.sqrt(d2)
    return 2 * np.arcsinh(np.sqrt(d2 / ((1 - xx)[:, None] * (1 - yy)[None, :])))


def mobius_add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    xy, xx, yy = (x * y).sum(-1, keepdims=True), (x * x).sum(-1, keepdims=True), (y * y).sum(-1, keepdims=True)
    return ((1 + 2 * xy + yy) * x + (1 - xx) * y) / (1 + 2 * xy + xx * yy)


def log_map(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = mobius_add(-x, y)
    n = np.linalg.norm(w, axis=-1, keepdims=True)
    safe = np.where(n > 0, n, 1)
    return np.where(n > 0, (1 - (x * x).sum(-1, keepdims=True)) * np.arctanh(np.minimum(n, EDGE)) / safe * w, 0)


def exp_map(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    safe = np.where(n > 0, n, 1)
    y = mobius_add(x, np.tanh(n / np.maximum(1 - (x * x).sum(-1, keepdims=True), 1e-10)) * v / safe)
    return project(np.where(n > 0, y, x))


def frechet_mean(points: np.ndarray, weights: np.ndarray, n_iter: int = 15, lr: float = 1.0, tol: float = 1e-6, metric: str = "poincare") -> np.ndarray:
    """Weighted mean by at most n_iter Karcher steps from the first point of largest weight."""
    points, weights = np.asarray(points, float), np.asarray(weights, float)
    if points.ndim != 2 or weights.shape != (len(points),):
        raise ValueError("points must be (n, d) and weights (n,)")
    if (weights < 0).any() or not weights.sum() > 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    w = weights / weights.sum()
    if metric == "euclidean":
        return w @ points
    if len(points) == 1:
        return project(points[0])
    mean = points[int(np.argmax(w))].copy()
    for _ in range(n_iter):
        step = lr * (w @ log_map(mean[None, :], points))
        mean = exp_map(mean, step)
        if np.linalg.norm(step) < tol:
            break
    return project(mean)
