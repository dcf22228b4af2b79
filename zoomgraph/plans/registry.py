"""The library's registered queries and their SQL."""

from __future__ import annotations

from . import evaluation, geometry, graphs, hierarchies, scans, sweeps

PARTS = (geometry, graphs, scans, hierarchies, evaluation, sweeps)


def flagship(spark, sf_dir):
    """Boundary scan over the trade hierarchy: (focus, sigma, s, k_star) of every step of a few foci."""
    return scans.boundary_scan_tree(spark, sf_dir)


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.SQL.items()}
