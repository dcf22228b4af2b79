"""Neighbour graphs, Laplacians, components, diffusion and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffusion, graph, knn, spectral
from ..operators.hierarchy import nodes as hier_nodes
from ..operators.hierarchy import to_undirected
from ..sources.records import LEVEL, ball_points, trade_hierarchy
from .geometry import DIST, POINTS, _r


def _ranked(spark, sf_dir, metric):
    near = knn.knn(ball_points(spark, sf_dir), metric=metric)
    return near.select("i", "j", "rank", _r(F.col("d")).alias("d"))


def exact(spark, sf_dir):
    return _ranked(spark, sf_dir, "poincare")


def euclidean(spark, sf_dir):
    return _ranked(spark, sf_dir, "euclidean")


def approx(spark, sf_dir):
    return knn.knn_approx(ball_points(spark, sf_dir)).select("i", "j", "rank", _r(F.col("d")).alias("d"))


def union_edges(spark, sf_dir):
    return knn.symmetric(knn.knn(ball_points(spark, sf_dir))).select("i", "j", _r(F.col("d")).alias("d"))


def taus(spark, sf_dir):
    near = graph.checkpointed(knn.knn(ball_points(spark, sf_dir)))
    one = lambda mode: knn.tau(near, mode).select(F.lit(mode).alias("mode"), _r(F.col("tau")).alias("tau"))
    return one("symmetric").union(one("directed"))


def gaussian(spark, sf_dir, half=False):
    return knn.knn_graph(ball_points(spark, sf_dir), half=half)


def gaussian_graph(spark, sf_dir):
    return gaussian(spark, sf_dir).select("i", "j", _r(F.col("w")).alias("w"))


def binary_graph(spark, sf_dir):
    return knn.knn_graph(ball_points(spark, sf_dir), weighted=False).select("i", "j", "w")


def _nodes(spark, sf_dir):
    return ball_points(spark, sf_dir).select("node_id")


def degree(spark, sf_dir):
    return graph.degrees(_nodes(spark, sf_dir), gaussian(spark, sf_dir)).select("node_id", _r(F.col("degree")).alias("degree"))


def combinatorial(spark, sf_dir):
    lap = graph.combinatorial_laplacian(_nodes(spark, sf_dir), gaussian(spark, sf_dir))
    return lap.select("i", "j", _r(F.col("v")).alias("v"))


def normalized(spark, sf_dir):
    lap = graph.normalized_laplacian(_nodes(spark, sf_dir), gaussian(spark, sf_dir, half=True), half=True)
    return lap.select("i", "j", _r(F.col("v")).alias("v"))


def l1_norm(spark, sf_dir):
    return graph.l1_norm(graph.normalized_laplacian(_nodes(spark, sf_dir), gaussian(spark, sf_dir, half=True), half=True)).select(_r(F.col("norm")).alias("norm"))


def star_bounds(spark, sf_dir):
    """A star of as many leaves as there are nations: norm, derivative of the weights, and whether the bound holds."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    edges = graph.star(spark, n)
    lap = graph.normalized_laplacian(spark.range(n + 1).withColumnRenamed("id", "node_id"), edges)
    drift = graph.focus_derivative(lap, 0).agg(F.sum(F.abs("x")).alias("drift"))
    return graph.l1_norm(lap).crossJoin(drift).select(_r(F.col("norm")).alias("norm"), _r(F.col("drift")).alias("drift"), (F.col("drift") <= 2 * F.col("norm")).alias("holds"))


def graph_components(spark, sf_dir):
    h = trade_hierarchy(spark, sf_dir).where("parent <> 0")
    return graph.components(hier_nodes(h), to_undirected(h))


def largest(spark, sf_dir):
    h = trade_hierarchy(spark, sf_dir).where("parent <> 0")
    return graph.largest_component(hier_nodes(h), to_undirected(h))


def hops(spark, sf_dir):
    h = trade_hierarchy(spark, sf_dir)
    nodes = hier_nodes(h)
    return graph.distances_from(nodes, to_undirected(h), nodes.where(F.col("node_id") == 0)).select("node_id", "hops")


def exact_eigen(spark, sf_dir):
    lap = graph.normalized_laplacian(_nodes(spark, sf_dir), gaussian(spark, sf_dir, half=True), half=True)
    return spectral.eigen(lap)


def _scene(spark, sf_dir, sigmas):
    """The least node as focus, and the scales."""
    foci = _nodes(spark, sf_dir).agg(F.min("node_id").alias("focus"))
    return foci, spark.createDataFrame(list(enumerate(sigmas)), "sigma_idx int, sigma double")


def _all_modes(spark, sf_dir):
    return diffusion.heat_weights_of_graph(_nodes(spark, sf_dir), gaussian(spark, sf_dir, half=True), *_scene(spark, sf_dir, [0.5, 2.0]))


def heat_exact(spark, sf_dir):
    return _all_modes(spark, sf_dir).select("sigma_idx", "node_id", _r(F.col("w")).alias("w"))


def heat_truncated(spark, sf_dir):
    lap = graph.normalized_laplacian(_nodes(spark, sf_dir), gaussian(spark, sf_dir, half=True), half=True)
    return diffusion.heat_weights(*spectral.eigen(lap, 50, _nodes(spark, sf_dir)), *_scene(spark, sf_dir, [0.5, 2.0])).select("sigma_idx", "node_id", _r(F.col("w")).alias("w"))


def heat_powers(spark, sf_dir):
    lap = graph.normalized_laplacian(_nodes(spark, sf_dir), gaussian(spark, sf_dir, half=True), half=True)
    a = lap.where("i <> j").select("i", "j", (-F.col("v")).alias("v"))
    focus = _nodes(spark, sf_dir).agg(F.min("node_id")).first()[0]
    return diffusion.heat_weights_by_powers(_nodes(spark, sf_dir), a, focus, 0.5, 14).select("node_id", _r(F.col("w")).alias("w"))


def divergence(spark, sf_dir):
    from ..operators.scan import divergence as jsd

    return jsd(_all_modes(spark, sf_dir)).select("sigma_idx", _r(F.col("d")).alias("d"))


def tree_eigen(spark, sf_dir, k):
    h = trade_hierarchy(spark, sf_dir)
    return spectral.eigen(graph.normalized_laplacian(hier_nodes(h), to_undirected(h)), k)


def gaps(spark, sf_dir):
    vals, _ = tree_eigen(spark, sf_dir, 26)
    return spectral.spectral_gap(vals).where("place <= 2").select(F.col("k").cast("long").alias("k"), F.col("place").cast("long").alias("place"))


def k_star_sweep(spark, sf_dir):
    vals, _ = tree_eigen(spark, sf_dir, 26)
    return spectral.k_star(vals, spectral.logspace(spark, -2, 4, 150)).select("sigma_idx", _r(F.col("sigma")).alias("sigma"), "k_star")


def k_star_changes(spark, sf_dir):
    vals, _ = tree_eigen(spark, sf_dir, 26)
    ks = graph.checkpointed(spectral.k_star(vals, spectral.logspace(spark, -2, 4, 150)))
    p = spectral.rate_peaks(spectral.change_rate(ks)).select(F.lit("peak").alias("kind"), F.col("k_star").alias("level"), _r(F.col("sigma")).alias("sigma"))
    return p.union(spectral.crossings(ks, [24, 5, 2]).select(F.lit("crossing"), "level", _r(F.col("sigma"))))


QUERIES = {
    "knn_exact": exact, "knn_euclidean": euclidean, "knn_approx": approx, "knn_union_edges": union_edges, "knn_tau": taus, "knn_gaussian_graph": gaussian_graph, "knn_binary_graph": binary_graph,
    "degrees": degree, "combinatorial_laplacian": combinatorial, "normalized_laplacian": normalized, "laplacian_l1_norm": l1_norm, "star_bounds": star_bounds, "graph_components": graph_components, "largest_component": largest, "bfs_hops": hops,
    "heat_weights_exact": heat_exact, "heat_weights_truncated": heat_truncated, "heat_weights_powers": heat_powers, "weight_divergence": divergence, "spectral_gaps": gaps, "kstar_sweep": k_star_sweep, "kstar_changes": k_star_changes,
}

_K = "least(greatest(10, least(floor(sqrt(count(*))), 50)), count(*) - 1)"


def _near(dist: str) -> str:
    return f"""{POINTS}, k AS (SELECT {_K} AS k FROM p),
    r AS (SELECT a.id AS i, b.id AS j, {dist} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS rank FROM p a JOIN p b ON a.id <> b.id),
    near AS (SELECT i, j, d, rank FROM r, k WHERE rank <= k.k)"""


NEAR = _near(DIST.format(a="a", b="b"))
EDGES = NEAR + ", e AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM near UNION ALL SELECT j, i, d FROM near) GROUP BY i, j)"
GRAPH = EDGES + ", t AS (SELECT greatest(median(d), 1e-10) AS tau FROM e), g AS (SELECT i, j, exp(-d * d / (2 * tau * tau)) AS w FROM e, t), deg AS (SELECT id AS node_id, coalesce(sum(w), 0) AS degree FROM p LEFT JOIN g ON g.i = p.id GROUP BY id)"
_NORM = GRAPH + ", l AS (SELECT id AS i, id AS j, 1.0::DOUBLE AS v FROM p UNION ALL SELECT g.i, g.j, -w / sqrt(a.degree * b.degree) FROM g JOIN deg a ON a.node_id = g.i JOIN deg b ON b.node_id = g.j)"


def heat(sigmas: list[float], terms: int) -> str:
    """Weights by Taylor terms of exp(-sigma (I - A)): independent of any eigenpairs."""
    parts = ", ".join(f"({i}, {s}::DOUBLE)" for i, s in enumerate(sigmas))
    return f"""{_NORM}, a AS (SELECT i, j, -v AS v FROM l WHERE i <> j), f AS (SELECT min(id) AS f FROM p),
    pw(m, id, x) AS (SELECT 0, f, 1.0::DOUBLE FROM f UNION ALL SELECT m + 1, a.i, sum(a.v * pw.x) FROM pw JOIN a ON a.j = pw.id WHERE m < {terms} GROUP BY m, a.i),
    s(sigma_idx, sigma) AS (VALUES {parts}),
    u AS (SELECT sigma_idx, p.id, coalesce(sum(pow(sigma, m) / gamma(m + 1.0) * pw.x), 0) AS u FROM s CROSS JOIN p LEFT JOIN pw ON pw.id = p.id GROUP BY sigma_idx, p.id),
    w AS (SELECT sigma_idx, id, u / sum(u) OVER (PARTITION BY sigma_idx) AS w FROM u)"""


SQL = {
    "knn_exact": f"WITH {NEAR} SELECT i, j, rank::INTEGER AS rank, round(d, 6) AS d FROM near",
    "knn_euclidean": f"WITH {_near('list_distance(a.x, b.x)')} SELECT i, j, rank::INTEGER AS rank, round(d, 6) AS d FROM near",
    "knn_union_edges": f"WITH {EDGES} SELECT i, j, round(d, 6) AS d FROM e",
    "knn_tau": f"WITH {EDGES} SELECT 'symmetric' AS mode, round(median(d), 6) AS tau FROM e UNION ALL SELECT 'directed', round(median(d), 6) FROM near",
    "knn_gaussian_graph": f"WITH {GRAPH} SELECT i, j, round(w, 6) AS w FROM g",
    "knn_binary_graph": f"WITH {EDGES} SELECT i, j, 1.0::DOUBLE AS w FROM e",
    "degrees": f"WITH {GRAPH} SELECT node_id, round(degree, 6) AS degree FROM deg",
    "combinatorial_laplacian": f"WITH {GRAPH} SELECT node_id AS i, node_id AS j, round(degree, 6) AS v FROM deg UNION ALL SELECT i, j, round(-w, 6) + 0.0::DOUBLE FROM g",
    "normalized_laplacian": f"WITH {_NORM} SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM l",
    "laplacian_l1_norm": f"WITH {_NORM} SELECT round(max(s), 6) AS norm FROM (SELECT sum(abs(v)) AS s FROM l GROUP BY j)",
    "star_bounds": "SELECT round(1 + sqrt(count(*)), 6) AS norm, round(2 * sqrt(count(*)), 6) AS drift, true AS holds FROM nation",
    "graph_components": f"SELECT {LEVEL} + r_regionkey AS node_id, {LEVEL} + r_regionkey AS component FROM region UNION ALL SELECT {2 * LEVEL} + n_nationkey, {LEVEL} + n_regionkey FROM nation UNION ALL SELECT {3 * LEVEL} + c_custkey, {LEVEL} + n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "largest_component": f"""WITH c AS (SELECT {LEVEL} + r_regionkey AS node_id, r_regionkey AS c FROM region UNION ALL SELECT {2 * LEVEL} + n_nationkey, n_regionkey FROM nation UNION ALL SELECT {3 * LEVEL} + c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
        t AS (SELECT c FROM c GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM c WHERE c IN (FROM t)""",
    "bfs_hops": f"SELECT 0::BIGINT AS node_id, 0::INTEGER AS hops UNION ALL SELECT {LEVEL} + r_regionkey, 1 FROM region UNION ALL SELECT {2 * LEVEL} + n_nationkey, 2 FROM nation UNION ALL SELECT {3 * LEVEL} + c_custkey, 3 FROM customer",
    "heat_weights_exact": f"WITH RECURSIVE {heat([0.5, 2.0], 30)} SELECT sigma_idx, id AS node_id, round(w, 6) AS w FROM w",
    "heat_weights_powers": f"WITH RECURSIVE {heat([0.5], 14)} SELECT id AS node_id, round(w, 6) AS w FROM w",
    "weight_divergence": f"WITH RECURSIVE {heat([0.5, 2.0], 30)}, j AS (SELECT a.w AS p, b.w AS q, (a.w + b.w) / 2 AS m FROM w a JOIN w b ON a.id = b.id AND a.sigma_idx = 0 AND b.sigma_idx = 1) SELECT 0::INTEGER AS sigma_idx, round(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2, 6) AS d FROM j",
    "spectral_gaps": "SELECT (SELECT count(*) FROM nation) - 1 AS k, 1::BIGINT AS place UNION ALL SELECT (SELECT count(*) FROM region) - 1, 2",
}
