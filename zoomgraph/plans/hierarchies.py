"""The trade hierarchy: ancestors, depths, leaves, samples and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, hierarchy, metrics
from ..sources.records import LEVEL, trade_hierarchy
from .geometry import _r
from .scans import tree_points


def ancestors(spark, sf_dir):
    return hierarchy.ancestors(trade_hierarchy(spark, sf_dir, 4))


def depths(spark, sf_dir):
    return hierarchy.depths(trade_hierarchy(spark, sf_dir, 4))


def leaves(spark, sf_dir):
    return hierarchy.leaves(trade_hierarchy(spark, sf_dir, 4))


def subtree(spark, sf_dir):
    h = trade_hierarchy(spark, sf_dir, 4)
    return hierarchy.subtree(h, hierarchy.depths(h), 2)


def undirected(spark, sf_dir):
    return hierarchy.to_undirected(trade_hierarchy(spark, sf_dir)).select("i", "j", "w")


def siblings(spark, sf_dir):
    return hierarchy.sibling_counts(trade_hierarchy(spark, sf_dir, 4))


def sibling_sample(spark, sf_dir):
    return hierarchy.sibling_sample(trade_hierarchy(spark, sf_dir))


def stratified(spark, sf_dir):
    h = trade_hierarchy(spark, sf_dir, 4)
    return hierarchy.stratified_leaves(hierarchy.leaves(h).join(hierarchy.depths(h), "node_id"), 100)


def depth_of_scale(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") / 10.0).alias("sigma"))
    return s.select("p_partkey", _r(hierarchy.sigma_to_depth(F.col("sigma"), 0.01, 100.0, 12)).alias("depth"), F.bround(hierarchy.sigma_to_depth(F.col("sigma"), 0.01, 100.0, 12)).cast("long").alias("level"))


def nearest_ancestor(spark, sf_dir):
    h = trade_hierarchy(spark, sf_dir)
    d = hierarchy.depths(h)
    found = d.where("depth = 3").select(F.col("node_id").alias("focus"), (F.col("node_id") % 7 / 2.0).alias("depth_hat"))
    return hierarchy.nearest_ancestor_depth(found, hierarchy.ancestors(h), d)


def _numbered(spark, sf_dir):
    p = tree_points(spark, sf_dir)
    return p.join(graph.numbered(p.select("node_id")), "node_id")


def preservation(spark, sf_dir):
    p = graph.checkpointed(_numbered(spark, sf_dir))
    pairs = trade_hierarchy(spark, sf_dir).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    return metrics.hierarchy_preservation(p, pairs).select(_r(F.col("share")).alias("share"), "n")


def proximity(spark, sf_dir):
    p = graph.checkpointed(_numbered(spark, sf_dir))
    pairs = hierarchy.sibling_sample(trade_hierarchy(spark, sf_dir)).select("a", "b")
    return metrics.hierarchy_preservation(p, pairs).select(_r(F.col("share")).alias("share"), "n")


def depth_correlation(spark, sf_dir):
    from ..functions.geometry import norm

    return metrics.pearson(tree_points(spark, sf_dir).select(norm("x").alias("x"), F.col("depth").cast("double").alias("y"))).select(_r(F.col("r")).alias("r"))


def nodes_at_depth(spark, sf_dir):
    return hierarchy.depths(trade_hierarchy(spark, sf_dir, 4)).groupBy("depth").agg(F.count("*").alias("n"), F.min("node_id").alias("least"))


def rank_of_ancestors(spark, sf_dir):
    """A peak a customer, at a depth that its id gives, ranked from the customer's own point."""
    p = tree_points(spark, sf_dir)
    foci = p.where("depth = 3").select(F.col("node_id").alias("peak"), F.col("node_id").alias("focus"), (F.col("node_id") % 7 / 2).alias("depth_hat"), "x")
    return metrics.reciprocal_ranks(foci, hierarchy.ancestors(trade_hierarchy(spark, sf_dir)), p).select("peak", F.round("rr", 6).alias("rr"))


QUERIES = {"ancestors": ancestors, "hierarchy_depth": depths, "leaves": leaves, "subtree": subtree, "hierarchy_undirected": undirected, "sibling_counts": siblings, "sibling_sample": sibling_sample, "stratified_leaves": stratified, "sigma_to_depth": depth_of_scale, "nearest_ancestor_depth": nearest_ancestor, "hierarchy_preservation": preservation, "sibling_proximity": proximity, "depth_correlation": depth_correlation, "nodes_at_depth": nodes_at_depth, "reciprocal_ranks": rank_of_ancestors}


def _tree(levels: int) -> str:
    parts = [
        f"SELECT {LEVEL} + r_regionkey AS child, 0::BIGINT AS parent FROM region",
        f"SELECT {2 * LEVEL} + n_nationkey, {LEVEL} + n_regionkey FROM nation",
        f"SELECT {3 * LEVEL} + c_custkey, {2 * LEVEL} + c_nationkey FROM customer",
        f"SELECT {4 * LEVEL} + o_orderkey, {3 * LEVEL} + o_custkey FROM orders",
    ]
    return "h AS (" + " UNION ALL ".join(parts[:levels]) + ")"


_DEPTH = """dd(node_id, depth) AS (SELECT DISTINCT parent, 0 FROM h WHERE parent NOT IN (SELECT child FROM h) UNION ALL SELECT h.child, depth + 1 FROM dd JOIN h ON h.parent = dd.node_id),
    d AS (SELECT node_id, max(depth)::INTEGER AS depth FROM dd GROUP BY node_id)"""
_ANC = """aa(node, ancestor, hops) AS (SELECT child, parent, 1 FROM h UNION ALL SELECT node, h.parent, hops + 1 FROM aa JOIN h ON h.child = aa.ancestor),
    a AS (SELECT node, ancestor, min(hops)::INTEGER AS hops FROM aa GROUP BY node, ancestor)"""


def _u(*parts: str) -> str:
    return f"('0x' || substr(md5({' || '.join(f'({p})::VARCHAR || chr(58)' for p in parts)} || '42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


_LEAF = "l AS (SELECT node_id, depth FROM d WHERE node_id NOT IN (SELECT parent FROM h))"
_SIB = f"u AS (SELECT parent, child, {_u('child')} AS u FROM h), s AS (SELECT parent, child AS a, coalesce(lead(child) OVER q, first(child) OVER q) AS b FROM u WINDOW q AS (PARTITION BY parent ORDER BY u, child ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), sb AS (SELECT * FROM s WHERE a <> b)"
_XY = f"xy AS (SELECT node_id, depth, (0.05 + 0.25 * depth)::DOUBLE * cos(2 * pi() * {_u('node_id')}) AS x, (0.05 + 0.25 * depth)::DOUBLE * sin(2 * pi() * {_u('node_id')}) AS y, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM d)"
_D2 = "(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y)) / ((1 - {a}.x * {a}.x - {a}.y * {a}.y) * (1 - {b}.x * {b}.x - {b}.y * {b}.y))"


def _share(pairs: str) -> str:
    return f"""SELECT round(coalesce(avg(({_D2.format(a='p', b='q')} < {_D2.format(a='p', b='r')})::INTEGER), 0), 6) AS share, count(*) AS n FROM (SELECT a, b, floor({_u('a', 'b')} * (SELECT count(*) FROM xy))::BIGINT AS draw FROM {pairs})
        JOIN xy p ON p.node_id = a JOIN xy q ON q.node_id = b JOIN xy r ON r.idx = draw WHERE r.node_id <> a AND r.node_id <> b"""


_SCALE = "greatest(0, least(12.0::DOUBLE, (1 - (ln(p_size / 10.0::DOUBLE) - ln(0.01::DOUBLE)) / (ln(100.0::DOUBLE) - ln(0.01::DOUBLE) + 1e-10)) * 12))"
SQL = {
    "ancestors": f"WITH RECURSIVE {_tree(4)}, {_ANC} SELECT node, ancestor, hops FROM a",
    "hierarchy_depth": f"WITH RECURSIVE {_tree(4)}, {_DEPTH} SELECT node_id, depth FROM d",
    "leaves": f"WITH {_tree(4)} SELECT DISTINCT child AS node_id FROM h WHERE child NOT IN (SELECT parent FROM h)",
    "subtree": f"WITH {_tree(2)} SELECT child, parent FROM h",
    "hierarchy_undirected": f"WITH {_tree(3)} SELECT child AS i, parent AS j, 1.0::DOUBLE AS w FROM h UNION SELECT parent, child, 1.0 FROM h",
    "sibling_counts": f"WITH {_tree(4)} SELECT parent, count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM h GROUP BY parent HAVING count(*) >= 2",
    "sibling_sample": f"WITH {_tree(3)}, {_SIB} SELECT parent, a, b FROM sb",
    "stratified_leaves": f"""WITH RECURSIVE {_tree(4)}, {_DEPTH}, {_LEAF}, k AS (SELECT least(10, count(DISTINCT depth)) AS k FROM l),
        s AS (SELECT list(depth ORDER BY depth) AS s, count(*) AS n FROM l),
        c AS (SELECT i, k, list_transform(range(0, k + 1), lambda j: s[1 + floor(j / k::DOUBLE * (n - 1))::BIGINT] + (j / k::DOUBLE * (n - 1) - floor(j / k::DOUBLE * (n - 1))) * (s[1 + ceil(j / k::DOUBLE * (n - 1))::BIGINT] - s[1 + floor(j / k::DOUBLE * (n - 1))::BIGINT])) AS q FROM (SELECT k, unnest(range(0, k)) AS i FROM k), s),
        b AS (SELECT i, q[i + 1] AS lo, q[i + 2] + (i + 2 = len(q))::INTEGER AS hi FROM c),
        r AS (SELECT l.*, {_u('node_id')} AS u, row_number() OVER (PARTITION BY i ORDER BY {_u('node_id')}, node_id) AS r FROM l LEFT JOIN b ON depth >= lo AND depth < hi)
        SELECT node_id, depth FROM r ORDER BY (r > greatest(1, 100 // (SELECT k FROM k)))::INTEGER, u, node_id LIMIT 100""",
    "sigma_to_depth": f"SELECT p_partkey, round({_SCALE}, 6) + 0.0::DOUBLE AS depth, round_even({_SCALE}, 0)::BIGINT AS level FROM part",
    "nearest_ancestor_depth": f"WITH RECURSIVE {_tree(3)}, {_DEPTH}, {_ANC}, f AS (SELECT node_id AS focus, node_id % 7 / 2.0::DOUBLE AS depth_hat FROM d WHERE depth = 3) SELECT focus, depth_hat, arg_min(e.depth, (abs(e.depth - depth_hat), e.depth)) AS nearest FROM f JOIN a ON a.node = focus JOIN d e ON e.node_id = a.ancestor GROUP BY focus, depth_hat",
    "hierarchy_preservation": f"WITH RECURSIVE {_tree(3)}, {_DEPTH}, {_XY} {_share('(SELECT child AS a, parent AS b FROM h)')}",
    "sibling_proximity": f"WITH RECURSIVE {_tree(3)}, {_DEPTH}, {_XY}, {_SIB} {_share('sb')}",
    "depth_correlation": f"WITH RECURSIVE {_tree(3)}, {_DEPTH}, {_XY} SELECT round(corr(sqrt(x * x + y * y), depth), 6) AS r FROM xy",
    "reciprocal_ranks": f"""WITH RECURSIVE {_tree(3)}, {_DEPTH}, {_ANC}, {_XY}, f AS (SELECT *, round_even(node_id % 7 / 2.0::DOUBLE, 0)::INTEGER AS level FROM xy WHERE depth = 3),
        c AS (SELECT p.node_id AS peak, q.node_id AS cand, row_number() OVER (PARTITION BY p.node_id ORDER BY {_D2.format(a='p', b='q')}, q.node_id) AS k FROM f p JOIN xy q ON q.depth = p.level WHERE p.level < 3),
        b AS (SELECT peak, min(k) AS k FROM c JOIN a ON a.node = peak AND a.ancestor = cand GROUP BY peak)
        SELECT f.node_id AS peak, round(coalesce(1.0::DOUBLE / k, 0), 6) AS rr FROM f LEFT JOIN b ON b.peak = f.node_id""",
    "nodes_at_depth": f"WITH RECURSIVE {_tree(4)}, {_DEPTH} SELECT depth, count(*) AS n, min(node_id) AS least FROM d GROUP BY depth",
}
