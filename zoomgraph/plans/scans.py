"""Indicators, scores, peaks and whole boundary scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frechet, hierarchy, knn, scan
from ..operators.spectral import logspace
from ..sources.records import ball_points, table, trade_hierarchy
from .geometry import DIST, POINTS, _r
from .graphs import tree_eigen


def _phi(spark, sf_dir):
    """All points as the summaries of one focus, their ids as scales."""
    p = ball_points(spark, sf_dir)
    return p.select(F.lit(0).cast("long").alias("focus"), F.col("node_id").cast("int").alias("sigma_idx"), (F.col("node_id") * F.col("node_id") + 1).cast("double").alias("sigma"), "x")


def velocity(spark, sf_dir):
    return scan.velocity(_phi(spark, sf_dir)).select("sigma_idx", _r(F.col("v")).alias("v"))


def churn(spark, sf_dir):
    """Each point is a summary, so its nearest points are its neighbours in the kNN graph and itself."""
    p = ball_points(spark, sf_dir)
    d = knn.knn(p, 10).select("i", "j", "d").union(p.select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(0.0).alias("d")))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    near = d.withColumn("r", rank).where("r <= 10").groupBy(F.lit(0).cast("long").alias("focus"), F.col("i").cast("int").alias("sigma_idx")).agg(F.sort_array(F.collect_list("j")).alias("near"))
    return scan.set_churn(near).select("sigma_idx", _r(F.col("c")).alias("c"))


def profile(spark, sf_dir):
    """Daily counts, sums and distinct users of five groups of users, as three indicators."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("int")
    return e.groupBy((F.col("user_id") % 5).alias("focus"), day.alias("sigma_idx")).agg(F.count("*").cast("double").alias("v"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("d"), F.countDistinct("user_id").cast("double").alias("c"))


def zscores(spark, sf_dir):
    return scan.composite(profile(spark, sf_dir), (0.5, 0.25, 0.25)).select("focus", "sigma_idx", _r(F.col("s")).alias("s"))


def threshold(spark, sf_dir):
    s = scan.composite(profile(spark, sf_dir), (0.5, 0.25, 0.25))
    return scan.mad_threshold(s).select("focus", _r(F.col("threshold")).alias("threshold"))


def peaks(spark, sf_dir):
    s = scan.composite(profile(spark, sf_dir), (0.5, 0.25, 0.25))
    return scan.peaks(s, scan.mad_threshold(s), 1)


def peaks_apart(spark, sf_dir):
    s = scan.composite(profile(spark, sf_dir), (0.5, 0.25, 0.25))
    return scan.peaks(s, scan.mad_threshold(s), 5)


def highest_peaks(spark, sf_dir):
    s = scan.composite(profile(spark, sf_dir), (0.5, 0.25, 0.25))
    found = scan.peaks(s, scan.mad_threshold(s), 1)
    return scan.top_peaks(s.join(found, ["focus", "sigma_idx"], "left_semi").withColumn("is_peak", F.lit(True))).withColumn("s", _r(F.col("s")))


def frechet_3d(spark, sf_dir):
    """Means of the first three coordinates by label, weighted by id."""
    lab = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "label")
    p = ball_points(spark, sf_dir).select("node_id", F.slice("x", 1, 3).alias("x"))
    w = lab.select("label", "node_id", (1 + F.col("node_id") % 7).cast("double").alias("w"))
    m = frechet.frechet_means(w, p, ["label"], tol=0.0)
    return m.select("label", *[_r(F.col("x")[i]).alias("abc"[i]) for i in range(3)])


def frechet_64d(spark, sf_dir):
    lab = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "label", F.lit(1.0).alias("w"))
    return frechet.frechet_means(lab, ball_points(spark, sf_dir), ["label"]).select("label", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


def multi_center(spark, sf_dir):
    a, _ = frechet.multi_center(ball_points(spark, sf_dir), 8)
    return a.groupBy("center").agg(F.count("*").alias("n"), F.min("node_id").alias("least"))


def tree_points(spark, sf_dir):
    """(node_id, x): a radial layout of the trade hierarchy, deeper nodes farther out, in the plane."""
    h = trade_hierarchy(spark, sf_dir)
    d = hierarchy.depths(h)
    u, r = hierarchy.uniform("node_id"), F.lit(0.05) + 0.25 * F.col("depth")
    return d.select("node_id", "depth", F.array(r * F.cos(2 * F.pi() * u), r * F.sin(2 * F.pi() * u)).alias("x"))


def tree_foci(hier, n=100):
    """(focus): the leaves that the reference scans, n stratified by depth."""
    d = hierarchy.leaves(hier).join(hierarchy.depths(hier), "node_id")
    return hierarchy.stratified_leaves(d, n).select(F.col("node_id").alias("focus"))


def boundary_scan_tree(spark, sf_dir):
    vals, vecs = tree_eigen(spark, sf_dir, 26)
    foci = tree_foci(trade_hierarchy(spark, sf_dir))
    out = scan.boundary_scan(tree_points(spark, sf_dir), vals, vecs, foci, logspace(spark, -2, 4, 60))["scan"]
    return out.select("focus", "sigma_idx", _r(F.col("sigma")).alias("sigma"), _r(F.col("s")).alias("s"), "is_peak", "k_star")


def best_peaks(spark, sf_dir):
    vals, vecs = tree_eigen(spark, sf_dir, 26)
    foci = tree_foci(trade_hierarchy(spark, sf_dir))
    out = scan.boundary_scan(tree_points(spark, sf_dir), vals, vecs, foci, logspace(spark, -2, 4, 60))["scan"]
    return scan.best_peak(out).select("focus", _r(F.col("sigma")).alias("sigma"), "k_star")


QUERIES = {"representation_velocity": velocity, "neighborhood_churn": churn, "zscore_composite": zscores, "mad_threshold": threshold, "local_peaks": peaks, "peaks_apart": peaks_apart, "top_peaks": highest_peaks, "frechet_mean_3d": frechet_3d, "frechet_mean": frechet_64d, "multi_center": multi_center, "boundary_scan": boundary_scan_tree, "best_peaks": best_peaks}

_PROFILE = "f AS (SELECT user_id % 5 AS focus, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS sigma_idx, count(*)::DOUBLE AS v, sum(value::DECIMAL(18,2))::DOUBLE AS d, count(DISTINCT user_id)::DOUBLE AS c FROM events GROUP BY 1, 2)"
_Z = "CASE WHEN stddev_pop({0}) OVER q < 1e-10 THEN 0 ELSE ({0} - avg({0}) OVER q) / stddev_pop({0}) OVER q END"
_SCORES = f"{_PROFILE}, z AS (SELECT focus, sigma_idx, 0.5::DOUBLE * ({_Z.format('v')}) + 0.25::DOUBLE * ({_Z.format('d')}) + 0.25::DOUBLE * ({_Z.format('c')}) AS s FROM f WINDOW q AS (PARTITION BY focus))"
_MAD = f"{_SCORES}, md AS (SELECT focus, median(s) AS m FROM z GROUP BY focus), th AS (SELECT focus, any_value(m) + greatest(median(abs(s - m)), 1e-10) AS threshold FROM z JOIN md USING (focus) GROUP BY focus)"
_TAN = "atanh(least(n, 1 - 1e-7)) / n * (1 - mm)"
SQL = {
    "representation_velocity": f"WITH {POINTS} SELECT a.id::INTEGER AS sigma_idx, round({DIST.format(a='a', b='b')} / (b.id * b.id - a.id * a.id), 6) AS v FROM p a JOIN p b ON b.id = a.id + 1",
    "neighborhood_churn": f"""WITH {POINTS}, r AS (SELECT a.id AS q, b.id AS n, row_number() OVER (PARTITION BY a.id ORDER BY {DIST.format(a='a', b='b')}, b.id) AS r FROM p a, p b),
        s AS (SELECT q, list(n) AS near FROM r WHERE r <= 10 GROUP BY q)
        SELECT a.q::INTEGER AS sigma_idx, round(1 - len(list_intersect(a.near, b.near))::DOUBLE / len(list_distinct(list_concat(a.near, b.near))), 6) AS c FROM s a JOIN s b ON b.q = a.q + 1""",
    "zscore_composite": f"WITH {_SCORES} SELECT focus, sigma_idx, round(s, 6) + 0.0::DOUBLE AS s FROM z",
    "mad_threshold": f"WITH {_MAD} SELECT focus, round(threshold, 6) + 0.0::DOUBLE AS threshold FROM th",
    "local_peaks": f"""WITH {_MAD}, n AS (SELECT *, lag(s) OVER q AS a, lead(s) OVER q AS b FROM z WINDOW q AS (PARTITION BY focus ORDER BY sigma_idx)),
        m AS (SELECT n.*, threshold, count(*) FILTER (s >= threshold) OVER (PARTITION BY focus) AS high, row_number() OVER (PARTITION BY focus ORDER BY s DESC, sigma_idx) AS r FROM n JOIN th USING (focus) WHERE s > a AND s > b)
        SELECT focus, sigma_idx FROM m WHERE s >= threshold OR (high = 0 AND r = 1)""",
    "top_peaks": f"""WITH {_MAD}, n AS (SELECT *, lag(s) OVER q AS a, lead(s) OVER q AS b FROM z WINDOW q AS (PARTITION BY focus ORDER BY sigma_idx)),
        m AS (SELECT n.*, threshold, row_number() OVER (PARTITION BY focus ORDER BY s DESC, sigma_idx) AS r FROM n JOIN th USING (focus) WHERE s > a AND s > b)
        SELECT focus, r::INTEGER AS place, sigma_idx, round(s, 6) + 0.0::DOUBLE AS s FROM m WHERE r <= 5 AND (s >= threshold OR r = 1)""",
    "frechet_mean_3d": f"""WITH RECURSIVE {POINTS}, w AS (SELECT id, label, 1.0::DOUBLE + id % 7 AS w FROM p JOIN embeddings ON vec_id = id),
        q AS (SELECT label, id, w / sum(w) OVER (PARTITION BY label) AS w, x[1] AS a, x[2] AS b, x[3] AS c FROM w JOIN p USING (id)),
        first AS (SELECT label, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY w DESC, id) AS r FROM q) WHERE r = 1),
        m(it, label, a, b, c) AS (SELECT 0, label, a, b, c FROM first UNION ALL
          SELECT it + 1, label, ((1 + 2 * mt + tt) * ma + (1 - mm) * ta) / den, ((1 + 2 * mt + tt) * mb + (1 - mm) * tb) / den, ((1 + 2 * mt + tt) * mc + (1 - mm) * tc) / den FROM (
            SELECT *, ma * ta + mb * tb + mc * tc AS mt, ta * ta + tb * tb + tc * tc AS tt, 1 + 2 * (ma * ta + mb * tb + mc * tc) + mm * (ta * ta + tb * tb + tc * tc) AS den FROM (
              SELECT it, label, ma, mb, mc, mm, CASE WHEN n = 0 THEN 0 ELSE tanh(n / (1 - mm)) / n END * va AS ta, CASE WHEN n = 0 THEN 0 ELSE tanh(n / (1 - mm)) / n END * vb AS tb, CASE WHEN n = 0 THEN 0 ELSE tanh(n / (1 - mm)) / n END * vc AS tc FROM (
                SELECT it, label, ma, mb, mc, mm, va, vb, vc, sqrt(va * va + vb * vb + vc * vc) AS n FROM (
                  SELECT it, label, ma, mb, mc, mm, sum(CASE WHEN n = 0 THEN 0 ELSE w * {_TAN} * ga END) AS va, sum(CASE WHEN n = 0 THEN 0 ELSE w * {_TAN} * gb END) AS vb, sum(CASE WHEN n = 0 THEN 0 ELSE w * {_TAN} * gc END) AS vc FROM (
                    SELECT *, sqrt(ga * ga + gb * gb + gc * gc) AS n FROM (
                      SELECT it, label, w, ma, mb, mc, mm, ((1 - 2 * d + xx) * -ma + (1 - mm) * xa) / (1 - 2 * d + mm * xx) AS ga, ((1 - 2 * d + xx) * -mb + (1 - mm) * xb) / (1 - 2 * d + mm * xx) AS gb, ((1 - 2 * d + xx) * -mc + (1 - mm) * xc) / (1 - 2 * d + mm * xx) AS gc FROM (
                        SELECT m.it, m.label, q.w, m.a AS ma, m.b AS mb, m.c AS mc, q.a AS xa, q.b AS xb, q.c AS xc, m.a * q.a + m.b * q.b + m.c * q.c AS d, m.a * m.a + m.b * m.b + m.c * m.c AS mm, q.a * q.a + q.b * q.b + q.c * q.c AS xx FROM m JOIN q ON q.label = m.label WHERE it < 15)))
                  GROUP BY it, label, ma, mb, mc, mm)))))
        SELECT label, round(a, 6) + 0.0::DOUBLE AS a, round(b, 6) + 0.0::DOUBLE AS b, round(c, 6) + 0.0::DOUBLE AS c FROM m WHERE it = 15""",
}
