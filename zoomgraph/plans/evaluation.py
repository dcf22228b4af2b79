"""Partition, ranking and correlation metrics over the trade tables; synthetic graphs; clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, embed, graph, hierarchy, metrics, scoring, spectral, synth
from ..sources.records import table, trade_hierarchy
from .geometry import _r


def _parts(spark, sf_dir):
    """Two labelings of the parts: their type, and the type of one part in three moved by size."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("t"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("S"), F.col("p_size") % 4)).otherwise(F.col("p_type")).alias("p"))


def contingency(spark, sf_dir):
    return metrics.contingency(_parts(spark, sf_dir))


def _one(name, fn):
    return lambda spark, sf_dir: fn(_parts(spark, sf_dir)).select(_r(F.col(name)).alias(name))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100 + F.col("l_quantity") / 5).alias("y"))


def tau(spark, sf_dir):
    return metrics.kendall_tau(_lines(spark, sf_dir)).select(_r(F.col("tau")).alias("tau"))


def spearman(spark, sf_dir):
    return metrics.spearman(_lines(spark, sf_dir)).select(_r(F.col("rho")).alias("rho"))


def pearson(spark, sf_dir):
    return metrics.pearson(_lines(spark, sf_dir)).select(_r(F.col("r")).alias("r"))


def hits(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_size") * 1.5).alias("d"))
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("t"))
    one = lambda h: metrics.hit_at(d, t, h).select(F.lit(h).alias("hops"), _r(F.col("hit")).alias("hit"))
    return one(0).union(one(1)).union(one(2))


def mrr(spark, sf_dir):
    """Each order is a query: its items by line number, the true ones of a low part number."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank"))
    true = li.where(F.col("item") % 10 < 3).select("qid", "item")
    return metrics.mean_reciprocal_rank(true, li).select(_r(F.col("mrr")).alias("mrr"))


def labels(spark, sf_dir):
    return synth.hsbm_labels(spark)


def edges(spark, sf_dir):
    return synth.hsbm_edges(spark, 512, 2, 4, 8, 40.0)


def snr(spark, sf_dir):
    r = spark.createDataFrame([(float(x),) for x in (20, 40, 60, 80, 100, 150, 200)], "r double")
    a, b, d = spectral.kesten_stigum(F.col("r"))
    return r.select("r", _r(a).alias("macro"), _r(b).alias("meso"), _r(d).alias("d_avg"))


def random_points(spark, sf_dir):
    p = synth.random_points(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id")), 4)
    return p.select("node_id", *[_r(F.col("x")[i]).alias("abcd"[i]) for i in range(4)])


def hsbm_recovery(spark, sf_dir):
    """ARI of spectral clusters of planted graphs at the three levels, from a strong and a weak signal."""
    out = None
    for r in (40.0, 200.0):
        e = graph.checkpointed(graph.undirected(synth.hsbm_edges(spark, 256, 2, 2, 4, r)))
        nodes = spark.range(256).withColumnRenamed("id", "node_id")
        _, vecs = spectral.eigen(graph.normalized_laplacian(nodes, e), 24)
        truth = synth.hsbm_labels(spark, 256, 2, 2, 4, r)
        for k, level in ((2, "macro"), (4, "meso"), (16, "micro")):
            got = clustering.small_spectral_clusters(vecs.withColumn("r", F.lit(r)), ["r"], k)
            one = metrics.adjusted_rand_index(got.join(truth, "node_id").select(F.col(level).alias("t"), F.col("label").alias("p"))).select(F.lit(r).alias("r"), F.lit(level).alias("level"), _r(F.col("ari")).alias("ari"))
            out = one if out is None else out.union(one)
    return out


def clusters_mllib(spark, sf_dir):
    e = graph.undirected(synth.hsbm_edges(spark, 256, 2, 2, 4, 100.0))
    nodes = spark.range(256).withColumnRenamed("id", "node_id")
    vals, vecs = spectral.eigen(graph.normalized_laplacian(nodes, e), 24)
    return clustering.spectral_clusters(vals, vecs, 4, 1.0, runs=3)


def config_scores(spark, sf_dir):
    """Two configs of a sweep over a planted graph: even weights, and the velocity alone with a higher threshold."""
    e = graph.checkpointed(graph.undirected(synth.hsbm_edges(spark, 256, 2, 2, 4, 100.0)))
    nodes = spark.range(256).withColumnRenamed("id", "node_id")
    vals, vecs = spectral.eigen(graph.normalized_laplacian(nodes, e), 24)
    truth, points = synth.hsbm_labels(spark, 256, 2, 2, 4, 100.0), synth.random_points(nodes, 4)
    one = lambda name, **k: scoring.score_config(points, vals, vecs, truth, 0, {"macro": 2, "meso": 4}, runs=3, grid=spectral.logspace(spark, -2, 2, 40), **k).select(F.lit(name).alias("name"), "*")
    return one("full").union(one("velocity", alpha=(1.0, 0.0, 0.0), peak_alpha=2.0))


def _small(spark, sf_dir):
    return trade_hierarchy(spark, sf_dir, 2).select(F.col("child").alias("src"), F.col("parent").alias("dst"))


def _embedding(method, **options):
    def run(spark, sf_dir):
        return embed.embed(_small(spark, sf_dir), method, 5, **options).select("node_id", F.transform("x", lambda v: F.round(v, 4)).alias("x"))

    return run


QUERIES = {
    "contingency": contingency, "adjusted_rand_index": _one("ari", metrics.adjusted_rand_index), "variation_of_information": _one("vi", metrics.variation_of_information), "normalized_mutual_info": _one("nmi", metrics.normalized_mutual_info),
    "kendall_tau": tau, "spearman": spearman, "pearson": pearson, "hit_at_l": hits, "mean_reciprocal_rank": mrr, "hsbm_labels": labels, "hsbm_edges": edges, "hsbm_snr": snr, "random_points": random_points, "hsbm_recovery": hsbm_recovery,
    "spectral_clusters": clusters_mllib, "config_scores": config_scores, "poincare_embed": _embedding("contrastive"), "hyperbolic_mds": _embedding("hyperbolic_mds"), "euclidean_mds": _embedding("euclidean_mds"),
}

_PART = "x AS (SELECT p_type AS t, CASE WHEN p_partkey % 3 = 0 THEN 'S' || (p_size % 4) ELSE p_type END AS p FROM part), c AS (SELECT t, p, count(*)::DOUBLE AS n FROM x GROUP BY t, p), ct AS (SELECT sum(n) AS n FROM c GROUP BY t), cp AS (SELECT sum(n) AS n FROM c GROUP BY p), a AS (SELECT sum(n) AS n FROM c)"
_H = "h AS (SELECT (SELECT -sum(c.n / a.n * ln(c.n / a.n)) FROM c, a) AS h, (SELECT -sum(ct.n / a.n * ln(ct.n / a.n)) FROM ct, a) AS ht, (SELECT -sum(cp.n / a.n * ln(cp.n / a.n)) FROM cp, a) AS hp)"
_LINE = "x AS (SELECT l_quantity AS x, round(l_discount * 100 + l_quantity / 5) AS y FROM lineitem)"


def _u(*parts: str) -> str:
    return f"('0x' || substr(md5({' || '.join(f'({p})::VARCHAR || chr(58)' for p in parts)} || '42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _normal(k: int) -> str:
    return f"0.1::DOUBLE * sqrt(-2 * ln(1 - {_u('vec_id', str(2 * k))})) * cos(2 * pi() * {_u('vec_id', str(2 * k + 1))})"


SQL = {
    "contingency": f"WITH {_PART} SELECT t, p, n::BIGINT AS n FROM c",
    "adjusted_rand_index": f"WITH {_PART}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM ct) AS st, (SELECT sum(n * (n - 1) / 2) FROM cp) AS sp, (SELECT n * (n - 1) / 2 FROM a) AS n) SELECT round((b - st * sp / n) / ((st + sp) / 2 - st * sp / n), 6) AS ari FROM s",
    "variation_of_information": f"WITH {_PART}, {_H} SELECT round(greatest(2 * h - ht - hp, 0), 6) AS vi FROM h",
    "normalized_mutual_info": f"WITH {_PART}, {_H} SELECT round((ht + hp - h) / ((ht + hp) / 2), 6) AS nmi FROM h",
    "kendall_tau": f"""WITH {_LINE}, c AS (SELECT x, y, count(*)::DOUBLE AS n FROM x GROUP BY x, y), s AS (SELECT sum(sign(b.x - a.x) * sign(b.y - a.y) * a.n * b.n) / 2 AS s FROM c a, c b),
        t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY x)) AS tx, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY y)) AS ty, (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM x) AS n0)
        SELECT round(s / sqrt((n0 - tx) * (n0 - ty)), 6) + 0.0::DOUBLE AS tau FROM s, t""",
    "spearman": f"WITH {_LINE}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM x) SELECT round(corr(a, b), 6) + 0.0::DOUBLE AS rho FROM r",
    "pearson": f"WITH {_LINE} SELECT round(corr(x, y), 6) + 0.0::DOUBLE AS r FROM x",
    "hit_at_l": "SELECT hops, round(avg((EXISTS (SELECT 1 FROM nation WHERE abs(n_nationkey - p_size * 1.5::DOUBLE) <= hops))::INTEGER), 6) AS hit FROM part, (VALUES (0::INTEGER), (1), (2)) h(hops) GROUP BY hops",
    "mean_reciprocal_rank": "SELECT round(avg(1.0::DOUBLE / r), 6) AS mrr FROM (SELECT l_orderkey, min(l_linenumber) AS r FROM lineitem WHERE l_partkey % 10 < 3 GROUP BY l_orderkey)",
    "hsbm_labels": "SELECT i AS node_id, (i // 512)::INTEGER AS macro, (i // 128)::INTEGER AS meso, (i // 16)::INTEGER AS micro FROM range(0, 1024) t(i)",
    "hsbm_edges": f"SELECT a.i AS src, b.i AS dst FROM range(0, 512) a(i), range(0, 512) b(i) WHERE a.i < b.i AND {_u('a.i', 'b.i')} < CASE WHEN a.i // 8 = b.i // 8 THEN 80.0::DOUBLE / 512 WHEN a.i // 64 = b.i // 64 THEN 8.0::DOUBLE / 512 WHEN a.i // 256 = b.i // 256 THEN 2.0::DOUBLE / 512 ELSE 0.5::DOUBLE / 512 END",
    "hsbm_snr": """WITH r AS (SELECT unnest([20, 40, 60, 80, 100, 150, 200])::DOUBLE AS r), d AS (SELECT r, 15 * least(2 * r / 1024, 0.99::DOUBLE) AS a, 112 * 8.0::DOUBLE / 1024 AS b, 384 * 2.0::DOUBLE / 1024 AS c, 512 * 0.5::DOUBLE / 1024 AS e FROM r)
        SELECT r, round((a + b + c - e) * (a + b + c - e) / (2 * (a + b + c + e)), 6) AS macro, round((a + b - c - e) * (a + b - c - e) / (2 * (a + b + c + e)), 6) AS meso, round(a + b + c + e, 6) AS d_avg FROM d""",
    "random_points": "SELECT vec_id AS node_id, " + ", ".join(f"round({_normal(k)}, 6) + 0.0::DOUBLE AS {'abcd'[k]}" for k in range(4)) + " FROM embeddings",
}
