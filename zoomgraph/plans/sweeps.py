"""Record processing of sweeps, over runs that are read off the orders table; and the event stream's edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spectral, sweep
from ..sources.records import table
from ..streaming.edges import edge_weights
from .geometry import _r


def runs(spark, sf_dir):
    """(name, r, seed, value): a run an order; priorities are the configs."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("name"), (20 + 20 * (F.col("o_custkey") % 5)).cast("int").alias("r"), (F.col("o_orderkey") % 40).cast("int").alias("seed"), (F.col("o_totalprice") / 1e6).alias("value"), "o_orderkey")


def one_each(spark, sf_dir):
    d = runs(spark, sf_dir)
    return d.groupBy("name", "r", "seed").agg(F.min_by("value", "o_orderkey").alias("value"))


def resume(spark, sf_dir):
    names = ["1-URGENT", "2-HIGH", "full"]
    plan = sweep.grid(spark, [20, 40, 60, 80, 100], sweep.seeds("0-9,38,45"), names)
    return sweep.remaining(plan, one_each(spark, sf_dir).where("value < 0.2").select("r", "seed", "name"))


def merged(spark, sf_dir):
    d = one_each(spark, sf_dir)
    first, second = d.where("seed < 25"), d.where("seed > 15").withColumn("value", -F.col("value"))
    return sweep.merge([first, second]).select("name", "r", "seed", _r(F.col("value")).alias("value"))


def summary(spark, sf_dir):
    s = sweep.summarize(one_each(spark, sf_dir), ["value"], ["name", "r"])
    return s.select("name", "r", "n", *[_r(F.col(c)).alias(c) for c in s.columns if c.startswith("value")])


def pivoted(spark, sf_dir):
    d = one_each(spark, sf_dir).groupBy("name").pivot("r", [20, 40, 60, 80, 100]).agg(F.median("value"))
    return d.select("name", *[_r(F.col(f"`{r}`")).alias(f"r{r}") for r in (20, 40, 60, 80, 100)])


def cells(spark, sf_dir):
    return sweep.pivot_cells(one_each(spark, sf_dir), "value")


def intervals(spark, sf_dir):
    b = sweep.bootstrap_ci(one_each(spark, sf_dir), "value", ["name", "r"])
    return b.select("name", "r", *[_r(F.col(c)).alias(c) for c in ("median", "low", "high")])


def modal(spark, sf_dir):
    return sweep.modal_count(runs(spark, sf_dir), ["name", "r"])


def clamped(spark, sf_dir):
    x = (F.col("c_acctbal") / 1e5).alias("x")
    return table(spark, sf_dir, "customer").select("c_custkey", sweep.no_negative_zero(x).alias("x"))


def violations(spark, sf_dir):
    m = one_each(spark, sf_dir).groupBy("name", "r").agg(F.median("value").alias("m"))
    return sweep.differ(m, "1-URGENT", "5-LOW", "m", 0.005).select("r", _r(F.col("gap")).alias("gap"))


def nearest_scale(spark, sf_dir):
    grid = spectral.logspace(spark, -2, 2, 41).withColumn("k_star", F.col("sigma_idx"))
    want = table(spark, sf_dir, "part").select((F.col("p_size") / 7.0).alias("target")).distinct()
    return sweep.nearest_scale(grid, want).select(_r(F.col("target")).alias("target"), _r(F.col("sigma")).alias("sigma"), "k_star")


def histogram(spark, sf_dir):
    return sweep.log_histogram(table(spark, sf_dir, "orders"), "o_totalprice")


def stream_edges(spark, sf_dir):
    return edge_weights(table(spark, sf_dir, "events")).select(F.to_date("start").cast("string").alias("day"), "src", "dst", "w")


def mean_intervals(spark, sf_dir):
    b = sweep.bootstrap_ci(one_each(spark, sf_dir), "value", ["name", "r"], sweep.bootstrap_mean)
    return b.select("name", "r", *[_r(F.col(c)).alias(c) for c in ("median", "low", "high")])


def effect(spark, sf_dir):
    """The paired test of two configs; the interval, which is drawn, is held by the tests."""
    e = sweep.paired_effect(one_each(spark, sf_dir), "1-URGENT", "5-LOW", "value")
    return e.select(_r(F.col("gap")).alias("gap"), "n", F.round("w", 1).alias("w"), _r(F.col("z")).alias("z"))


def weight_labels(spark, sf_dir):
    a, b, c = (F.when(F.col("p_size") % 10 == 0, 1 / 3).otherwise((F.col("p_size") + F.lit(i)) % 5 / F.lit(8.0)) for i in range(3))
    return table(spark, sf_dir, "part").select("p_partkey", sweep.weights_label(a, b, c).alias("label"))


def claims(spark, sf_dir):
    """The five claims over runs whose priorities stand for the configs."""
    names = dict(zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), (sweep.FULL, sweep.RANDOM, sweep.BINARY, sweep.DIRECT, sweep.EUCLIDEAN), strict=True))
    scaled = F.element_at(F.create_map(*[F.lit(x) for r in ((20, 20), (40, 40), (60, 80), (80, 100), (100, 150)) for x in r]), F.col("r"))
    named = F.element_at(F.create_map(*[F.lit(x) for n in names.items() for x in n]), F.col("name"))
    m = one_each(spark, sf_dir).groupBy(named.alias("name"), scaled.alias("r")).agg((F.median("value") * 10).alias("macro"), (F.max("value") * 2).alias("meso"))
    return sweep.claim_failures(m).select("claim", "r", _r(F.col("gap")).alias("gap"))


def unfinished(spark, sf_dir):
    d = runs(spark, sf_dir)
    plan = d.select("name").distinct().crossJoin(spark.createDataFrame([(s, 40 + s) for s in sweep.seeds("0-44")], "seed int, expected int"))
    return sweep.incomplete(plan, d, ["name", "seed"])


QUERIES = {"sweep_resume": resume, "merge_keep_first": merged, "aggregate_quartiles": summary, "pivot_medians": pivoted, "pivot_cells": cells, "bootstrap_ci": intervals, "modal_count": modal, "negative_zero": clamped, "claim_violations": violations, "nearest_scale": nearest_scale, "log_histogram": histogram, "edge_weights": stream_edges, "bootstrap_mean": mean_intervals, "paired_effect": effect, "weight_labels": weight_labels, "claim_checks": claims, "sweep_incomplete": unfinished}

_RUNS = "o AS (SELECT o_orderpriority AS name, (20 + 20 * (o_custkey % 5))::INTEGER AS r, (o_orderkey % 40)::INTEGER AS seed, o_totalprice / 1e6 AS value, o_orderkey FROM orders), d AS (SELECT name, r, seed, arg_min(value, o_orderkey) AS value FROM o GROUP BY ALL)"
SQL = {
    "sweep_resume": f"WITH {_RUNS}, p AS (SELECT * FROM (SELECT unnest([20, 40, 60, 80, 100])::INTEGER AS r), (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 38, 45])::INTEGER AS seed), (SELECT unnest(['1-URGENT', '2-HIGH', 'full']) AS name)) SELECT r, seed, name FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE value < 0.2 AND d.r = p.r AND d.seed = p.seed AND d.name = p.name)",
    "merge_keep_first": f"WITH {_RUNS} SELECT name, r, seed, round(CASE WHEN seed < 25 THEN value ELSE -value END, 6) + 0.0::DOUBLE AS value FROM d",
    "aggregate_quartiles": f"WITH {_RUNS} SELECT a.name, b.r, count(d.name) AS n, round(median(value), 6) AS value_median, round(quantile_cont(value, 0.25), 6) AS value_q25, round(quantile_cont(value, 0.75), 6) AS value_q75, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max FROM (SELECT DISTINCT name FROM d) a CROSS JOIN (SELECT DISTINCT r FROM d) b LEFT JOIN d ON d.name = a.name AND d.r = b.r GROUP BY ALL",
    "pivot_medians": f"WITH {_RUNS} SELECT name, " + ", ".join(f"round(median(value) FILTER (r = {r}), 6) AS r{r}" for r in (20, 40, 60, 80, 100)) + " FROM d GROUP BY name",
    "modal_count": f"WITH {_RUNS}, c AS (SELECT count(*) AS n FROM o GROUP BY name, r) SELECT n FROM c GROUP BY n ORDER BY count(*) DESC, n LIMIT 1",
    "negative_zero": "SELECT c_custkey, CASE WHEN c_acctbal / 1e5 > -5e-3 AND c_acctbal / 1e5 < 0 THEN 0 ELSE c_acctbal / 1e5 END AS x FROM customer",
    "claim_violations": f"WITH {_RUNS}, m AS (SELECT name, r, median(value) AS m FROM d GROUP BY ALL) SELECT a.r, round(abs(a.m - b.m), 6) AS gap FROM m a JOIN m b ON a.r = b.r AND a.name = '1-URGENT' AND b.name = '5-LOW' WHERE abs(a.m - b.m) > 0.005",
    "nearest_scale": "WITH g AS (SELECT i::INTEGER AS k_star, pow(10.0::DOUBLE, -2 + i * (4 / 40.0::DOUBLE)) AS sigma FROM range(0, 41) t(i)), w AS (SELECT DISTINCT p_size / 7.0::DOUBLE AS target FROM part) SELECT round(target, 6) AS target, round(arg_min(sigma, (abs(sigma - target), sigma)), 6) AS sigma, arg_min(k_star, (abs(sigma - target), sigma)) AS k_star FROM w, g GROUP BY target",
    "log_histogram": "WITH b AS (SELECT min(log10(o_totalprice)) AS lo, max(log10(o_totalprice)) AS hi FROM orders WHERE o_totalprice > 0) SELECT least(floor((log10(o_totalprice) - lo) / ((hi - lo) / 40)), 39)::INTEGER AS bin, count(*) AS n FROM orders, b WHERE o_totalprice > 0 GROUP BY 1",
    "paired_effect": f"""WITH {_RUNS}, g AS (SELECT a.value - b.value AS d FROM d a JOIN d b ON a.r = b.r AND a.seed = b.seed AND a.name = '1-URGENT' AND b.name = '5-LOW'), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY abs(d))::DOUBLE AS t FROM g WHERE d <> 0),
        s AS (SELECT count(*)::DOUBLE AS n, sum(k) FILTER (d > 0) AS w, sum(t * t - 1) AS ties FROM k)
        SELECT round((SELECT avg(d) FROM g), 6) + 0.0::DOUBLE AS gap, n::BIGINT AS n, round(w, 1) AS w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) + 0.0::DOUBLE AS z FROM s""",
    "weight_labels": r"""WITH w AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE [(p_size + i) % 5 / 8.0::DOUBLE for i in [0, 1, 2]] END AS w FROM part)
        SELECT p_partkey, CASE WHEN w IS NULL THEN '$(\tfrac{1}{3},\tfrac{1}{3},\tfrac{1}{3})$' ELSE '$(' || array_to_string([x::VARCHAR.replace('.0', CASE WHEN x = floor(x) THEN '' ELSE '.0' END) for x in w], ',') || ')$' END AS label FROM w""",
    "claim_checks": f"""WITH {_RUNS}, m AS (SELECT name, CASE r WHEN 60 THEN 80 WHEN 80 THEN 100 WHEN 100 THEN 150 ELSE r END AS r, median(value) * 10 AS macro, max(value) * 2 AS meso FROM d GROUP BY ALL),
        p AS (SELECT a.r, b.name, abs(a.macro - b.macro) AS macro, abs(a.meso - b.meso) AS meso, a.meso - b.meso AS fall FROM m a JOIN m b ON a.r = b.r AND a.name = '1-URGENT'),
        e AS (SELECT r, fall, CASE r WHEN 80 THEN 0.06::DOUBLE WHEN 100 THEN 0.04::DOUBLE ELSE 0.10::DOUBLE END AS want FROM p WHERE name = '5-LOW' AND r >= 80),
        f(claim, r, gap) AS (SELECT 'random_macro', r, macro FROM p WHERE name = '2-HIGH' AND macro > 0.05 UNION ALL SELECT 'random_meso', r, meso FROM p WHERE name = '2-HIGH' AND meso > 0.05 AND r <> 150
          UNION ALL SELECT 'binary_macro', r, macro FROM p WHERE name = '3-MEDIUM' AND macro > 0.03 UNION ALL SELECT 'binary_meso', r, meso FROM p WHERE name = '3-MEDIUM' AND meso > 0.03 AND r <= 100
          UNION ALL SELECT 'direct_macro', r, macro FROM m WHERE name = '4-NOT SPECIFIED' AND r <= 40 AND macro > 0.1 UNION ALL SELECT 'euclidean_drop', r, fall FROM e WHERE abs(fall - want) > 0.03
          UNION ALL SELECT 'euclidean_sign', NULL, count(*) FILTER (fall >= 0) FROM e HAVING count(*) FILTER (fall >= 0) < 3)
        SELECT claim, r::INTEGER AS r, round(gap, 6) + 0.0::DOUBLE AS gap FROM f""",
    "sweep_incomplete": f"WITH {_RUNS}, p AS (SELECT name, s::INTEGER AS seed, (40 + s)::INTEGER AS expected FROM (SELECT DISTINCT name FROM o), range(0, 45) t(s)), c AS (SELECT name, seed, count(*) AS n FROM o GROUP BY ALL) SELECT p.name, p.seed, coalesce(n, 0) AS n, expected FROM p LEFT JOIN c ON c.name = p.name AND c.seed = p.seed WHERE coalesce(n, 0) < expected",
    "edge_weights": "SELECT ts::DATE::VARCHAR AS day, user_id AS src, event_type AS dst, count(*) AS w FROM events GROUP BY ALL",
}
