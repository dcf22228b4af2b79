import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoomgraph.functions import arrays
from zoomgraph.operators import embed, hierarchy, metrics, scan, sweep, synth
from zoomgraph.plans import scans
from zoomgraph.sources.records import ball_points


def test_find_peaks():
    s = np.array([0, 1, 0, 2, 2, 2, 0, 3, 0, 1.0])
    assert list(scan.find_peaks(s)) == [1, 4, 7]
    assert list(scan.find_peaks(s, 1.5)) == [4, 7]
    assert list(scan.find_peaks(s, None, 4)) == [1, 7]
    assert list(scan.find_peaks(np.zeros(5))) == []
    assert list(scan.find_peaks(np.zeros(0))) == []


def test_indicators(spark):
    j = lambda rows: scan.jensen_shannon(spark.createDataFrame(rows, "k int, p double, q double"), ["k"]).first()["d"]
    assert j([(0, 0.25, 0.25)] * 4) == 0
    assert j([(0, 1.0, 0.0), (0, 0.0, 1.0)]) == pytest.approx(math.log(2))
    assert j([(0, 0.0, 1.0)]) == 0
    phi = spark.createDataFrame([(0, 0, 1.0, [0.1, 0.0]), (0, 1, 1.0, [0.5, 0.0])], "focus long, sigma_idx int, sigma double, x array<double>")
    with pytest.raises(Exception, match="increase"):
        scan.velocity(phi).collect()
    with pytest.raises(ValueError):
        scan.composite(phi, (0.5, 0.6, 0.5))


def test_divergence_gathers_no_rows_of_one_key(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b)) for k, n in ((0, 400), (1, 7), (None, 30)) for a, b in rng.random((n, 2)) * rng.integers(0, 2, (n, 2))]
    rows += [(2, 0.0, 1.0), (3, None, 2.0), (3, 1.0, 1.0)]
    df = scan.jensen_shannon(spark.createDataFrame(rows, "k int, p double, q double"), ["k"])
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["d"] for r in df.collect()}
    for k in (0, 1, None):
        p, q = np.array([r[1:] for r in rows if r[0] == k]).T
        p, q = p / p.sum(), q / q.sum()
        with np.errstate(all="ignore"):
            want = np.nansum(p * np.log(2 * p / (p + q))) / 2 + np.nansum(q * np.log(2 * q / (p + q))) / 2
        assert got[k] == pytest.approx(want, abs=1e-12)
    assert got[2] == 0 and set(got) == {0, 1, 2, 3, None}


def test_equal_scores_have_zero_z(spark):
    d = spark.createDataFrame([(0, i, 1.0, 1.0, 1.0) for i in range(4)], "focus long, sigma_idx int, v double, d double, c double")
    assert {r["s"] for r in scan.composite(d).collect()} == {0.0}


def pairs(spark, t, p):
    return spark.createDataFrame(list(zip(t, p, strict=True)), "t int, p int")


def test_partition_metrics(spark):
    same = pairs(spark, [0, 0, 1, 1, 2, 2], [5, 5, 3, 3, 4, 4])
    other = pairs(spark, [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 0])
    assert metrics.adjusted_rand_index(same).first()[0] == 1
    assert metrics.variation_of_information(same).first()[0] == pytest.approx(0)
    assert metrics.normalized_mutual_info(same).first()[0] == pytest.approx(1)
    assert metrics.variation_of_information(other).first()[0] > 0
    assert metrics.variation_of_information(same.limit(0)).first()[0] == 0
    assert metrics.adjusted_rand_index(pairs(spark, [1, 1], [2, 2])).first()[0] == 1


def test_rank_metrics(spark):
    xy = lambda rows: spark.createDataFrame(rows, "x double, y double")
    up = [(float(i), float(i)) for i in range(1, 5)]
    assert metrics.kendall_tau(xy(up)).first()[0] == 1
    assert metrics.kendall_tau(xy([(a, -b) for a, b in up])).first()[0] == -1
    assert metrics.kendall_tau(xy(up[:1])).first()[0] == 0
    assert metrics.kendall_tau(xy([(1.0, 2.0)] * 3)).first()[0] == 0
    d = lambda v, c: spark.createDataFrame([(float(x),) for x in v], f"{c} double")
    assert metrics.hit_at(d([3, 8, 11], "d"), d([3, 7, 12], "t"), 1).first()[0] == 1
    assert metrics.hit_at(d([3, 20], "d"), d([3, 7], "t"), 1).first()[0] == 0.5
    assert metrics.hit_at(d([], "d"), d([3], "t"), 1).first()[0] == 0
    true = spark.createDataFrame([(0, 5), (1, 10)], "qid long, item long")
    ranked = spark.createDataFrame([(0, 3, 1), (0, 5, 2), (1, 10, 1), (2, 1, 1)], "qid long, item long, rank int")
    assert metrics.mean_reciprocal_rank(true, ranked).first()[0] == 0.75
    assert metrics.mean_reciprocal_rank(true.limit(0), ranked).first()[0] == 0


@pytest.mark.parametrize("values", [7, 40, 10**6])
def test_rank_metrics_by_brute_force(spark, values):
    rng = np.random.default_rng(values)
    x = rng.integers(values, size=600)
    x[:200] = 3  # a hot value
    y = np.where(rng.random(600) < 0.6, x, rng.integers(values, size=600)) - 5
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    s = np.triu(np.sign(x[:, None] - x) * np.sign(y[:, None] - y), 1).sum()
    tied = lambda v: sum(n * (n - 1) / 2 for n in np.unique(v, return_counts=True)[1])
    want = s / np.sqrt((600 * 599 / 2 - tied(x)) * (600 * 599 / 2 - tied(y)))
    for grid in (1, 4, 256):
        assert metrics.kendall_tau(rows, grid).first()[0] == pytest.approx(want)
    rank = lambda v: (v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2
    assert metrics.spearman(rows).first()[0] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    detected, true = rows.select(F.col("x").alias("d")), rows.limit(400).select((F.col("y") * 1.7).alias("t"))
    t = np.array([r["t"] for r in true.collect()])
    for hops in (0, 0.3, 2.5):
        hit = (np.abs(x[:, None] - t) <= hops).any(1).mean()
        assert metrics.hit_at(detected, spark.createDataFrame([(float(v),) for v in t], "t double"), hops).first()[0] == pytest.approx(hit)


def test_hierarchy_with_two_parents_and_cycle(spark):
    h = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (2, 1)], "child long, parent long")
    assert {r["node_id"]: r["depth"] for r in hierarchy.depths(h).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    above = {(r["node"], r["ancestor"]): r["hops"] for r in hierarchy.ancestors(h).collect()}
    assert above[4, 0] == 3 and above[3, 0] == 2 and (4, 4) not in above
    loop = spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long")
    assert hierarchy.ancestors(loop).count() == 2


def test_seeds_and_bootstrap():
    assert sweep.seeds("42-46,50") == [42, 43, 44, 45, 46, 50]
    assert all(math.isnan(x) for x in sweep.bootstrap(np.array([])))
    assert sweep.bootstrap(np.array([2.0])) == (2.0, 2.0, 2.0)
    m, lo, hi = sweep.bootstrap(np.arange(20.0))
    assert lo < m < hi


def test_merge_keeps_first(spark):
    a = spark.createDataFrame([(1, 1, "x", 1.0)], "r int, seed int, name string, v double")
    b = spark.createDataFrame([(1, 1, "x", 2.0), (2, 1, "x", 3.0)], "r int, seed int, name string, v double")
    assert sorted(tuple(r) for r in sweep.merge([a, b]).collect()) == [(1, 1, "x", 1.0), (2, 1, "x", 3.0)]


def test_block_model(spark):
    for bad in ((100, 2, 2, 2, 20), (64, 0, 2, 2, 20), (64, 2, -1, 2, 20), (0, 2, 2, 2, 20), (64, 2, 2, 2, -1)):
        with pytest.raises(ValueError):
            synth.check(*bad)
    assert synth.hsbm_edges(spark, 64, 2, 2, 2).exceptAll(synth.hsbm_edges(spark, 64, 2, 2, 2).repartition(3)).count() == 0


def test_ball_gradient_and_embedding():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, 4, 3)) * 0.2
    d, g = embed.ball_gradient(x, y)
    for i in range(3):
        e = np.zeros(3)
        e[i] = 1e-6
        up, _ = embed.ball_gradient(x + e, y)
        down, _ = embed.ball_gradient(x - e, y)
        np.testing.assert_allclose((up - down) / 2e-6, g[:, i], atol=1e-5)
    a, b = np.arange(14) // 2, np.arange(1, 15)
    p = embed.mds(15, a, b, 3, 200, 0.05, 0, "poincare")
    assert (np.linalg.norm(p, axis=1) < 1).all()
    np.testing.assert_array_equal(p, embed.mds(15, a, b, 3, 200, 0.05, 0, "poincare"))


def test_scans_of_points_cover_the_table(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((230, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    p = np.array([r["x"] for r in ball_points(spark, tmp_path).orderBy("node_id").collect()])
    d = arrays.distances(p, p, "poincare")
    np.fill_diagonal(d, 0)
    near = [set(np.argsort(row, kind="stable")[:10]) for row in d]
    v = {r["sigma_idx"]: r["v"] for r in scans.velocity(spark, tmp_path).collect()}
    c = {r["sigma_idx"]: r["c"] for r in scans.churn(spark, tmp_path).collect()}
    assert v == pytest.approx({i: d[i, i + 1] / (2 * i + 1) for i in range(229)}, abs=1e-5)
    assert c == pytest.approx({i: 1 - len(near[i] & near[i + 1]) / len(near[i] | near[i + 1]) for i in range(229)}, abs=1e-5)


@pytest.mark.parametrize("query", [scans.boundary_scan_tree, scans.best_peaks])
def test_stratified_leaves_are_scanned(spark, monkeypatch, query):
    hier = spark.createDataFrame([(1, 0), (2, 1)] + [(i, i % 3) for i in range(10, 140)], "child long, parent long")
    seen = []

    def stop(points, vals, vecs, foci, grid):
        seen.extend(r["focus"] for r in foci.collect())
        raise InterruptedError

    monkeypatch.setattr(scans, "trade_hierarchy", lambda *_: hier)
    monkeypatch.setattr(scans, "tree_eigen", lambda *_: (None, None))
    monkeypatch.setattr(scans, "tree_points", lambda *_: None)
    monkeypatch.setattr(scan, "boundary_scan", stop)
    with pytest.raises(InterruptedError):
        query(spark, "")
    assert len(set(seen)) == len(seen) == 100 and {i % 3 for i in seen} == {0, 1, 2}
