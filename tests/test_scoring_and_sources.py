import json
import math

import numpy as np
import pytest

from zoomgraph.functions import arrays
from zoomgraph.operators import graph, metrics, scan, scoring, spectral, sweep
from zoomgraph.sources import records
from zoomgraph.streaming import edges


def test_bootstrap_of_the_mean():
    assert all(math.isnan(x) for x in sweep.bootstrap_mean(np.array([])))
    assert sweep.bootstrap_mean(np.array([2.0])) == (2.0, 2.0, 2.0)
    m, lo, hi = sweep.bootstrap_mean(np.arange(20.0))
    assert lo < m < hi and m == 9.5


def test_wilcoxon_against_definition(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (2, 60)).astype(float)
    d = (x - y)[x != y]
    a = np.abs(d)
    rank = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    n, w = len(d), rank[d > 0].sum()
    ties = sum((a == v).sum() ** 2 - 1 for v in a)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    rows = lambda p, q: spark.createDataFrame(list(zip(p.tolist(), q.tolist(), strict=True)), "x double, y double")
    got = metrics.wilcoxon(rows(x, y)).first()
    assert (got["n"], got["w"]) == (n, w) and got["z"] == pytest.approx(z) and got["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert tuple(metrics.wilcoxon(rows(x, x)).first()) == (0, 0.0, None, None)


def test_paired_effect(spark):
    rows = [(r, s, n, 0.5 + s / 100 + gap) for r in (80, 100) for s in range(10) for n, gap in (("a", 0.1 + s / 1000), ("b", 0.0))] + [(80, 99, "a", 5.0)]
    e = sweep.paired_effect(spark.createDataFrame(rows, "r int, seed int, name string, v double"), "a", "b", "v").first()
    assert e["n"] == 20 and e["gap"] == pytest.approx(0.1045) and e["low"] < e["gap"] < e["high"] and e["p"] < 1e-3


def test_weights_label(spark):
    rows = [(1 / 3, 0.3333, 0.3334), (0.5, 0.25, 0.25), (1.0, 0.0, 10.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double").coalesce(1).select(sweep.weights_label(*map(graph.F.col, "abc"))).collect()]
    assert got == [r"$(\tfrac{1}{3},\tfrac{1}{3},\tfrac{1}{3})$", "$(0.5,0.25,0.25)$", "$(1,0,10)$"]


def test_claims(spark):
    full = {20: 0.5, 40: 0.5, 80: 0.7, 100: 0.7, 150: 0.8, 200: 0.9}
    rows = [(sweep.FULL, r, v, v) for r, v in full.items()]
    fine = rows + [(sweep.EUCLIDEAN, r, v, v - sweep.DROPS.get(r, 0)) for r, v in full.items()] + [(sweep.RANDOM, 150, 0.8, 0.1), (sweep.BINARY, 200, 0.9, 0.1), (sweep.DIRECT, 20, 0.05, 0.5), (sweep.DIRECT, 80, 0.9, 0.5)]
    run = lambda d: sorted((r["claim"], r["r"], round(r["gap"], 6)) for r in sweep.claim_failures(spark.createDataFrame(d, "name string, r int, macro double, meso double")).collect())
    assert run(fine) == [] and run(rows) == []
    bad = rows + [(sweep.EUCLIDEAN, 80, 0.7, 0.9), (sweep.RANDOM, 80, 0.6, None), (sweep.BINARY, 100, 0.7, 0.6), (sweep.DIRECT, 40, 0.3, 0.3)]
    assert sorted(map(str, run(bad))) == sorted(map(str, [("binary_meso", 100, 0.1), ("direct_macro", 40, 0.3), ("euclidean_drop", 80, -0.2), ("euclidean_sign", None, 0.0), ("random_macro", 80, 0.1)]))


def test_incomplete(spark):
    plan = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", 1, 0)], "name string, seed int, expected int")
    done = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "name string, seed int")
    assert [tuple(r) for r in sweep.incomplete(plan, done, ["name", "seed"]).collect()] == [("a", 2, 1, 2)]


def test_top_peaks(spark):
    rows = [(f, i, float(i % 7), i % 2 == 1) for f in (0, 1) for i in range(30)]
    got = [tuple(r) for r in scan.top_peaks(spark.createDataFrame(rows, "focus long, sigma_idx int, s double, is_peak boolean")).orderBy("focus", "place").collect()]
    one = sorted(((i, s) for f, i, s, p in rows if p and not f), key=lambda x: (-x[1], x[0]))[:5]
    assert got == [(f, k + 1, i, s) for f in (0, 1) for k, (i, s) in enumerate(one)]


def test_reciprocal_ranks_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-0.5, 0.5, (60, 2))
    x[31] = x[30]  # a tie
    depth = rng.integers(0, 4, 60)
    above = {(f, int(a)) for f in range(9) for a in rng.integers(0, 60, 5)}
    peaks = [(i, int(rng.integers(0, 11)), float(rng.integers(0, 10)) / 2, rng.uniform(-0.5, 0.5, 2).tolist()) for i in range(40)]
    want = {}
    for i, f, d, p in peaks:
        up = {a for g, a in above if g == f}
        if up:
            near = sorted((arrays.distances(np.array([p]), x[[n]], "poincare")[0, 0].round(9), n) for n in range(60) if depth[n] == round(d))
            want[i] = next((1 / (k + 1) for k, (_, n) in enumerate(near) if n in up), 0.0)
    got = metrics.reciprocal_ranks(
        spark.createDataFrame(peaks, "peak long, focus long, depth_hat double, x array<double>"),
        spark.createDataFrame(sorted(above), "node long, ancestor long"),
        spark.createDataFrame([(i, int(depth[i]), x[i].tolist()) for i in range(60)], "node_id long, depth int, x array<double>"),
        salts=3,
    )
    assert {r["peak"]: r["rr"] for r in got.collect()} == pytest.approx(want)


def test_a_config_is_scored(spark):
    links = [(a, b) for g in (0, 8) for a in range(g, g + 8) for b in range(a + 1, g + 8)] + [(7, 8)]
    e = graph.checkpointed(graph.undirected(spark.createDataFrame(links, "src long, dst long")))
    nodes = spark.range(16).withColumnRenamed("id", "node_id")
    vals, vecs = spectral.eigen(graph.normalized_laplacian(nodes, e))
    points = spark.createDataFrame([(i, [0.3 if i < 8 else -0.3, 0.01 * i]) for i in range(16)], "node_id long, x array<double>")
    labels = spark.createDataFrame([(i, i // 8) for i in range(16)], "node_id long, macro int")
    r = scoring.score_config(points, vals, vecs, labels, 0, {"macro": 2}, grid=spectral.logspace(spark, -1, 2, 12), runs=2).first()
    assert r["ari_macro"] == 1 and r["nmi_macro"] == pytest.approx(1) and r["n_peaks"] >= 0 and 0.1 <= r["sigma_best"] <= 100


def test_records_caches_and_latex(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "full", "ari_macro": 0.5}, {"name": "full", "r": 20, "seed": 43, "ari_macro": 0.25}]))
    got = records.read_records(spark, [f"{tmp_path}/a.json", f"{tmp_path}/absent.json"])
    assert sorted((r["name"], r["r"], r["seed"], r["ari_macro"]) for r in got.collect()) == [("full", 20, 43, 0.25), ("full", 200, 42, 0.5)]
    assert records.read_records(spark, [f"{tmp_path}/absent.json"]).count() == 0
    d = spark.createDataFrame([(20, 1.0), (40, 2.0)], "r int, v double")
    records.write_cache(d, f"{tmp_path}/cache", 2, ["r"])
    records.write_cache(d.where("r = 20").withColumn("v", graph.F.lit(9.0)), f"{tmp_path}/cache", 2, ["r"])
    records.write_cache(d, f"{tmp_path}/cache", 1, ["r"])
    assert sorted((r["r"], r["v"]) for r in records.read_cache(spark, f"{tmp_path}/cache", 2).collect()) == [(20, 9.0), (40, 2.0)]
    records.write_latex(d, f"{tmp_path}/tex")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/tex").collect()] == [r"20 & 1.0 \\", r"40 & 2.0 \\"]


def test_stream_drops_late_events(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string"
    put = lambda rows: spark.createDataFrame(rows, "t string, user_id long, event_type string").selectExpr("to_timestamp(t) AS ts", "user_id", "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: edges.maintain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    put([("2024-01-01 05:00:00", 1, "a"), ("2024-01-01 06:00:00", 1, "a"), ("2024-01-08 00:00:00", 2, "b")])
    run()
    put([("2024-01-01 07:00:00", 1, "a"), ("2024-01-20 00:00:00", 3, "c")])  # the first is late
    run()
    rows = sorted((r["src"], r["dst"], r["w"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [(1, "a", 2), (2, "b", 1)]
