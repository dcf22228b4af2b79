import numpy as np
import pytest
from pyspark.sql import functions as F

from zoomgraph.functions import arrays
from zoomgraph.operators import diffusion, graph, knn, spectral
from zoomgraph.plans import graphs


def points(spark, n=30, d=3, seed=42, extra=()):
    x = np.random.default_rng(seed).standard_normal((n, d)) * 0.2
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*x, *extra])], "node_id long, x array<double>"), np.array([*x, *extra])


def test_knn_matches_brute_force_with_ties_and_copies(spark):
    p, x = points(spark, extra=[np.zeros(3)] * 3)
    got = {(r["i"], r["rank"]): r["j"] for r in knn.knn(p, 5).collect()}
    d = arrays.distances(x, x)
    for i in range(len(x)):
        want = [j for j in sorted(range(len(x)), key=lambda j: (round(d[i, j], 12), j)) if j != i][:5]
        assert [got[i, r] for r in range(1, 6)] == want


def test_blocks_do_not_change_neighbours(spark, monkeypatch):
    p, _ = points(spark, 60)
    whole = {tuple(r) for r in knn.knn(p, 7).select("i", "j", "rank").collect()}
    monkeypatch.setattr(knn.blocks, "__defaults__", (16,))
    assert {tuple(r) for r in knn.knn(p, 7).select("i", "j", "rank").collect()} == whole


def test_only_finished_neighbours_leave_a_strip_and_the_graph_searches_once(spark, monkeypatch):
    p, x = points(spark, 90, extra=[np.full(3, 0.1)] * 40)
    monkeypatch.setattr(knn.blocks, "__defaults__", (16,))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(knn.knn(p, 7))
    assert "MapInArrow" not in plan(knn.knn_graph(p, 7))
    for metric in ("poincare", "euclidean"):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        if metric == "poincare":
            s = 1 - (x * x).sum(1)
            d = 2 * np.arcsinh(d / np.sqrt(s[:, None] * s[None]))
        np.fill_diagonal(d, np.inf)
        got = {(r["i"], r["rank"]): r["j"] for r in knn.knn(p, 7, metric).collect()}
        assert got == {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(np.argsort(d[i], kind="stable")[:7].tolist())}


def test_blocks_are_streamed_to_strips_not_written_for_each_and_searched_once(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p, x = points(spark, 150, extra=[np.full(3, 0.1)] * 40)
    monkeypatch.setattr(knn.blocks, "__defaults__", (16,))
    monkeypatch.setattr(knn, "STRIP", 2)
    near = knn.knn(p, 7)
    assert "Exchange" not in plan(near)
    assert near.rdd.getNumPartitions() == 8  # 12 blocks of 4 cores
    assert plan(knn.symmetric(near)).count("MapInArrow") == 1
    d = arrays.distances(x, x)
    np.fill_diagonal(d, np.inf)
    got = {(r["i"], r["rank"]): r["j"] for r in near.collect()}
    assert got == {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(np.argsort(d[i].round(12), kind="stable")[:7].tolist())}


def test_exact_median_by_ranges(spark):
    rng = np.random.default_rng(1)
    for v in ([], [3.0], [1.0, 2.0], [2.0] * 9 + [1e-300, 1e300], rng.lognormal(0, 9, 501), np.r_[rng.random(300), rng.random(300)], [1.0, np.nextafter(1.0, 2), 1.0, np.nextafter(1.0, 2)]):
        df = spark.createDataFrame([(float(a),) for a in v], "d double")
        want = df.agg(F.median("d")).first()[0]
        assert knn.median(df, bins=4) == want and knn.median(df) == want


@pytest.mark.parametrize("name", ["combinatorial_laplacian", "degrees", "normalized_laplacian", "laplacian_l1_norm"])
def test_laplacians_read_the_graph_of_one_search(spark, name):
    df = graphs.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "MapInArrow" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["combinatorial_laplacian", "degrees", "normalized_laplacian", "laplacian_l1_norm", "heat_weights_exact", "weight_divergence"])
def test_neighbours_are_searched_once_and_blocks_written_once(spark, monkeypatch, name):
    kept, keep = [], knn.checkpointed
    monkeypatch.setattr(knn, "checkpointed", lambda df: kept.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    graphs.QUERIES[name](spark, "/root/testdata/sf0.001")
    blocks, edges = kept  # what the search reads, and what comes of it
    assert "strip" not in blocks
    assert edges.count("MapInArrow") == 1 and "Exchange" not in edges.split("MapInArrow")[1]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["combinatorial_laplacian", "degrees", "normalized_laplacian", "laplacian_l1_norm", "heat_weights_exact", "weight_divergence"])
def test_blocks_are_not_shuffled_and_edges_kept_once(spark, monkeypatch, name):
    kept, keep = [], knn.checkpointed
    monkeypatch.setattr(knn, "checkpointed", lambda df: kept.append(df) or keep(df))
    graphs.QUERIES[name](spark, "/root/testdata/sf0.001")
    packed, edges = kept
    assert "Exchange" not in _plan(packed)
    n, ordered, unlike = edges.selectExpr("count(*)", "count_if(i < j)", "count(distinct i, j)").first()
    assert n == ordered == unlike > 0


def test_blocks_hold_every_point_once_however_the_input_is_dealt(spark):
    p, x = points(spark, 100)
    for parts in (1, 3, 60):
        rows = knn.blocks(p.repartition(parts, "node_id"), 100, 16).collect()
        assert all(len(r["ids"]) <= 16 * 8 for r in rows) and len({(r["part"], r["at"]) for r in rows}) == len(rows) <= 13
        got = {i: v for r in rows for i, v in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["xs"]).reshape(-1, 3).tolist(), strict=True)}
        assert sum(len(r["ids"]) for r in rows) == 800 and got == dict(enumerate(x.tolist()))
    with pytest.raises(Exception, match="unlike dimensions"):
        knn.blocks(p.union(spark.createDataFrame([(100, [0.1] * 2)], p.schema)).coalesce(1), 101).collect()


@pytest.mark.parametrize("name", ["normalized_laplacian", "laplacian_l1_norm"])
def test_edges_meet_their_degrees_once_each(spark, name):
    plan = _plan(graphs.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Generate" in plan and plan.index("Generate") < plan.index("Join")


def test_laplacian_of_edges_once_each(spark):
    nodes = spark.range(9).withColumnRenamed("id", "node_id")  # 8 has no edge
    once = spark.createDataFrame([(0, 1, 0.5), (1, 7, 2.0), (2, 3, 1e-9), (0, 7, 3.0), (4, 5, 1.0), (5, 6, 0.25)], "i long, j long, w double")
    rows = lambda df: sorted((r["i"], r["j"], round(r["v"], 12)) for r in df.collect())
    got = rows(graph.normalized_laplacian(nodes, once, half=True))
    assert got == rows(graph.normalized_laplacian(nodes, graph.both(once))) and len(got) == 9 + 12


def test_heat_weights_of_a_graph_join_no_degrees(spark, monkeypatch):
    nodes = spark.range(9).withColumnRenamed("id", "node_id")  # 8 has no edge
    once = spark.createDataFrame([(0, 1, 0.5), (1, 7, 2.0), (2, 3, 1e-9), (0, 7, 3.0), (4, 5, 1.0), (5, 6, 0.25)], "i long, j long, w double")
    foci = spark.createDataFrame([(0,), (2,), (8,), (77,)], "focus long")
    grid = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 20.0)], "sigma_idx int, sigma double")
    lap = graph.normalized_laplacian(nodes, once, half=True)
    want = {tuple(r)[:4]: r["w"] for r in diffusion.heat_weights_exact(nodes, lap, foci, grid, 2.0).collect()}
    monkeypatch.delattr(graph, "normalized_laplacian")
    got = {tuple(r)[:4]: r["w"] for r in diffusion.heat_weights_of_graph(nodes, once, foci, grid).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 3 * 9
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert graphs.QUERIES["heat_weights_exact"](spark, "/root/testdata/sf0.001").count() == 1000


def test_knn_edges(spark):
    p, _ = points(spark)
    one = p.where("node_id = 0")
    assert knn.knn(one).count() == 0
    with pytest.raises(ValueError):
        knn.knn(p, 3, "city")
    e = knn.knn_graph(p, 5, tau_value=1.0)
    pairs = {(r["i"], r["j"]) for r in e.collect()}
    assert all((j, i) in pairs and i != j for i, j in pairs)
    assert e.groupBy("i").count().agg(F.min("count")).first()[0] >= 5
    near = {tuple(r) for r in knn.knn(p, 5).select("i", "j").collect()}
    about = {tuple(r) for r in knn.knn_approx(p, 5).select("i", "j").collect()}
    assert len(near & about) >= 0.8 * len(near)


def test_approximate_neighbours_are_nearly_exact(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 12))
    x = centres[rng.integers(40, size=3000)] + 0.3 * rng.standard_normal((3000, 12))
    x = np.concatenate([x, np.repeat(x[:1], 300, 0)])  # a hot point
    x *= 0.95 / np.linalg.norm(x, axis=1).max()
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>").repartition(5)
    got = knn.knn_approx(p, 10, size=64, sample=500).collect()
    assert len(got) == 10 * len(x) and all(r["i"] != r["j"] for r in got)
    d = arrays.distances(x, x)
    np.fill_diagonal(d, np.inf)
    reach = np.sort(d, axis=1)[:, 9]
    assert np.mean([d[r["i"], r["j"]] <= reach[r["i"]] + 1e-9 for r in got]) >= 0.9
    assert all(r["d"] == pytest.approx(d[r["i"], r["j"]], abs=1e-6) for r in got[::50])


def test_isolated_node_and_star(spark):
    nodes = spark.range(4).withColumnRenamed("id", "node_id")
    e = graph.undirected(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    lap = graph.normalized_laplacian(nodes, e)
    assert lap.where("i = 3").collect()[0]["v"] == 1.0
    assert graph.degrees(nodes, e).where("node_id = 3").first()["degree"] == 0
    star = graph.normalized_laplacian(spark.range(101).withColumnRenamed("id", "node_id"), graph.star(spark, 100))
    assert graph.l1_norm(star).first()[0] == pytest.approx(11)
    assert graph.focus_derivative(star, 0).agg(F.sum(F.abs("x"))).first()[0] == pytest.approx(20)
    vals, _ = spectral.eigen(star)
    assert vals.agg(F.max("lambda")).first()[0] == pytest.approx(2)


def test_components_and_hops(spark):
    nodes = spark.range(7).withColumnRenamed("id", "node_id")
    e = graph.undirected(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "src long, dst long"))
    got = {r["node_id"]: r["component"] for r in graph.components(nodes, e).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5}
    assert {tuple(r) for r in graph.largest_component(nodes, e).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    hops = {r["node_id"]: r["hops"] for r in graph.distances_from(nodes, e, nodes.where("node_id = 0")).collect()}
    assert hops == {0: 0, 1: 1, 2: 2, 3: 3}


def test_heat_weights(spark):
    n = 20
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    ring = graph.undirected(spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long"))
    vals, vecs = spectral.eigen(graph.combinatorial_laplacian(nodes, ring))
    w = lambda s: np.array([r["w"] for r in diffusion.heat_weights_at(vals, vecs, 0, s).orderBy("node_id").collect()])
    assert w(0.1)[0] > 0.5 and w(100.0).max() < 0.1 and (w(1.0) >= 0).all() and w(1.0).sum() == pytest.approx(1)
    assert list(w(0)) == [1.0] + [0.0] * 19
    with pytest.raises(ValueError):
        diffusion.heat_weights_at(vals, vecs, 99, 1.0)


def test_powers_are_passes_over_packed_rows(spark):
    rng = np.random.default_rng(3)
    a = np.triu(rng.random((40, 40)) * (rng.random((40, 40)) < 0.1), 1)
    a = (a + a.T) / 5
    ids = np.sort(rng.choice(10**12, 40, replace=False))
    nodes = spark.createDataFrame([(int(i),) for i in ids], "node_id long")
    rows = [(int(ids[i]), int(ids[j]), float(a[i, j] / 2)) for i, j in np.argwhere(a)] * 2  # repeated entries add up
    df = diffusion.heat_weights_by_powers(nodes, spark.createDataFrame(rows, "i long, j long, v double"), int(ids[7]), 1.5)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    w, v = np.linalg.eigh(a)
    want = v @ (np.exp(1.5 * w) * v[7])
    got = {r["node_id"]: r["w"] for r in df.collect()}
    np.testing.assert_allclose([got[i] for i in ids.tolist()], want / want.sum(), atol=1e-10)


@pytest.mark.parametrize("name", ["heat_weights_exact", "weight_divergence"])
def test_all_modes_need_no_eigenpairs(spark, monkeypatch, name):
    monkeypatch.setattr(spectral, "eigen", lambda *a: pytest.fail("a dense decomposition"))
    assert graphs.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("bound", [None, 2.0])
def test_exact_heat_weights_are_those_of_all_eigenpairs(spark, bound):
    nodes = spark.range(31).withColumnRenamed("id", "node_id")  # 30 is isolated
    edges = graph.undirected(spark.createDataFrame([(i, j) for i in range(30) for j in (0, (i * 7 + 1) % 30, (i + 1) % 30)], "src long, dst long"))
    lap = graph.checkpointed(graph.normalized_laplacian(nodes, edges))
    foci, grid = spark.createDataFrame([(0,), (17,), (30,), (99,)], "focus long"), spark.createDataFrame([(0, 0.0), (1, 0.3), (2, 40.0)], "sigma_idx int, sigma double")
    got = diffusion.heat_weights_exact(nodes, lap, foci, grid, bound)
    want = diffusion.heat_weights(*spectral.eigen(lap), foci, grid)
    assert got.dtypes == [("focus", "bigint"), ("sigma_idx", "int"), ("sigma", "double"), ("node_id", "bigint"), ("w", "double")]
    key = lambda df: {(r["focus"], r["sigma_idx"], r["node_id"]): r["w"] for r in df.collect()}
    got, want = key(got), key(want)
    assert got.keys() == want.keys() and len(got) == 3 * 3 * 31
    np.testing.assert_allclose([got[x] for x in want], list(want.values()), atol=1e-9)


def test_spectral_gap(spark):
    def gap(lam, ratio):
        return [r["k"] for r in spectral.spectral_gap(spark.createDataFrame(list(enumerate(lam)), "k int, lambda double"), ratio).orderBy("place").collect()]

    assert len(gap([0.1, 0.2, 0.3, 0.4, 0.5], 5.0)) == 1
    assert gap([0.0, 0.0, 0.5, 1.0, 3.0], 2.0) == [3]
    assert spectral.spectral_gap(spark.createDataFrame([], "k int, lambda double")).count() == 0


def test_least_pairs_from_packed_blocks(spark, monkeypatch):
    monkeypatch.setattr(spectral, "DENSE", 50)
    monkeypatch.setattr(graph, "ROWS", 32)
    nodes = spark.range(240).withColumnRenamed("id", "node_id")  # four rings, so each value is there at least four times
    ring = graph.undirected(spark.createDataFrame([(i, i // 60 * 60 + (i + 1) % 60) for i in range(240)], "src long, dst long"))
    lap = graph.checkpointed(graph.combinatorial_laplacian(nodes, ring))
    a = np.zeros((240, 240))
    for i, j, v in lap.collect():
        a[i, j] += v
    for given in (None, nodes):
        vals, vecs = spectral.eigen(lap, 9, given)
        w = np.array([r["lambda"] for r in vals.orderBy("k").collect()])
        v = np.array([r["phi"] for r in vecs.orderBy("node_id").collect()])
        np.testing.assert_allclose(w, np.linalg.eigvalsh(a)[:9], atol=1e-8)
        np.testing.assert_allclose(a @ v, v * w, atol=1e-6)
        np.testing.assert_allclose(v.T @ v, np.eye(9), atol=1e-9)


def test_a_long_lanczos_run_converges():
    n = 900  # the ends of the spectrum are not separated, so a run goes far beyond its first goal
    a = np.diag(np.linspace(1, 2, n))
    rows, cols = np.nonzero(a)
    w, v = spectral.lanczos_blocks([(rows, np.arange(n), cols, a[rows, cols])], n, 5)
    np.testing.assert_allclose(w, np.linspace(1, 2, n)[:5], atol=1e-8)
    np.testing.assert_allclose(a @ v, v * w, atol=1e-6)


def test_lanczos_finds_repeated_values():
    n = 300
    a = np.zeros((n, n))
    for i in range(n):
        a[i, (i + 1) % n] = a[(i + 1) % n, i] = -1
        a[i, i] = 2
    i, j = np.nonzero(a)
    w, v = spectral.lanczos(i, j, a[i, j], n, 7)
    np.testing.assert_allclose(w, np.linalg.eigvalsh(a)[:7], atol=1e-8)
    np.testing.assert_allclose(a @ v, v * w, atol=1e-6)
