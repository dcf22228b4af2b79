import numpy as np
import pytest
from pyspark.sql import functions as F

from zoomgraph.functions import arrays
from zoomgraph.functions import geometry as G


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(42)
    x, y = (arrays.project(rng.standard_normal((20, 3)) * 0.4, 0.1) for _ in range(2))
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x array<double>, y array<double>").cache()


def test_known_distance(spark):
    d = spark.createDataFrame([([0.1, 0.0], [0.5, 0.0])], "x array<double>, y array<double>")
    assert d.select(G.poincare_distance("x", "y")).first()[0] == pytest.approx(0.8979415932, abs=1e-9)


def test_columns_match_numpy(pairs):
    rows = pairs.select("x", "y", G.poincare_distance("x", "y").alias("d"), G.mobius_add("x", "y").alias("m"), G.log_map("x", "y").alias("v"), G.conformal_factor("x").alias("c")).collect()
    for r in rows:
        x, y = np.array(r["x"]), np.array(r["y"])
        assert r["d"] == pytest.approx(arrays.distances(x[None], y[None])[0, 0], abs=1e-9)
        np.testing.assert_allclose(r["m"], arrays.mobius_add(x, y), atol=1e-12)
        np.testing.assert_allclose(r["v"], arrays.log_map(x, y), atol=1e-9)
        assert r["c"] == pytest.approx(2 / (1 - x @ x))


def test_round_trip_symmetry_and_self(pairs):
    v = pairs.withColumn("v", G.log_map("x", "y"))
    r = v.select(F.max(F.array_max(F.zip_with(G.exp_map("x", "v"), "y", lambda a, b: F.abs(a - b)))), F.max(F.abs(G.poincare_distance("x", "y") - G.poincare_distance("y", "x"))), F.max(G.poincare_distance("x", "x")), F.max(G.norm(G.log_map("x", "x")))).first()
    assert r[0] < 1e-5 and r[1] < 1e-9 and r[2] == 0 and r[3] < 1e-15


def test_projection(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.3, 0.4],)], "x array<double>")
    got = [r[0] for r in d.select(G.norm(G.project_to_ball("x"))).collect()]
    assert got == pytest.approx([1 - 1e-5, 0.5])


def test_frechet_mean():
    p = np.array([[0.5, 0], [-0.5, 0], [0, 0.5], [0, -0.5]])
    np.testing.assert_allclose(arrays.frechet_mean(p, np.ones(4)), 0, atol=1e-4)
    np.testing.assert_allclose(arrays.frechet_mean(p, np.full(4, 7.0)), arrays.frechet_mean(p, np.ones(4)))
    np.testing.assert_allclose(arrays.frechet_mean(p[:1], np.ones(1)), p[0])
    for w in (-np.ones(4), np.ones(3), np.zeros(4)):
        with pytest.raises(ValueError):
            arrays.frechet_mean(p, w)
