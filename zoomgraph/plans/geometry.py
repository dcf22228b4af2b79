"""Geometry of the embeddings in the ball."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.records import ball_points

#: The points of sources.records.ball_points in SQL, with squared norms.
POINTS = """pts AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE * (0.1::DOUBLE + 0.8::DOUBLE * ((vec_id * 7919) % 1000 / 1000.0::DOUBLE))) AS x FROM embeddings),
    p AS (SELECT id, x, list_dot_product(x, x) AS nn FROM pts)"""
DIST = "2 * asinh(list_distance({a}.x, {b}.x) / sqrt((1 - {a}.nn) * (1 - {b}.nn)))"


def _r(c, n=6):
    return F.round(c, n) + F.lit(0.0)


def _pairs(spark, sf_dir):
    p = ball_points(spark, sf_dir)
    q = p.select((F.col("node_id") - 1).alias("node_id"), F.col("x").alias("y"))
    return p.join(q, "node_id")


def points(spark, sf_dir):
    return ball_points(spark, sf_dir).select("node_id", _r(G.norm("x")).alias("norm"))


def conformal(spark, sf_dir):
    return ball_points(spark, sf_dir).select("node_id", _r(G.conformal_factor("x")).alias("factor"))


def distance_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("node_id", _r(G.poincare_distance("x", "y")).alias("d"), _r(G.euclidean_distance("x", "y")).alias("e"))


def mobius(spark, sf_dir):
    m = G.mobius_add("x", "y")
    return _pairs(spark, sf_dir).select("node_id", _r(G.norm(m)).alias("norm"), _r(m[0]).alias("first"))


def round_trip(spark, sf_dir):
    v = _pairs(spark, sf_dir).withColumn("v", G.log_map("x", "y"))
    back = G.exp_map("x", "v")
    return v.select("node_id", _r(G.norm("v")).alias("tangent"), _r(F.array_max(F.zip_with(back, "y", lambda a, b: F.abs(a - b)))).alias("error"))


def projected(spark, sf_dir):
    wide = ball_points(spark, sf_dir).withColumn("x", G.scale("x", F.lit(1.5)))
    return wide.select("node_id", _r(G.norm(G.project_to_ball("x"))).alias("norm"))


def log_origin(spark, sf_dir):
    return ball_points(spark, sf_dir).select("node_id", _r(G.norm(G.log_map_origin("x"))).alias("norm"))


def sql_functions(spark, sf_dir):
    G.register(spark)
    _pairs(spark, sf_dir).createOrReplaceTempView("zg_pairs")
    return spark.sql("SELECT node_id, round(zg_poincare_distance(x, y), 6) + 0D AS d, round(zg_conformal_factor(x), 6) + 0D AS factor FROM zg_pairs")


QUERIES = {"ball_points": points, "conformal_factor": conformal, "distance_pairs": distance_pairs, "mobius_add_pairs": mobius, "exp_log_roundtrip": round_trip, "project_to_ball": projected, "log_map_origin": log_origin, "sql_functions": sql_functions}

_MOB = "list_transform(range(1, len(a.x) + 1), lambda i: ((1 + 2 * list_dot_product(a.x, b.x) + b.nn) * a.x[i] + (1 - a.nn) * b.x[i]) / (1 + 2 * list_dot_product(a.x, b.x) + a.nn * b.nn))"
SQL = {
    "ball_points": f"WITH {POINTS} SELECT id AS node_id, round(sqrt(nn), 6) AS norm FROM p",
    "conformal_factor": f"WITH {POINTS} SELECT id AS node_id, round(2 / greatest(1 - nn, 1e-10), 6) AS factor FROM p",
    "distance_pairs": f"WITH {POINTS} SELECT a.id AS node_id, round({DIST.format(a='a', b='b')}, 6) AS d, round(list_distance(a.x, b.x), 6) AS e FROM p a JOIN p b ON b.id = a.id + 1",
    "mobius_add_pairs": f"WITH {POINTS}, m AS (SELECT a.id, {_MOB} AS m FROM p a JOIN p b ON b.id = a.id + 1) SELECT id AS node_id, round(sqrt(list_dot_product(m, m)), 6) AS norm, round(m[1], 6) + 0.0::DOUBLE AS first FROM m",
    "exp_log_roundtrip": f"WITH {POINTS} SELECT a.id AS node_id, round((1 - a.nn) * {DIST.format(a='a', b='b')} / 2, 6) AS tangent, 0.0::DOUBLE AS error FROM p a JOIN p b ON b.id = a.id + 1",
    "project_to_ball": f"WITH {POINTS} SELECT id AS node_id, round(least(1.5 * sqrt(nn), 1 - 1e-5), 6) AS norm FROM p",
    "log_map_origin": f"WITH {POINTS} SELECT id AS node_id, round(atanh(sqrt(nn)), 6) AS norm FROM p",
    "sql_functions": f"WITH {POINTS} SELECT a.id AS node_id, round({DIST.format(a='a', b='b')}, 6) AS d, round(2 / (1 - a.nn), 6) AS factor FROM p a JOIN p b ON b.id = a.id + 1",
}
