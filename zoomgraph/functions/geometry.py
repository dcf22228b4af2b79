"""Poincaré-ball geometry of curvature -1 on array<double> columns.

All functions are expressions that Catalyst can push around; numpy twins for Arrow functions are in
``arrays.py``. Points are taken to lie in the open ball; ``project_to_ball`` brings them there."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(values: dict[str, Column], body) -> Column:
    """body(v) with v[name] worked out once a row, whatever lambdas it stands in."""
    one = F.array(F.struct(*[c.alias(k) for k, c in values.items()]))
    return F.transform(one, body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def sq_norm(x) -> Column:
    return total(F.transform(_c(x), lambda a: a * a))


def norm(x) -> Column:
    return F.sqrt(sq_norm(x))


def scale(x, by) -> Column:
    return F.transform(_c(x), lambda a: a * by)


def sq_distance(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def euclidean_distance(x, y) -> Column:
    return F.sqrt(sq_distance(x, y))


def poincare_distance(x, y) -> Column:
    """acosh(1 + 2|x-y|^2 / ((1-|x|^2)(1-|y|^2))), by asinh of half the chord: exact for near points too."""
    chord = F.sqrt(sq_distance(x, y) / ((1 - sq_norm(x)) * (1 - sq_norm(y))))
    return 2 * F.asinh(chord)


def mobius_add(x, y) -> Column:
    def add(v):
        den = 1 + 2 * v["xy"] + v["xx"] * v["yy"]
        return F.zip_with(v["x"], v["y"], lambda a, b: ((1 + 2 * v["xy"] + v["yy"]) * a + (1 - v["xx"]) * b) / den)

    points = {"x": _c(x), "y": _c(y)}
    return let(points, lambda p: let({"x": p["x"], "y": p["y"], "xy": dot(p["x"], p["y"]), "xx": sq_norm(p["x"]), "yy": sq_norm(p["y"])}, add))


def conformal_factor(x) -> Column:
    return F.lit(2.0) / F.greatest(1 - sq_norm(x), F.lit(1e-10))


def project_to_ball(x, eps: float = 1e-5) -> Column:
    to = lambda v: F.when(v["n"] >= 1 - eps, scale(v["x"], F.lit(1 - eps) / v["n"])).otherwise(v["x"])
    return let({"x": _c(x)}, lambda p: let({"x": p["x"], "n": norm(p["x"])}, to))


def exp_map(x, v) -> Column:
    """The point reached from x along the tangent v; x itself for v = 0. The result is projected."""

    def step(p):
        far = F.tanh(p["f"] * p["n"] / 2) / p["n"]
        return F.when(p["n"] == 0, p["x"]).otherwise(project_to_ball(mobius_add(p["x"], scale(p["v"], far))))

    return let({"x": _c(x), "v": _c(v)}, lambda p: let({"x": p["x"], "v": p["v"], "n": norm(p["v"]), "f": conformal_factor(p["x"])}, step))


def log_map(x, y) -> Column:
    """The tangent at x that leads to y; the zero vector where they are equal."""

    def back(p):
        by = F.lit(2.0) / p["f"] * F.atanh(F.least(p["n"], F.lit(1 - 1e-7))) / p["n"]
        return F.when(p["n"] == 0, scale(p["w"], F.lit(0.0))).otherwise(scale(p["w"], by))

    moved = let({"x": _c(x), "y": _c(y)}, lambda p: F.struct(mobius_add(scale(p["x"], F.lit(-1.0)), p["y"]).alias("w"), conformal_factor(p["x"]).alias("f")))
    return let({"m": moved}, lambda p: let({"w": p["m"]["w"], "f": p["m"]["f"], "n": norm(p["m"]["w"])}, back))


def log_map_origin(x) -> Column:
    near = lambda v: scale(v["x"], F.atanh(v["n"]) / v["n"])
    return let({"x": _c(x)}, lambda p: let({"x": p["x"], "n": F.least(F.greatest(norm(p["x"]), F.lit(1e-15)), F.lit(1 - 1e-7))}, near))


def register(spark: SparkSession) -> None:
    """The scalar functions as SQL functions of the session."""
    n2 = "aggregate(transform({0}, a -> a * a), 0D, (s, a) -> s + a)"
    d2 = "aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, a) -> s + a)"
    for name, args, out, body in (
        ("zg_norm", "x ARRAY<DOUBLE>", "DOUBLE", f"sqrt({n2.format('x')})"),
        ("zg_euclidean_distance", "x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "DOUBLE", f"sqrt({d2})"),
        ("zg_poincare_distance", "x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "DOUBLE", f"2 * asinh(sqrt({d2} / ((1 - {n2.format('x')}) * (1 - {n2.format('y')}))))"),
        ("zg_conformal_factor", "x ARRAY<DOUBLE>", "DOUBLE", f"2 / greatest(1 - {n2.format('x')}, 1e-10)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
