"""Experiment sweeps as tables: grids, resuming, merging, aggregation, intervals and checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import wilcoxon

KEYS = ["r", "seed", "name"]


def seeds(spec: str) -> list[int]:
    """'42-46,50' -> [42, 43, 44, 45, 46, 50]"""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
    return out


def grid(spark: SparkSession, rs: list[int], seed_list: list[int], names: list[str]) -> DataFrame:
    one = lambda v, schema: spark.createDataFrame([(x,) for x in v], schema)
    return one(rs, "r int").crossJoin(one(seed_list, "seed int")).crossJoin(one(names, "name string"))


def remaining(planned: DataFrame, done: DataFrame) -> DataFrame:
    """What of planned(r, seed, name) is not done; records of old form lack r and seed and mean 200 and 42."""
    d = done.select(F.coalesce("r", F.lit(200)).alias("r"), F.coalesce("seed", F.lit(42)).alias("seed"), "name")
    return planned.join(d, KEYS, "left_anti")


def merge(parts: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """All records, of equal keys that of the first part."""
    numbered = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rest = sorted(c for c in every.columns if c not in keys and c != "__part" and not isinstance(every.schema[c].dataType, type(None)))
    w = Window.partitionBy(*keys).orderBy("__part", *[F.col(c).cast("string") for c in rest])
    return every.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__part")


def summarize(records: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Count, median, quartiles, least and most of each value; for every combination of ``by`` there is."""
    aggs = []
    for v in values:
        aggs += [F.median(v).alias(f"{v}_median"), F.percentile(v, F.lit(0.25)).alias(f"{v}_q25"), F.percentile(v, F.lit(0.75)).alias(f"{v}_q75"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    got = records.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    cells = reduce(lambda a, b: a.crossJoin(b), [records.select(c).distinct() for c in by])
    return cells.join(got, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def no_negative_zero(x: Column) -> Column:
    """0 instead of what would print as -0.00."""
    return F.when((x > -5e-3) & (x < 0), 0.0).otherwise(x)


def modal_count(records: DataFrame, by: list[str]) -> DataFrame:
    """(n): the most common number of records of a cell, of equals the least."""
    c = records.groupBy(*by).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("cells"))
    return c.orderBy(F.desc("cells"), "n").limit(1).select("n")


def bootstrap(values: np.ndarray, n: int = 10_000, alpha: float = 0.05, seed: int = 0, stat: Callable = np.median) -> tuple[float, float, float]:
    """(stat, low, high) by BCa, by percentiles where that can't be formed; NaN for none, thrice one value."""
    v = np.asarray(values, float)
    if len(v) < 2:
        return (float(v[0]),) * 3 if len(v) else (float("nan"),) * 3
    point = float(stat(v))
    b = stat(np.random.default_rng(seed).choice(v, (n, len(v))), axis=1)
    norm = NormalDist()
    jack = np.array([stat(np.delete(v, i)) for i in range(len(v))])
    d = jack.mean() - jack
    below = ((b < point).sum() + (b == point).sum() / 2) / n
    q = [alpha / 2, 1 - alpha / 2]
    if (d * d).sum() > 0 and 0 < below < 1:
        z0, acc = norm.inv_cdf(below), (d**3).sum() / (6 * (d * d).sum() ** 1.5)
        z = [z0 + norm.inv_cdf(x) for x in q]
        q = [norm.cdf(z0 + x / (1 - acc * x)) for x in z]
    return point, float(np.quantile(b, q[0])), float(np.quantile(b, q[1]))


def bootstrap_mean(values: np.ndarray, n: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float, float]:
    """(median, low, high): percentiles of resampled means around the median; NaN for none, thrice one value."""
    v = np.asarray(values, float)
    if len(v) < 2:
        return (float(v[0]),) * 3 if len(v) else (float("nan"),) * 3
    b = np.random.default_rng(seed).choice(v, (n, len(v))).mean(axis=1)
    return float(np.median(v)), float(np.quantile(b, alpha / 2)), float(np.quantile(b, 1 - alpha / 2))


def bootstrap_ci(records: DataFrame, value: str, by: list[str], method: Callable = bootstrap) -> DataFrame:
    """(by, median, low, high) for each group, by ``bootstrap`` or ``bootstrap_mean``. A group is a cell's few runs."""
    kinds = dict(records.dtypes)

    def run(t: pa.Table) -> pa.Table:
        m, lo, hi = method(np.sort(t.column(value).drop_null().to_numpy()))
        return pa.table({**{k: t.column(k).slice(0, 1) for k in by}, "median": [m], "low": [lo], "high": [hi]})

    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", median double, low double, high double"
    return records.select(*by, F.col(value).cast("double").alias(value)).groupBy(*by).applyInArrow(run, schema)


def pivot_cells(records: DataFrame, value: str, row: str = "name", col: str = "r") -> DataFrame:
    """A row a config and a column an r: 'median [low, high]' from three seeds on, else the value, else '--'."""
    c = records.groupBy(row, col).agg(F.count(value).alias("n"), F.min(value).alias("one"))
    c = c.join(bootstrap_ci(records, value, [row, col]), [row, col])
    show = lambda x: F.format_string("%.2f", no_negative_zero(F.col(x)))
    cell = F.when(F.col("n") >= 3, F.concat(show("median"), F.lit(" ["), show("low"), F.lit(", "), show("high"), F.lit("]"))).otherwise(show("one"))
    out = c.withColumn("cell", cell).groupBy(row).pivot(col).agg(F.first("cell"))
    return out.select(row, *[F.coalesce(F.col(f"`{x}`"), F.lit("--")).alias(x) for x in out.columns if x != row])


def differ(medians: DataFrame, a: str, b: str, value: str, most: float) -> DataFrame:
    """(r, gap): where two configs' medians of ``value`` differ by more than ``most``."""
    x = medians.where(F.col("name") == a).select("r", F.col(value).alias("va"))
    y = medians.where(F.col("name") == b).select("r", F.col(value).alias("vb"))
    return x.join(y, "r").withColumn("gap", F.abs(F.col("va") - F.col("vb"))).where(F.col("gap") > most).select("r", "gap")


def nearest_scale(ks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(target) with sigma and k_star of the grid's nearest scale, of two the smaller."""
    return wanted.join(F.broadcast(ks)).groupBy("target").agg(F.min_by(F.struct("sigma", "k_star"), F.struct(F.abs(F.col("sigma") - F.col("target")), F.col("sigma"))).alias("z")).select("target", "z.*")


def log_histogram(values: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """(bin, n): counts in equal bins of log10, the last closed above."""
    lo, hi = values.where(F.col(col) > 0).agg(F.min(F.log10(col)), F.max(F.log10(col))).first()
    if lo is None:
        return values.sparkSession.createDataFrame([], "bin int, n long")
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.log10(col) - lo) / width), F.lit(bins - 1)).cast("int")
    return values.where(F.col(col) > 0).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def paired_effect(records: DataFrame, a: str, b: str, value: str, keys: tuple[str, ...] = ("r", "seed")) -> DataFrame:
    """(gap, low, high, n, w, z, p): mean of config a's value less b's over the keys that both have, its BCa interval, and
    Wilcoxon's signed-rank test; no row without a pair."""
    side = lambda name, to: records.where(F.col("name") == name).select(*keys, F.col(value).cast("double").alias(to))
    both = side(a, "x").join(side(b, "y"), list(keys)).select("x", "y", (F.col("x") - F.col("y")).alias("d"), F.lit(0).alias("g"))
    mean = bootstrap_ci(both, "d", ["g"], partial(bootstrap, stat=np.mean))
    return mean.select(F.col("median").alias("gap"), "low", "high").crossJoin(wilcoxon(both))


def weights_label(a: Column, b: Column, c: Column) -> Column:
    """Three weights as LaTeX, to six decimals without trailing zeros; thirds as fractions."""
    show = lambda x: F.regexp_replace(x.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
    thirds = reduce(lambda x, y: x & y, [F.abs(x - 1 / 3) < 1e-3 for x in (a, b, c)])
    plain = F.concat(F.lit("$("), show(a), F.lit(","), show(b), F.lit(","), show(c), F.lit(")$"))
    return F.when(thirds, r"$(\tfrac{1}{3},\tfrac{1}{3},\tfrac{1}{3})$").otherwise(plain)


#: Fixed values of the published claims: configs, largest gaps, the drops expected at each r, their tolerance.
FULL, RANDOM, BINARY, DIRECT, EUCLIDEAN = "full", "full (random points)", "full (binary kNN)", "direct Laplacian", "full (euclidean)"
DROPS, DROP_TOLERANCE, DROPS_BELOW = {80: 0.06, 100: 0.04, 150: 0.10, 200: 0.08}, 0.03, 3


def claim_failures(medians: DataFrame) -> DataFrame:
    """(claim, r, gap) where medians(name, r, macro, meso) break a published claim; configs and cells that are absent break none.

    Random points: within 0.05 of the full config, meso at r = 150 left out. Binary kNN: within 0.03, meso up to r = 100.
    Direct Laplacian: macro at most 0.1 at r = 20 and 40. Euclidean: meso lower by DROPS, and not higher in at least
    three cells, else one row with their number and no r."""
    low = medians.where((F.col("name") == DIRECT) & F.col("r").isin(20, 40) & (F.col("macro") > 0.1)).select("r", F.col("macro").alias("gap"))
    side = lambda name, to: medians.where((F.col("name") == name) & F.col("meso").isNotNull()).select("r", F.col("meso").alias(to))
    expected = reduce(lambda e, x: e.when(F.col("r") == x[0], x[1]), DROPS.items(), F.when(F.lit(False), 0.0))
    drops = side(FULL, "a").join(side(EUCLIDEAN, "b"), "r").select("r", (F.col("a") - F.col("b")).alias("gap"), expected.alias("want")).where("want is not null")
    there = medians.agg(F.count_if(F.col("name") == FULL).alias("a"), F.count_if(F.col("name") == EUCLIDEAN).alias("b"))
    sign = drops.agg(F.count_if(F.col("gap") >= 0).cast("double").alias("gap")).crossJoin(there).where((F.col("a") > 0) & (F.col("b") > 0) & (F.col("gap") < DROPS_BELOW))
    found = {
        "random_macro": differ(medians, FULL, RANDOM, "macro", 0.05),
        "random_meso": differ(medians, FULL, RANDOM, "meso", 0.05).where("r <> 150"),
        "binary_macro": differ(medians, FULL, BINARY, "macro", 0.03),
        "binary_meso": differ(medians, FULL, BINARY, "meso", 0.03).where("r <= 100"),
        "direct_macro": low,
        "euclidean_drop": drops.where(F.abs(F.col("gap") - F.col("want")) > DROP_TOLERANCE),
        "euclidean_sign": sign.select(F.lit(None).alias("r"), "gap"),
    }
    return reduce(DataFrame.unionByName, [d.select(F.lit(claim).alias("claim"), F.col("r").cast("int").alias("r"), "gap") for claim, d in found.items()])


def incomplete(planned: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, expected) of the planned(keys, expected) jobs that have fewer records than expected."""
    n = records.groupBy(*keys).agg(F.count("*").alias("n"))
    return planned.join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "expected").where("n < expected")
