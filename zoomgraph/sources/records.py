"""Reading and writing graphs, points and experiment records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "name string, alpha_weights array<double>, peak_alpha double, laplacian_source string, embedding_type string, n_peaks int, sigma_best double, k_star_best int, ari_macro double, ari_meso double, nmi_macro double, nmi_meso double, t_scan_s double, r int, seed int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_records(spark: SparkSession, paths: list[str], schema: str = RUN) -> DataFrame:
    """JSON lists of records; missing files are skipped, missing r and seed are 200 and 42."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(there).withColumn("r", F.coalesce("r", F.lit(200))).withColumn("seed", F.coalesce("seed", F.lit(42)))


def write_cache(df: DataFrame, path: str, version: int, keys: list[str]) -> None:
    """Parquet by version and keys; a re-run replaces only the partitions it has."""
    df.withColumn("schema_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema_version", *keys).parquet(path)


def read_cache(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Only the asked version's partitions are read."""
    return spark.read.parquet(path).where(F.col("schema_version") == version).drop("schema_version")


def write_latex(df: DataFrame, path: str) -> None:
    """A small table as rows of LaTeX, one text file a partition, in the order of the first column."""
    first = df.columns[0]
    df.orderBy(first).select(F.concat(F.concat_ws(" & ", *[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(r" \\")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def ball_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, x): the embeddings scaled into the ball, to norms 0.1 to 0.9 that the id gives."""
    s = F.lit(0.1) + F.lit(0.8) * (F.pmod(F.col("vec_id") * 7919, F.lit(1000)) / F.lit(1000.0))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v * s).alias("x"))


#: Offsets that keep the levels of the trade hierarchy apart in one id space.
LEVEL = 10**12


def trade_hierarchy(spark: SparkSession, sf_dir: str, levels: int = 3) -> DataFrame:
    """hier(child, parent): a root, regions, nations, customers and, with more levels, orders and line items.

    Ids are level * LEVEL + key; the root is 0."""
    t = lambda name: table(spark, sf_dir, name)
    at = lambda level, key: (F.lit(level * LEVEL) + F.col(key)).cast("long")
    parts = [
        t("region").select(at(1, "r_regionkey").alias("child"), F.lit(0).cast("long").alias("parent")),
        t("nation").select(at(2, "n_nationkey"), at(1, "n_regionkey")),
        t("customer").select(at(3, "c_custkey"), at(2, "c_nationkey")),
        t("orders").select(at(4, "o_orderkey"), at(3, "o_custkey")),
    ]
    out = parts[0]
    for p in parts[1:levels]:
        out = out.union(p)
    return out
