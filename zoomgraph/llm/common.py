"""Helpers shared by the training-data operators: scratch tables, bounded joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most this many narrow rows may be broadcast; larger ones are joined by a salted key.
SMALL_ROWS = 100_000
SALTS = 64


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set, a temporary one serves a local session; on a
    cluster that is an error, as executors could not read it."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="zoomgraph-"))
        at = sc.getCheckpointDir()
    return at


def _remove(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may be gone by then
        pass


def cut(df: DataFrame, *measures: Column) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage, and nothing is lost with an executor.

    ``measures`` are aggregates of df that are taken on the way; they come as ``measured`` of the result."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/zg-{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    (df.observe(seen, *measures) if measures else df).write.option("compression", "zstd").parquet(path)
    sc = spark.sparkContext
    atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch, out.measured = path, seen.get if measures else None
    return out


def release(*tables: DataFrame) -> None:
    """Free scratch tables of ``cut`` that nothing will read again."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        _remove(sc._jvm, sc._jsc.hadoopConfiguration(), t.scratch)


def private(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` by their names, and all of docs in one struct ``row``, so that no name of docs can clash with one that
    an operator uses. ``row.*`` gives docs back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def join_small(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "inner", few: bool | None = None) -> DataFrame:
    """Join rows with a table of one narrow row per key.

    The table is broadcast only if it is counted to hold at most SMALL_ROWS rows (``few``: whether it was). Beyond
    that, hot keys are dealt over SALTS partitions by ``spread`` and the table is repeated for each of them."""
    if few if few is not None else table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add: its own outputs win over clashing names."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
