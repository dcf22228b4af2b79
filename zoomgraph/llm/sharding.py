"""Histogram sort into shards of near-equal bytes.

Keys are (CRC-32 of the text, document id): equal texts are neighbours, and a group of copies is split
only where a shard is full. Exact byte counts below candidate boundaries are taken over all partitions,
and the probes are refined around each splitter until its error is within the tolerance. With tolerance 0
the splitters are exact: shard(row) = number of targets that the bytes before the row's key reach. Then
the rows are exchanged once, by small blocks of neighbouring keys, and numbered from block offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, cut, join_small, private, table

LOW = -(2**63)
OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _inside(a: tuple[int, str, int, int]) -> Column:
    hi, axis, lo, up = a
    if axis == "hi":
        return (F.col("hi") >= lo) & (F.col("hi") < up)
    return (F.col("hi") == hi) & (F.col("lo").cast("decimal(20,0)") >= F.lit(str(lo)).cast("decimal(20,0)")) & (F.col("lo").cast("decimal(20,0)") < F.lit(str(up)).cast("decimal(20,0)"))


def _width(a, probes: int) -> int:
    return max(1, -(-(a[3] - a[2]) // probes))


def _bin(a, probes: int) -> Column:
    x = F.col("hi" if a[1] == "hi" else "lo").cast("decimal(20,0)" if a[1] == "lo" else "long")
    if a[1] == "hi":
        return F.floor((x - a[2]) / F.lit(_width(a, probes))).cast("long")
    return F.floor((x - F.lit(str(a[2])).cast("decimal(20,0)")) / F.lit(str(_width(a, probes))).cast("decimal(20,0)")).cast("long")


def splitters(skeleton: DataFrame, total: int, shards: int, probes: int = 4096, tolerance: float = 0.0) -> list[tuple[int, int]]:
    """The first key (hi, lo) of shards 1..shards-1 over ``skeleton(hi, lo, size)``, by refined histograms.

    Each round is one aggregation whose result, at most probes rows for each open splitter, goes to the driver."""
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    first = (0, "hi", -1, 2**32)
    open_ = {j: (first, 0) for j in range(1, shards)}
    while open_:
        spots = sorted({s for s, _ in open_.values()})
        which, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, s in enumerate(spots):
            which, cell = F.when(_inside(s), F.lit(i)).otherwise(which), F.when(_inside(s), _bin(s, probes)).otherwise(cell)
        found = skeleton.select(which.alias("i"), cell.alias("b"), "lo", "size").where(F.col("i").isNotNull()).groupBy("i", "b").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("lo").alias("least"), F.max("lo").alias("most")).collect()
        counts: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["i"], r["b"])):
            counts.setdefault(r["i"], []).append(r)
        for j, (s, below) in list(open_.items()):
            # target j is reached where shards * bytes >= total * j
            width, cum, prev = _width(s, probes), below, None
            end = s[3]
            for r in counts.get(spots.index(s), []):
                if shards * cum >= total * j:
                    end = s[2] + r["b"] * width
                    break
                prev, cum = (r, cum), cum + r["s"]
            key = (lambda x, s=s: (x, LOW) if s[1] == "hi" else (s[0], x))
            if prev is None:
                done[j] = key(s[2])
            else:
                r, before = prev
                a, b = s[2] + r["b"] * width, s[2] + (r["b"] + 1) * width
                over, under = before + r["s"] - total * j / shards, total * j / shards - before
                if r["n"] == 1 or shards * (before + r["s"]) == total * j or (shards * (before + r["s"]) > total * j and over <= slack):
                    done[j] = key(min(b, end))
                elif 0 < under <= slack:
                    done[j] = key(a)
                elif b - a > 1:
                    open_[j] = ((s[0], s[1], a, b), before)
                    continue
                elif s[1] == "hi" and r["most"] > r["least"]:
                    open_[j] = ((a, "lo", r["least"], r["most"] + 1), before)
                    continue
                else:  # one key alone: its repeated rows stay together
                    done[j] = key(b)
            del open_[j]
    return [done[j] for j in range(1, shards)]


def shard_of(at: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for h, lo in at:
        out = out + ((F.col("hi") > h) | ((F.col("hi") == h) & (F.col("lo") >= F.lit(min(lo, 2**63 - 1))) & F.lit(lo < 2**63))).cast("int")
    return out.cast("int")


def histogram_shards(docs: DataFrame, shards: int = 16, tolerance: float = 0.0, block_rows: int = 4096) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard; columns of docs with these names are replaced, any
    other name may occur.

    size: UTF-8 bytes of the text and 1 more; a null text has size 1, a null CRC and sorts first; a null
    doc_id sorts before all others. Repeated rows with one id and text can't be told apart and share a
    shard. Empty input gives an empty result. slot: rank by key within the shard, from 0."""
    crc = F.crc32(F.col("text")).cast("long")
    doc = private(docs, size=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, text_crc32=crc, hi=F.coalesce(crc, F.lit(-1).cast("long")), lo=F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)))
    bones = cut(doc.select("hi", "lo", "size"), F.sum("size").alias("total"), F.count("*").alias("rows"))
    total, rows = bones.measured["total"], bones.measured["rows"]
    at = splitters(bones, total, shards, tolerance=tolerance) if rows else []
    # Blocks of about block_rows neighbours: high bits of hi; whole values of hi where those are too
    # many; pieces of lo where one value is.
    bits = min(32, max(6, math.ceil(math.log2(max(1, rows / (block_rows / 2))))))
    keyed = lambda d: d.withColumn("shard", shard_of(at)).withColumn("c1", F.shiftright(F.col("hi"), 32 - bits))
    full = keyed(bones)
    hot1 = cut(full.groupBy("c1").count().where(F.col("count") > block_rows).select("c1", F.lit(1).alias("big1")), F.count("*").alias("n"))
    few1 = hot1.measured["n"] <= SMALL_ROWS
    hot2 = join_small(full, hot1, "c1", F.col("lo"), few=few1).groupBy("hi").agg(F.count("*").alias("n"), F.min("lo").cast("decimal(20,0)").alias("least"), F.max("lo").cast("decimal(20,0)").alias("most")).where(F.col("n") > block_rows)
    hot2 = cut(hot2, F.count("*").alias("n"))
    few2 = hot2.measured["n"] <= SMALL_ROWS

    def blocks(d: DataFrame) -> DataFrame:
        d = join_small(keyed(d), hot1, "c1", F.col("lo"), "left", few1).withColumn("c2", F.when(F.col("big1") == 1, F.col("hi")).otherwise(F.lit(-2).cast("long")))
        d = join_small(d, hot2, "hi", F.col("lo"), "left", few2)
        span = F.col("most") - F.col("least") + 1
        piece = F.floor((F.col("lo").cast("decimal(20,0)") - F.col("least")).cast("double") * F.ceil(F.col("n") / block_rows) / span.cast("double")).cast("long")
        return d.withColumn("c3", F.coalesce(piece, F.lit(-1).cast("long"))).drop("big1", "n", "least", "most")

    by = Window.partitionBy("shard").orderBy("c1", "c2", "c3").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks(bones).groupBy("shard", "c1", "c2", "c3").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(by), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "c1", "c2", "c3").orderBy("hi", "lo")
    out = blocks(doc).withColumn("slot", F.row_number().over(within).cast("long") - 1).join(offsets, ["shard", "c1", "c2", "c3"])
    out = out.withColumn("slot", F.col("slot") + F.col("first")).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in OUT], *OUT)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *OUT)


def stage_sharding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return histogram_shards(docs)
