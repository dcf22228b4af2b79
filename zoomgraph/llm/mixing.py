"""Mixing sources to target weights by Pareto order sampling.

Every document first gets the whole copies that are certain (the integer part of target over source
size). What then remains of a source's target is sampled with inclusion odds of each document's own: its
probability p is proportional to its size, at most 1, such that the expected words are what remains.
Documents are ranked by Pareto's ratio, random odds u / (1 - u) over inclusion odds p / (1 - p), those that are
certain first, and each is taken in that order if it still fits. So the sample's size is fixed, in words: at the
end no document that was left fits.

Documents are never moved: sums by bins of the rank find where a source's words run out, and the rank, a
function of the row and of numbers of its source, says which rows lie before. Only the few documents that can
still fill the rest are gathered, source by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, WORD, cut, join_small, private, release, table

OUT = ("size", "source_size", "target", "taken", "copies")
#: Bins of the rank, and parts of each; a source's rows of one size are dealt over so many groups.
BINS, DEALT = 1024, 256


def uniform(seed: int):
    """A number in (0, 1) from the document id, the same in every run and engine."""
    h = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / float(2**48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(key, source, source_size), one row a source -> with target.

    Sources by code point (null last) get the weights in turn. Filling all to one level, target =
    least(most * size, weight * level), is where resharing the excess ends."""
    w = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("top", F.col("source_size") * most).withColumn("ratio", F.col("top") / F.col("weight"))
    up = Window.orderBy("ratio", "rank")
    w = w.withColumn("capped", F.coalesce(F.sum("top").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))).withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * share)
    w = w.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    w = w.withColumn("pos", F.row_number().over(up))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("pos"), F.col("level")))).over(Window.partitionBy())
    return w.withColumn("level", first["level"]).select("key", "source", "source_size", F.least("top", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def _factors(rows: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """goal with factor and open_size: of rows(key, size) up to the source's room, sizes above open_size are certain, others
    have probability factor * size; the expected words are room. open_size is 0 where all are certain. Windows
    see one row for each size that a source has."""
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    s = rows.groupBy("key", "size").agg(F.count("*").alias("n"))
    s = join_small(s, goal.select("key", "room"), "key", F.col("size"), few=few).where("size <= room")
    s = s.withColumn("words", F.col("n") * F.col("size")).withColumn("squares", F.col("words").cast("double") * F.col("size"))
    s = s.withColumn("above", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("squares").over(down.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("factor", (F.col("room") - F.col("above")) / F.col("rest"))
    # the largest size that is not certain once all larger ones are
    first = F.max(F.when(F.col("factor") * F.col("size") < 1, F.struct("size", "factor")))
    found = s.groupBy("key").agg(first.alias("z")).select("key", F.col("z.factor").alias("factor"), F.coalesce(F.col("z.size"), F.lit(0)).alias("open_size"))
    return goal.join(found, "key", "left")


def rank(seed: int) -> Column:
    """Pareto's ratio as a number: certain documents lie below 1/2, the others rise with the ratio from there."""
    u, p = uniform(seed), F.col("factor") * F.col("size")
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(F.col("size") > F.col("open_size"), u / 2).otherwise(0.5 + q / (1 + q) / 2)


def _edge(rows: DataFrame, room: DataFrame, b: str, few: bool) -> DataFrame:
    """(key, edge, room): the first bin b of rows(key, b, size) that does not fit whole, and the room at its start."""
    upto = Window.partitionBy("key").orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    s = rows.groupBy("key", b).agg(F.sum("size").alias("s")).withColumn("c", F.sum("s").over(upto))
    s = join_small(s, room, "key", F.col(b), few=few).where("c > room")
    return s.groupBy("key").agg(F.min_by(F.struct(F.col(b).alias("edge"), (F.col("room") - F.col("c") + F.col("s")).alias("room")), b).alias("z")).select("key", "z.*")


def _filled(tail: DataFrame) -> DataFrame:
    """(key, id, size): which of tail(key, id, size, v, room) are taken, one after the other by (v, id, size), each if it fits.

    Of one size only so many can fit as its words go into the room, and those are the first ones. So a
    source keeps about room * log(room) rows at most, where room is less than a bin and one document."""
    t = tail.groupBy("key", "id", "size", "v", "room").agg(F.sum("size").alias("words")).where("words <= room")
    t = t.withColumn("most", F.floor(F.col("room") / F.col("words"))).withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALT)))
    for by in (("key", "words", "deal"), ("key", "words")):
        t = t.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("v", "id", "size"))).where("nth <= most")
    one = t.groupBy("key", "room").agg(F.array_sort(F.collect_list(F.struct("v", "id", "size", "words"))).alias("rows"))
    start = F.struct(F.col("room").cast("double").alias("room"), F.expr("cast(array() as array<struct<id:bigint,size:bigint>>)").alias("took"))
    fits = lambda a, x: x["words"] <= a["room"]
    step = lambda a, x: F.struct(F.when(fits(a, x), a["room"] - x["words"]).otherwise(a["room"]).alias("room"), F.when(fits(a, x), F.concat(a["took"], F.array(F.struct(x["id"].alias("id"), x["size"].alias("size"))))).otherwise(a["took"]).alias("took"))
    return one.select("key", F.explode(F.aggregate("rows", start, step)["took"]).alias("x")).select("key", "x.*")


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 8) -> DataFrame:
    """docs with size (words), source_size, target, taken (words) and copies; columns of docs with these names are
    replaced, any other name may occur.

    A null text has size 0 and a null source is a source of its own, last. A null doc_id counts as the least id.
    Documents of size 0 take nothing but keep their certain copies. Repeated rows (one id, source and size) are
    ranked alike and taken or left together. Empty input gives an empty result."""
    source = F.col("source").cast("string")
    doc = private(docs, id=F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), key=F.coalesce(F.concat(F.lit("="), source), F.lit("")), source=source, size=F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    bones = cut(doc.select("id", "key", "source", "size"))
    goal = targets(bones.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = cut(goal.select("key", "source_size", "target", F.floor(ratio).cast("long").alias("base"), (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("room")), F.count("*").alias("n"))
    few = goal.measured["n"] <= SMALL_ROWS
    part = cut(_factors(bones.where("size > 0"), goal.where("room >= 1"), few))
    v = rank(seed)
    ranked = join_small(bones.where("size > 0"), part.select("key", "room", "factor", "open_size"), "key", F.col("id"), few=few).where("size <= room").withColumn("v", v)
    ranked = ranked.withColumn("b1", F.floor(F.col("v") * BINS)).withColumn("b2", F.floor(F.col("v") * BINS * BINS))
    e1 = cut(_edge(ranked, part.select("key", "room"), "b1", few))
    inner = join_small(ranked.drop("room"), e1, "key", F.col("id"), few=few).where("b1 = edge").drop("edge", "room")
    e2 = cut(_edge(inner, e1.select("key", "room"), "b2", few))
    tail = join_small(ranked.drop("room"), e2, "key", F.col("id"), few=few).where("b2 >= edge and size <= room")
    last = cut(_filled(tail.select("key", "id", "size", "v", "room")).withColumn("last", F.lit(1)), F.count("*").alias("n"))
    # rows before the edge are taken (where there is no edge, all that fit the room), and those that filled the rest
    marks = cut(goal.join(part.select("key", "factor", "open_size"), "key", "left").join(e2.select("key", "edge"), "key", "left"))
    release(bones, part, e1, e2)
    out = join_small(doc.drop("source"), marks, "key", F.col("id"), few=few)
    rows = last.measured["n"]
    out = out.join(F.broadcast(last) if rows <= SMALL_ROWS else last, ["key", "id", "size"], "left")
    early = (F.col("size") > 0) & (F.col("size") <= F.col("room")) & F.col("open_size").isNotNull()
    early &= F.col("edge").isNull() | (F.floor(v * BINS * BINS) < F.col("edge"))
    out = out.withColumn("copies", (F.col("base") + F.when(early | F.col("last").isNotNull(), 1).otherwise(0)).cast("int"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in OUT], *OUT)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", *OUT[:4])


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents as often as they are taken; those of no copy go."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mixed = pareto_mix(docs.select(row.alias("whole"), "doc_id", "text", "source"))
    return mixed.select(F.explode(F.array_repeat("whole", F.col("copies"))).alias("whole")).select("whole.*")


OP8_SQL = r"""
WITH RECURSIVE bones AS (SELECT doc_id, coalesce('=' || source, '') AS key, source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    sizes AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM bones GROUP BY ALL),
    w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 2.0::DOUBLE AS top FROM sizes),
    filled AS (SELECT *, top / weight AS ratio,
        coalesce(sum(top) OVER (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY top / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        sum(source_size) OVER () * 1.5::DOUBLE AS budget, row_number() OVER (ORDER BY top / weight, rank) AS pos FROM w),
    level AS (SELECT arg_min((budget - capped) / open, pos) AS level FROM filled WHERE (budget - capped) / open <= ratio),
    goal AS (SELECT key, source, source_size, least(top, weight * coalesce(level, 0)) AS target FROM filled, level),
    rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM goal),
    based AS (SELECT key, source_size, target, floor(r)::BIGINT AS base, target - floor(r) * source_size AS room FROM rated),
    -- candidates, and for each source the c of p = least(1, c * size) whose expected words are the room
    cand AS (SELECT b.key, doc_id, size, room FROM bones b JOIN based g ON b.key = g.key WHERE size > 0 AND room >= 1 AND size <= room),
    by_size AS (SELECT key, size, any_value(room) AS room, sum(size)::DOUBLE AS words, sum(size * size)::DOUBLE AS squares FROM cand GROUP BY ALL),
    tried AS (SELECT t.key, t.size, (any_value(t.room) - coalesce(sum(o.words) FILTER (o.size > t.size), 0)) / sum(o.squares) FILTER (o.size <= t.size) AS c
        FROM by_size t JOIN by_size o ON o.key = t.key GROUP BY t.key, t.size),
    chosen AS (SELECT key, arg_max(c, size) AS c, max(size) AS open_size FROM tried WHERE c * size < 1 GROUP BY key),
    odds AS (SELECT a.key, doc_id, size, room, CASE WHEN size > coalesce(open_size, 0) THEN 1 ELSE c * size END AS p,
        (('0x' || substr(md5(doc_id::VARCHAR || ':8'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
        FROM cand a LEFT JOIN chosen c ON c.key = a.key),
    pareto AS (SELECT *, CASE WHEN p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM odds),
    -- certain ones first, then by the ratio of odds
    ranked AS (SELECT key, doc_id, size, room, CASE WHEN q IS NULL THEN u / 2 ELSE 0.5::DOUBLE + q / (1 + q) / 2 END AS v, sum(size)::BIGINT AS words FROM pareto GROUP BY ALL),
    -- passes: what fits in order is taken, until nothing that is left fits
    pass AS (
        SELECT 1 AS n, key, doc_id, size, words, v, room, sum(words) OVER (PARTITION BY key ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING) <= room AS took FROM ranked
        UNION ALL
        SELECT n + 1, key, doc_id, size, words, v, rest, sum(words) OVER (PARTITION BY key ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest FROM (
            SELECT *, room - coalesce(sum(words) FILTER (took) OVER (PARTITION BY key), 0) AS rest FROM pass) WHERE NOT took AND words <= rest),
    hits AS (SELECT DISTINCT key, doc_id, size FROM pass WHERE took)
SELECT b.doc_id, b.size, g.source_size, g.target, ((g.base + (h.doc_id IS NOT NULL)::BIGINT) * b.size)::BIGINT AS taken
FROM bones b JOIN based g ON b.key = g.key LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.key = b.key AND h.size = b.size
"""
