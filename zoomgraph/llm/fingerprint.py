"""I-Match fingerprints with several randomised lexicons.

Document frequencies over the whole corpus give each term's inverse document frequency. Terms within the
band form the lexicon; random parts of it, down to small ones, are the further lexicons. A document's
terms in each lexicon are made distinct, sorted and hashed; the hashes together are its fingerprint.

The whole band is the lexicon. As each of its terms is in a share ``least`` of the documents, it has at most
1 / ``least`` times as many terms as a document has on average, at any size of the corpus, and is a constant
of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Least slots of each half of the lexicon's hash table; families of random lexicons and, in each, the shares
#: of the full lexicon (of 64) that are nested in it. A family looks at bits of its own in a term's code.
SLOTS, FAMILIES, SHARES = 2**14, 4, (32, 8, 2)
LOW = -(2**63)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats included."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def codes(text: Column) -> Column:
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def lexicon(texts: DataFrame, most: float = 0.02, least: float = 0.002) -> tuple[Column, Column]:
    """The terms whose document frequency is at least ``least`` and at most ``most`` of all documents.

    It comes as a constant two-choice hash table of the terms' 64-bit codes. On small corpora a term
    counts from two documents on."""
    n = texts.count()
    df = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(2, least * n)) & (F.col("df") <= max(2, most * n)) & (F.col("t") != ""))
    top = band.select(F.xxhash64("t").alias("code")).collect()
    return _table(sorted({r["code"] for r in top}))


def _places(code: int, slots: int) -> tuple[int, int]:
    return code % slots, (code >> 20) % slots


def _halves(found: list[int], slots: int) -> tuple[dict, dict] | None:
    """Each code is in the first half at its first place or in the second half at its second place.

    None where a code finds no place after many moves."""
    half: tuple[dict, dict] = ({}, {})
    for code in found:
        side = 0
        for _ in range(200):
            at = _places(code, slots)[side]
            code, half[side][at] = half[side].get(at), code
            if code is None:
                break
            side = 1 - side
        else:
            return None
    return half


def _table(found: list[int]) -> tuple[Column, Column]:
    """The halves of a table with twice as many slots, or more, as there are codes, in which all have a place."""
    slots = SLOTS
    while slots < 2 * len(found) or not (half := _halves(found, slots)):
        slots *= 2
    text = [" ".join(str(h.get(i, 0)) for i in range(slots)) for h in half]
    return tuple(F.split(F.lit(t), " ").cast("array<bigint>") for t in text)


def _known(words: tuple[Column, Column]):
    a, b = words
    mask = (F.size(a) - 1).cast("long")
    return lambda h: (F.element_at(a, (h.bitwiseAND(mask) + 1).cast("int")) == h) | (F.element_at(b, (F.shiftright(h, 20).bitwiseAND(mask) + 1).cast("int")) == h)


def _drawn(family: int, share: int):
    return lambda h: F.shiftright(h, 34 + 6 * family).bitwiseAND(F.lit(63).cast("long")) < share


def fingerprints(df: DataFrame, text: str, out: str, words: tuple[Column, Column]) -> DataFrame:
    """df with ``out``, an array of one hash (0: no term) for the lexicon and one for each random lexicon.

    Terms are sorted by their codes. A document without a term of the lexicon is told by all its distinct
    terms, one without any by its text."""
    hashed = lambda a: F.when(F.size(a) > 0, F.xxhash64(a)).otherwise(F.lit(0).cast("long"))
    kept = [c for c in df.columns if c != out]
    df = df.select(*kept, F.array_sort(F.array_distinct(F.filter(codes(F.col(text)), _known(words)))).alias("__t"))
    every = F.array_sort(F.array_distinct(F.transform(F.filter(terms(F.col(text)), lambda t: t != ""), lambda t: F.xxhash64(t))))
    df = df.select(*kept, F.when(F.size("__t") > 0, F.col("__t")).otherwise(every).alias("__t"))
    df = df.select(*kept, F.when(F.size("__t") > 0, F.col("__t")).otherwise(F.array(F.xxhash64(F.concat(F.lit("="), F.col(text))))).alias("__t"))
    df = df.select(*kept, F.col("__t"), hashed(F.col("__t")).alias("__full"))
    hashes = ["__full"]
    prev = ["__t"] * FAMILIES
    for share in SHARES:  # each level filters the one before it, in a projection of its own
        new = [f"__s{k}_{share}" for k in range(FAMILIES)]
        held = [F.filter(F.col(p), _drawn(k, share)).alias(n) for k, (p, n) in enumerate(zip(prev, new, strict=True))]
        df = df.select(*kept, *hashes, *held)
        df = df.select(*kept, *hashes, *new, *[hashed(F.col(n)).alias("__h" + n) for n in new])
        hashes, prev = hashes + ["__h" + n for n in new], new
    return df.select(*kept, F.array(*[F.col(h) for h in hashes]).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The share of lexicons with terms in either text in which both have the same hash."""
    z = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None).cast("int")).otherwise((x == y).cast("int")))
    z = F.filter(z, lambda x: x.isNotNull())
    return F.coalesce(F.aggregate(z, F.lit(0), lambda s, x: s + x).cast("double") / F.size(z), F.lit(0.0))


def shown(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "-")


def following(docs: DataFrame, parts: int = 64) -> DataFrame:
    """(doc_id, n_chars, next_id): the next larger id, after the last the first. 

    Ids are ranged over tasks; the gap between two ranges is closed with a table of one row a range."""
    ids = docs.select("doc_id", F.char_length("text").alias("n_chars"))
    ids = ids.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    ranged = cut(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()))
    starts = ranged.groupBy("part").agg(F.min("doc_id").alias("start"))
    order = Window.orderBy("part")
    starts = starts.select("part", F.coalesce(F.lead("start").over(order), F.first("start").over(order)).alias("after"))
    lead = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("next_id", lead).join(F.broadcast(starts), "part").select("doc_id", "n_chars", F.coalesce("next_id", "after").alias("next_id"))


def imatch(docs: DataFrame, **band) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text replaces the last quarter of the characters by the first as many of the next document.
    Null texts count as empty; a row without doc_id has no next document and is not edited; where an id
    is repeated, the one with the least text is the next document of others. Empty input gives an empty
    result. Columns of docs other than doc_id and text are not carried."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(texts, **band)
    pairs = cut(following(texts.where(F.col("doc_id") != LOW)))
    own = cut(fingerprints(texts, "text", "fp", words).select("doc_id", F.xxhash64("text").alias("__h"), "fp"))
    # the first characters of the next text, and its fingerprint, go to the document before it
    prev = pairs.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.floor(F.col("n_chars") / 4).cast("int").alias("k"))
    heads = texts.join(prev, "doc_id").select(F.col("prev_id").alias("doc_id"), F.expr("substring(text, 1, k)").alias("head")).groupBy("doc_id").agg(F.min("head").alias("head"))
    next_fp = own.join(prev, "doc_id").select(F.col("prev_id").alias("doc_id"), F.col("fp").alias("next_fp")).groupBy("doc_id").agg(F.min("next_fp").alias("next_fp"))
    small = own.distinct().join(next_fp, "doc_id", "left")
    # both joins read one exchange of the texts, so nothing is added to them before it
    full = texts.join(heads, "doc_id", "left").withColumn("__h", F.xxhash64("text")).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("k", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - k)"), F.expr("substring(head, 1, k)"))
    full = full.select("doc_id", "__h", "n_chars", F.when(F.col("head").isNull(), F.col("text")).otherwise(edited).alias("edited"))
    full = fingerprints(full.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)), "edited", "edited_fp", words).drop("edited")
    full = full.join(small, ["doc_id", "__h"])
    return full.select(F.nullif("doc_id", F.lit(LOW)).alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), F.coalesce(likeness(F.col("fp"), F.col("next_fp")), F.lit(0.0)).alias("near_next"))


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents").select("doc_id", "text"))
