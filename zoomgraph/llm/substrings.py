"""Removal of repeated token windows by Rabin-Karp hashes.

Every window of 13 words of every document is hashed. Tasks first reduce their windows to one row a hash
(its smallest document); the hashes then meet in hash buckets, as packed columns, where every document but
the smallest is told which of its windows are repeated. Overlapping repeated windows merge into maximal
removal intervals. The bucket's bits beyond its first byte come from a second hash, so sequences are told
apart by 56 bits and the bucket's own, of which there are about N / 2^21 for N windows: about N / 2^36 of the
windows are mistaken for others, whatever their number. At most 2^30 buckets are made."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_bytes
from .textkit import SECOND, bucket_bits, groups, mix, pack7, pieces, unpack7, windows, words

LOW = -(2**63)
#: Windows that a task gathers before it reduces them.
FLUSH = 1 << 20
PACKED = "bucket int, known boolean, ids binary, counts binary, hashes binary"
NAMES = ["bucket", "known", "ids", "counts", "hashes"]


def _blob(doc: np.ndarray, h: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rows by document: the ids, how many hashes each has, the hashes."""
    order = np.argsort(doc, kind="stable")
    doc, h = doc[order], h[order]
    s, e = groups(doc)
    return doc[s].tobytes(), (e - s).astype(np.uint32).tobytes(), pack7(h)


def _open(ids: bytes, counts: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32)), unpack7(hashes)


def _reduce(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of each hash's smallest document, and those of the larger documents, by hash."""
    order = np.lexsort((doc, h))
    s, e = groups(h[order])
    least = np.repeat(doc[order[s]], e - s)
    return order[s], order[doc[order] > least]


def _bucket(h: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bucket: its low byte is the top byte of the hash, which ``pack7`` leaves out; the rest is of the second hash."""
    low = (h >> np.uint64(56)).astype(np.int32)
    return low if bits == 8 else low | ((second >> np.uint64(72 - bits)).astype(np.int32) << 8)


def _scatter(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            h, doc, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            for known, at in zip((False, True), _reduce(h, doc), strict=True):
                at = at[np.argsort(bucket[at], kind="stable")]
                b, hh, dd = bucket[at], h[at], doc[at]
                for s, e in zip(*groups(b), strict=True):
                    rows.append((int(b[s]), known, *_blob(dd[s:e], hh[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], NAMES)

        for batch in batches:
            ids = batch.column(0).fill_null(LOW).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in pieces(batch.column(1)):
                w = words(data, offs)
                at, h = windows(w.hash, w.first, k)
                if len(at):
                    second = windows(w.hash, w.first, k, SECOND)[1] if bits > 8 else h
                    held.append((h, ids[lo:hi][np.searchsorted(w.first, at, "right") - 1], _bucket(h, second, bits)))
                    n += len(at)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _gather(groups_: int):
    """Of one bucket: the repeated windows of every document but the smallest, by groups of documents."""

    def run(t: pa.Table) -> pa.Table:
        rows = [(*_open(i, c, h), k) for i, c, h, k in zip(*(t.column(n).to_pylist() for n in ("ids", "counts", "hashes", "known")), strict=True)]
        out = []
        new = [r for r in rows if not r[2]]
        parts = [(r[0], r[1]) for r in rows if r[2]]
        if new:
            h, doc = np.concatenate([r[1] for r in new]), np.concatenate([r[0] for r in new])
            _, more = _reduce(h, doc)
            parts.append((doc[more], h[more]))
        doc, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        g = doc_group(doc, groups_)
        order = np.argsort(g, kind="stable")
        g, doc, h = g[order], doc[order], h[order]
        for s, e in zip(*groups(g), strict=True):
            out.append((int(g[s]), t.column("bucket")[0].as_py(), *_blob(doc[s:e], h[s:e])))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, ty) for c, ty in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["grp", "bucket", "ids", "counts", "hashes"])

    return run


def doc_group(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def _apply(k: int, text: bool):
    """Texts of one group of documents and their repeated windows -> what stays of each text."""

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        doc, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for b, i, c, x in zip(*(flags.column(n).to_pylist() for n in ("bucket", "ids", "counts", "hashes")), strict=True):
            d, y = _open(i, c, x)
            doc.append(d)
            h.append(y | (np.uint64(b & 255) << np.uint64(56)))
        doc, h = np.concatenate(doc), np.concatenate(h)
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        ids = texts.column("doc_id").fill_null(LOW).to_numpy()
        n_words, n_removed, kept, sha = [], [], [], []
        for lo, hi, data, offs in pieces(texts.column("text")):
            w = words(data, offs)
            at, wh = windows(w.hash, w.first, k)
            bound = np.searchsorted(at, w.first)
            for j in range(hi - lo):
                a, b = w.first[j], w.first[j + 1]
                s, e = np.searchsorted(doc, ids[lo + j], "left"), np.searchsorted(doc, ids[lo + j], "right")
                keep = np.ones(b - a, bool)
                if e > s:
                    hit = at[bound[j] : bound[j + 1]][np.isin(wh[bound[j] : bound[j + 1]], h[s:e])] - a
                    delta = np.zeros(b - a + 1, np.int64)
                    np.add.at(delta, hit, 1)
                    np.add.at(delta, hit + k, -1)
                    keep = np.cumsum(delta)[:-1] == 0  # windows that overlap or touch make one interval
                raw = data[offs[j] : offs[j + 1]].tobytes()
                out = b" ".join(raw.split()) if keep.all() else b" ".join([x for x, y in zip(raw.split(), keep.tolist(), strict=True) if y])
                n_words.append(int(b - a))
                n_removed.append(int((~keep).sum()))
                kept.append(out.decode() if text else "")
                sha.append(hashlib.sha256(out).hexdigest())
        out = pa.table([texts.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
        return out if text else out.drop_columns(["kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text if ``text``, kept_sha256): words in no window that starts in a smaller document.

    Words are runs without ASCII white space. A null or blank text has no words and keeps the empty text.
    A null doc_id counts as smaller than all others; rows that repeat an id are judged alike and not
    against each other. Empty input gives an empty result; further columns are not carried."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = bucket_bits(text_bytes(texts) // 6, 1 << 21)  # about six bytes a word
    n = 2**bits
    sent = texts.mapInArrow(_scatter(window, bits), PACKED)
    flags = sent.groupBy("bucket").applyInArrow(_gather(n), "grp int, bucket int, ids binary, counts binary, hashes binary")
    keyed = texts.mapInArrow(_with_group(n), "grp int, doc_id long, text string")
    schema = f"doc_id long, n_words long, n_removed long, {'kept_text string, ' * text}kept_sha256 string"
    return keyed.groupBy("grp").cogroup(flags.groupBy("grp")).applyInArrow(_apply(window, text), schema)


def _with_group(n: int):
    def run(batches):
        for b in batches:
            ids = b.column(0).fill_null(LOW).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(doc_group(ids, n)), b.column(0), b.column(1)], ["grp", "doc_id", "text"])

    return run


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), text=False)


OP6_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
    w AS (SELECT doc_id, i, w[i] AS w, len(w) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM split)),
    win AS (SELECT doc_id, i, w, n, CASE WHEN i + 12 <= n THEN array_to_string(list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), ' ') END AS s FROM w),
    least AS (SELECT s, min(doc_id) AS least FROM win WHERE s IS NOT NULL GROUP BY s),
    hit AS (SELECT win.doc_id, i, w, coalesce(least < win.doc_id, false) AS hit FROM win LEFT JOIN least ON least.s = win.s),
    cover AS (SELECT doc_id, i, w, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hit),
    kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM cover GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
