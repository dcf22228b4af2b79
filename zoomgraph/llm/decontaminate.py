"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max WAND.

Every training passage is a query. Passages are windows of two strides of words, the stride no shorter
than the longest item, so that an item lies whole in one of them. An item's score is its BM25 score over
the score it has against itself, so one threshold serves all items. For all passages at once, the sums of
the terms' block maxima rule out the passages in which no block of items can reach the threshold; the rest
run block-max WAND item by item. What it retrieves is verified: the passage must share enough word trigrams
with the item's question and with its answer (the last sentence; of a single sentence, the last third)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_bytes
from .textkit import LOWER, PUNCTUATION, groups, mix, pieces, words

K1, B, BLOCK = 1.2, 0.75, 2
THRESHOLD, OVERLAP, LEAST_STRIDE = 0.6, 0.5, 32
#: Items of one index; more are searched part by part, with the statistics of all.
PART = 20_000
CELLS = 1 << 22
#: Bytes of items that are sent to the executors at once; a larger test set is searched share by share, with the
#: statistics of all.
SENT = 64 << 20


def _words(texts: list[str]):
    arr = pa.array(texts, pa.large_string())
    offs = np.frombuffer(arr.buffers()[1], np.int64)[: len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and len(arr.buffers()[2]) else np.zeros(0, np.uint8)
    return words(LOWER[data], offs, space=PUNCTUATION)


def trigrams(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of three words in a row; of fewer words, of the words."""
    if len(h) < 3:
        return np.unique(h)
    return np.unique(mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[2:]))))


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    at = [m.end() for m in re.finditer(r"[.!?]+\s+(?=\S)", text.rstrip())]
    if at:
        return text[: at[-1]], text[at[-1] :]
    w = text.split()
    k = max(1, len(w) - max(1, len(w) // 3)) if len(w) > 1 else len(w)
    return " ".join(w[:k]), " ".join(w[k:])


class Index:
    """Postings by term, with the greatest impact of each term and of each of its blocks of items."""

    def __init__(self, ids: list[int], texts: list[str], idf: dict[int, float], mean: float):
        self.ids = ids
        w = _words(texts)
        n, vocabulary = w.counts, np.unique(w.hash)
        term = np.searchsorted(vocabulary, w.hash)
        pair, tf = np.unique(term * len(ids) + w.doc(), return_counts=True)
        term, item = pair // max(1, len(ids)), pair % max(1, len(ids))
        weight = np.array([idf[int(h)] for h in vocabulary])
        impact = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / mean))
        own = np.bincount(item, impact, len(ids))
        impact = impact / own[item]
        self.vocabulary, self.item, self.impact = vocabulary, item, impact
        self.at = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.most = np.maximum.reduceat(impact, self.at[:-1]) if len(term) else impact
        blocks = item // BLOCK
        s, _ = groups(term * (len(ids) // BLOCK + 1) + blocks)
        self.block, self.block_most, block_term = blocks[s], (np.maximum.reduceat(impact, s) if len(s) else impact), term[s]
        self.block_at = np.searchsorted(block_term, np.arange(len(vocabulary) + 1))
        self.blocks = (len(ids) - 1) // BLOCK + 1 if ids else 0
        halves = [tuple(_words([p]).hash for p in parts_of(t)) for t in texts]
        self.lengths = [tuple(len(h) for h in x) for x in halves]
        self.grams = [tuple(trigrams(h) for h in x) for x in halves]

    def hopeful(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n passages with distinct (passage, term) rows, by passage, those that some block may satisfy."""
        out = np.zeros(n, bool)
        step = max(1, CELLS // max(1, self.blocks))
        for lo in range(0, n, step):
            a, b = np.searchsorted(passage, [lo, lo + step])
            t = term[a:b]
            size = self.block_at[t + 1] - self.block_at[t]
            at = np.repeat(self.block_at[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat(passage[a:b] - lo, size) * self.blocks + self.block[at]
            m = min(step, n - lo)
            out[lo : lo + m] = (np.bincount(cell, self.block_most[at], m * self.blocks).reshape(m, -1) >= THRESHOLD - 1e-9).any(1)
        return out

    def wand(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold: block-max WAND."""
        item, impact, end = self.item, self.impact, [int(self.at[t + 1]) for t in terms]
        at, most = [int(self.at[t]) for t in terms], [float(self.most[t]) for t in terms]
        live, out = list(range(len(terms))), []
        threshold -= 1e-9
        while live:
            live.sort(key=lambda c: item[at[c]])
            total, pivot = 0.0, -1
            for k, c in enumerate(live):
                total += most[c]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = int(item[at[live[pivot]]])
            while pivot + 1 < len(live) and item[at[live[pivot + 1]]] == d:
                pivot += 1
            block, bound = d // BLOCK, 0.0
            for c in live[: pivot + 1]:
                lo, hi = self.block_at[terms[c]], self.block_at[terms[c] + 1]
                k = lo + np.searchsorted(self.block[lo:hi], block)
                bound += float(self.block_most[k]) if k < hi and self.block[k] == block else 0.0
            if bound < threshold:  # no item of this block before the next list begins: on to the block's end
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    goal = min(goal, int(item[at[live[pivot + 1]]]))
                goal = max(goal, d + 1)
            elif item[at[live[0]]] == d:
                score = sum(float(impact[at[c]]) for c in live[: pivot + 1])
                if score >= threshold:
                    out.append((d, score))
                goal = d + 1
            else:
                goal = d
            for c in live[: pivot + 1]:
                if item[at[c]] < goal:
                    at[c] += int(np.searchsorted(item[at[c] : end[c]], goal))
            live = [c for c in live if at[c] < end[c]]
        return out


def _frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the hashes of distinct words, and how many texts have them."""
    w = _words(texts)
    h, df = np.unique(np.unique(np.stack([w.hash, w.doc().astype(np.uint64)], 1), axis=0)[:, 0], return_counts=True)
    return w.counts, h, df


def build(rows: list[tuple[int, str]], known: tuple[int, int, int, dict[int, int]] | None = None) -> tuple[list[Index], int]:
    """Indexes of all items with words, and the stride of passages. rows: (item_id, text). ``known``: number, words, longest
    and document frequencies of all items, where rows are only some of them."""
    rows = [r for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)) if r[1]]
    n, h, df = _frequencies([t for _, t in rows])
    rows = [r for r, k in zip(rows, n, strict=True) if k]
    if not rows:
        return [], LEAST_STRIDE
    items, total, longest, found = known or (len(rows), int(n.sum()), int(n.max()), dict(zip(h.tolist(), df.tolist(), strict=True)))
    df = np.array([found[x] for x in h.tolist()])
    idf = dict(zip(h.tolist(), np.log(1 + (items - df + 0.5) / (df + 0.5)).tolist(), strict=True))
    parts = [rows[i : i + PART] for i in range(0, len(rows), PART)]
    return [Index([i for i, _ in p], [t for _, t in p], idf, total / items) for p in parts], max(LEAST_STRIDE, longest)


SCHEMA = "doc_id long, item_id long, first_word long, score double, question double, answer double"


def _search(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, stride = sent.value
    for batch in batches:
        ids = batch.column(0).to_pylist()
        best: dict[tuple[int, int], tuple] = {}
        for lo, _, data, offs in pieces(batch.column(1)):
            w = words(LOWER[data], offs, space=PUNCTUATION)
            # strides of a document make one passage fewer, and at least one
            strides = -(-w.counts // stride)
            passages = np.maximum(strides - 1, np.minimum(strides, 1))
            base = np.r_[0, np.cumsum(passages)]
            doc = w.doc()
            nth = np.arange(len(doc)) - w.first[doc]
            for part in index:
                t = np.minimum(np.searchsorted(part.vocabulary, w.hash), len(part.vocabulary) - 1)
                known = np.flatnonzero(part.vocabulary[t] == w.hash)
                q, d = nth[known] // stride, doc[known]
                left, right = q >= 1, q < passages[d]
                key = np.unique(np.concatenate([(base[d] + q - 1)[left] * len(part.vocabulary) + t[known][left], (base[d] + q)[right] * len(part.vocabulary) + t[known][right]]))
                passage, term = key // len(part.vocabulary), key % len(part.vocabulary)
                for p in np.flatnonzero(part.hopeful(passage, term, int(base[-1]))):
                    a, b = np.searchsorted(passage, [p, p + 1])
                    found = part.wand(term[a:b])
                    if not found:
                        continue
                    d = int(np.searchsorted(base, p, "right") - 1)
                    first = int(p - base[d]) * stride
                    own = w.hash[w.first[d] + first : min(w.first[d + 1], w.first[d] + first + 2 * stride)]
                    grams = {3: trigrams(own), 1: np.unique(own)}
                    for k, score in found:
                        share = []
                        for g, text in zip(part.grams[k], part.lengths[k], strict=True):
                            share.append(float(np.isin(g, grams[3 if text >= 3 else 1]).mean()) if len(g) else 1.0)
                        if min(share) >= OVERLAP:
                            row = (round(score, 6), -first, round(share[0], 6), round(share[1], 6))
                            key_ = (lo + d, part.ids[k])
                            best[key_] = max(best.get(key_, row), row)
        rows = [(ids[j], i, -f, s, q, a) for (j, i), (s, f, q, a) in best.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], ["doc_id", "item_id", "first_word", "score", "question", "answer"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, score, question, answer): every item that a document's passages hold.

    One row for each row of docs and item, with the best of its passages. Words are runs of letters and
    digits, A-Z lowered. Null and empty texts and items without words match nothing; an item of fewer words
    than three in a part is compared by words. Null ids are kept; repeated items are reported each. The
    items are sent to the executors, at most about SENT bytes at once: a larger test set is searched share by share.
    The texts are searched where they are read, without shuffle."""
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")

    def search(built):
        sent = docs.sparkSession.sparkContext.broadcast(built)
        return texts.mapInArrow(lambda b: _search(sent, b), SCHEMA), sent

    shares = -(-text_bytes(items) // SENT)
    if shares <= 1:
        return search(build([tuple(r) for r in items.collect()]))[0]
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)).cast("int")
    stats = cut(items.where("text is not null").select(share.alias("share"), "text").mapInArrow(_stats, "share int, h long, df long, items long, words long, longest long"))
    every = stats.where("h is null").agg(F.sum("items"), F.sum("words"), F.max("longest")).first()
    df = stats.where("h is not null").groupBy("h").agg(F.sum("df").alias("df"))
    out = []
    for i in range(shares):
        mine = stats.where((F.col("share") == i) & F.col("h").isNotNull()).select("h").distinct().join(df, "h").collect()
        rows = [tuple(r) for r in items.where(share == i).collect()]
        found, sent = search(build(rows, (*every, {r["h"] % 2**64: r["df"] for r in mine})))
        out.append(cut(found))
        sent.destroy()
    return reduce(DataFrame.union, out)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the words of each share's items in a batch, and a row of counts."""
    for b in batches:
        share, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        for i in np.unique(share):
            n, h, df = _frequencies([t for t, s in zip(texts, share, strict=True) if s == i])
            k = len(h)
            nones = [None] * k
            cols = ([i] * (k + 1), [*h.view(np.int64).tolist(), None], [*df.tolist(), None], [*nones, int((n > 0).sum())], [*nones, int(n.sum())], [*nones, int(n.max(initial=0))])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 5), strict=True)], ["share", "h", "df", "items", "words", "longest"])


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; a row without id goes if any such row holds one."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__id"]), "left_anti")
