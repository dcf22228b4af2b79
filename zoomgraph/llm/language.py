"""Language identification of code-switched text with a linear-chain conditional random field.

Every word is labelled: its affixes, its character trigrams and the word itself (the learned lexicon) give
a score for each language, learned transitions tie neighbours together, and forward-backward gives each
word's posterior. A document's language is the one with the largest expected share of its words.

The field is trained, in one task, on a bounded sample: at most about ``per_lang`` documents of each language, of a
short text all words, of a longer one SEGMENTS segments from all over it, two segments of any languages to a
sequence, so that changes of language are seen. Every language with such a document is learned. All else reads
whole texts; long ones are cut into blocks whose transfer matrices are multiplied, so that they need no more
steps than short ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, table, without
from .textkit import LOWER, mix, pieces, spans_hash, words

FEATURES = 1 << 16
SEGMENT, SEGMENTS, BLOCK = 16, 4, 128
ACCEPT = 0.4


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of lower-cased words: prefixes of 1 to 3 bytes, suffixes of 1 to 4, trigrams, the word."""
    size = end - start
    idx, s, e, kind = [], [], [], []

    def add(which, a, b, k):
        idx.append(which)
        s.append(a)
        e.append(b)
        kind.append(np.full(len(which), k, np.uint64))

    every = np.arange(len(start))
    add(every, start, end, 0)
    for n in (1, 2, 3):
        w = every[size > n]
        add(w, start[w], start[w] + n, n)
    for n in (1, 2, 3, 4):
        w = every[size > n]
        add(w, end[w] - n, end[w], 4 + n)
    grams = np.maximum(size - 2, 0)
    w = np.repeat(every, grams)
    at = start[w] + np.arange(len(w)) - np.repeat(np.cumsum(grams) - grams, grams)
    add(w, at, at + 3, 9)
    h = spans_hash(data, np.concatenate(s), np.concatenate(e))
    return np.concatenate(idx), (mix(h ^ (np.concatenate(kind) << np.uint64(56))) % np.uint64(FEATURES)).astype(np.int64)


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray):
    """Bytes, starts and ends of the distinct words, and for each word its place among them."""
    _, one, place = np.unique(h, return_index=True, return_inverse=True)
    s, size = start[one], (end - start)[one]
    to = np.cumsum(size) - size
    return data[np.repeat(s - to, size) + np.arange(size.sum())], to, to + size, place


def scores(weights: np.ndarray, idx: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(idx, weights[feat, k], n) for k in range(weights.shape[1])], 1)


def posteriors(em: np.ndarray, tr: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences (n, t, labels), valid up to their ends: the labels' probabilities at each place, and of each pair of
    labels from each place to the next."""
    k, t_len = em.shape[2], em.shape[1]
    alpha, beta = np.empty_like(em), np.ones_like(em)
    alpha[:, 0] = (np.full((1, k), 1 / k) @ tr) * em[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, t_len):
        alpha[:, t] = (alpha[:, t - 1] @ tr) * em[:, t]
        alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
    for t in range(t_len - 2, -1, -1):
        x = (em[:, t + 1] * beta[:, t + 1]) @ tr.T
        beta[:, t] = np.where(valid[:, t + 1, None], x / x.sum(1, keepdims=True), 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * tr * (em * beta)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return post * valid[:, :, None], pair * valid[:, 1:, None, None]


def train(rows: list[tuple[str, str]], labels: list[str], seed: int = 3, epochs: int = 4, rate: float = 0.3) -> dict:
    """Weights of features and transitions by stochastic gradient ascent of the conditional likelihood.

    rows: (language, segment). A sequence is two segments; shorter ones are padded."""
    k = len(labels)
    arr = pa.array([t for _, t in rows], pa.string())
    offs = np.frombuffer(arr.buffers()[1], np.int32)[: len(arr) + 1].astype(np.int64)
    data = LOWER[np.frombuffer(arr.buffers()[2], np.uint8)] if rows else np.zeros(0, np.uint8)
    w = words(data, offs)
    some = np.flatnonzero(w.counts > 0)
    number = {lang: i for i, lang in enumerate(labels)}
    y, first, size = np.array([number[lang] for lang, _ in rows], int)[some], w.first[some], w.counts[some]
    buf, s, e, place = distinct_words(data, w.start, w.end, w.hash)
    idx, feat = features(buf, s, e)
    order = np.argsort(idx, kind="stable")
    idx, feat = idx[order], feat[order]
    bounds = np.searchsorted(idx, np.arange(len(s) + 1))
    weights, trans = np.zeros((FEATURES, k)), np.zeros((k, k))
    gw, gt = np.full((FEATURES, k), 1e-2), np.full((k, k), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        p = rng.permutation(len(some))
        p = np.r_[p, p[: len(p) % 2]].reshape(-1, 2)
        for batch in np.array_split(p, max(1, len(p) // 64)):
            if not len(batch):
                continue
            one, both = size[batch[:, 0], None], size[batch].sum(1, keepdims=True)
            t = np.arange(int(both.max()))
            valid, left = t < both, t < one
            at = np.where(left, first[batch[:, 0], None] + t, first[batch[:, 1], None] + t - one)
            x = place[np.where(valid, at, first[batch[:, 0], None])]
            gold = np.where(left, y[batch[:, 0], None], y[batch[:, 1], None])
            uniq, at = np.unique(x, return_inverse=True)
            at = at.reshape(x.shape)
            n = bounds[uniq + 1] - bounds[uniq]
            fi = feat[np.repeat(bounds[uniq] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            ui = np.repeat(np.arange(len(uniq)), n)
            em = np.exp(np.clip(scores(weights, ui, fi, len(uniq)), -30, 30))[at]
            post, pair = posteriors(em, np.exp(trans), valid)
            err = np.eye(k)[gold] * valid[:, :, None] - post
            dt = -pair.sum((0, 1))
            np.add.at(dt, (gold[:, :-1][valid[:, 1:]], gold[:, 1:][valid[:, 1:]]), 1)
            du = np.stack([np.bincount(at.ravel(), err[:, :, c].ravel(), len(uniq)) for c in range(k)], 1)
            touched, inv = np.unique(fi, return_inverse=True)
            dw = np.stack([np.bincount(inv, du[ui, c], len(touched)) for c in range(k)], 1) - 1e-3 * weights[touched]
            gw[touched] += dw**2
            weights[touched] += rate * dw / np.sqrt(gw[touched])
            gt += dt**2
            trans += rate * dt / np.sqrt(gt)
    return {"labels": labels, "weights": weights.astype(np.float32), "trans": trans}


def shares(em: np.ndarray, first: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Expected number of words of each label in each document, by forward-backward.

    em: exp of the words' scores; first: where documents begin. Blocks of words advance together: first as
    matrices from every entry label, then from the entry that the blocks before (and after) them give."""
    k = em.shape[1]
    size = np.diff(first)
    per = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = first[doc] + nth * BLOCK
    n = np.minimum(BLOCK, first[doc + 1] - start)
    out = np.zeros((len(size), k))
    if not len(doc):
        return out
    order = np.argsort(-n, kind="stable")
    back = np.argsort(order, kind="stable")
    s, m = start[order], n[order]
    active = np.searchsorted(-m, -np.arange(1, m[0] + 1), "right")
    a = np.tile(np.eye(k), (len(s), 1, 1))
    for t in range(m[0]):
        c = active[t]
        x = (a[:c] @ tr) * em[s[:c] + t][:, None, :]
        a[:c] = x / x.sum((1, 2), keepdims=True)
    block = a[back]
    enter, leave = np.full((len(doc), k), 1 / k), np.full((len(doc), k), 1 / k)
    head = np.cumsum(per) - per
    for j in range(1, int(per.max())):
        b = head[per > j] + j
        v = np.einsum("bk,bkl->bl", enter[b - 1], block[b - 1])
        enter[b] = v / v.sum(1, keepdims=True)
        b = head[per > j] + per[per > j] - 1 - j
        u = np.einsum("bkl,bl->bk", block[b + 1], leave[b + 1])
        leave[b] = u / u.sum(1, keepdims=True)
    alpha = np.empty((m[0], len(s), k))
    v = enter[order]
    for t in range(m[0]):
        c = active[t]
        x = (v[:c] @ tr) * em[s[:c] + t]
        v[:c] = x / x.sum(1, keepdims=True)
        alpha[t, :c] = v[:c]
    u, total = leave[order], np.zeros((len(s), k))
    for t in range(m[0] - 1, -1, -1):
        c = active[t]
        p = alpha[t, :c] * u[:c]
        total[:c] += p / p.sum(1, keepdims=True)
        x = (em[s[:c] + t] * u[:c]) @ tr.T
        u[:c] = x / x.sum(1, keepdims=True)
    np.add.at(out, doc[order], total)
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a short text; of a longer one, a segment from each of SEGMENTS parts of it, where its id says."""
    for batch in batches:
        lang, out = [], []
        for i, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = (text or "").split()
            n = min(SEGMENTS, len(w) // SEGMENT)
            for k in range(max(1, n)):
                lo, hi = k * len(w) // max(1, n), (k + 1) * len(w) // max(1, n)
                at = lo + int(mix(np.array([i * 7 + k], np.int64).view(np.uint64))[0] % np.uint64(max(1, hi - lo - SEGMENT + 1)))
                lang.append(name)
                out.append(" ".join(w[at : at + SEGMENT]))
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.string())], ["lang", "text"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[1])
    model = train(rows, sorted({lang for lang, _ in rows}))
    yield pa.RecordBatch.from_arrays([pa.array([model["labels"]], pa.list_(pa.string())), pa.array([model["weights"].tobytes()], pa.binary()), pa.array([model["trans"].tobytes()], pa.binary())], ["labels", "weights", "trans"])


def _predict(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = sent.value
    labels, tr = model["labels"], np.exp(model["trans"])
    for batch in batches:
        text, pred, score = batch.column(1), [], []
        for lo, hi, data, offs in pieces(text):
            low = LOWER[data]
            w = words(low, offs)
            got = np.zeros((hi - lo, max(1, len(labels))))
            if labels and len(w.hash):
                buf, s, e, place = distinct_words(low, w.start, w.end, w.hash)
                em = np.exp(np.clip(scores(model["weights"], *features(buf, s, e), len(s)), -30, 30))[place]
                got = shares(em, w.first, tr)
            plain = np.r_[0, np.cumsum((low >= 97) & (low <= 122))]
            ascii_letters = plain[offs[1:]] - plain[offs[:-1]]
            for j in range(hi - lo):
                known = labels and (ascii_letters[j] or any(c.isalpha() for c in text[lo + j].as_py() or ""))
                best = int(got[j].argmax())
                total = got[j].sum()
                pred.append(labels[best] if known else "und")
                score.append(float(min(1.0, got[j][best] / total)) if known and total else 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def held_out(n: int, r: int, doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves r; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n == r, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 500) -> dict:
    """Train on documents that are not held out and have a language; docs: doc_id, lang, text."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(3, 1))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = join_small(known, counts, "lang", F.col("doc_id")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < F.lit(per_lang) / F.col("n"))
    found = drawn.select("doc_id", "lang", "text").mapInArrow(_segments, "lang string, text string").repartition(1).mapInArrow(_trained, "labels array<string>, weights binary, trans binary").collect()
    if not found or not found[0]["labels"]:
        return {"labels": [], "weights": np.zeros((FEATURES, 0), np.float32), "trans": np.zeros((0, 0))}
    r = found[0]
    k = len(r["labels"])
    return {"labels": list(r["labels"]), "weights": np.frombuffer(r["weights"], np.float32).reshape(FEATURES, k), "trans": np.frombuffer(r["trans"]).reshape(k, k)}


def identify(docs: DataFrame, **sample) -> DataFrame:
    """docs with held_out, lang_pred and score (the language's share of the words); columns of docs with these names go.

    A text that is null or without a letter is ``und`` with score 0, and so is every text where nothing can
    be learned. A null id is not held out and not learned from; repeated rows are judged alike. Without
    shuffle: texts are labelled where they are read."""
    d = without(docs, "held_out", "lang_pred", "score")
    model = fit(docs.select("doc_id", "lang", "text"), **sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    first = ["doc_id", "text", *[c for c in d.columns if c not in ("doc_id", "text")]]
    named = d.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(first)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema) + ", lang_pred string, score double"
    out = named.mapInArrow(lambda b: _predict(sent, b), schema)
    place = {c: f"c{i}" for i, c in enumerate(first)}
    return out.select(*[F.col(place[c]).alias(c) for c in d.columns], held_out(3, 1, "c0").alias("held_out"), "lang_pred", "score")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language has a fair share of the words, go."""
    return identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= ACCEPT)).select(*docs.columns)
