"""Language-model scores of whole documents: a gated recurrent network with class-factored output.

1. Words of all training documents are counted in hash buckets; the most frequent (a bounded list) are sent
   to the tasks, all others are looked up by shuffle.
2. Each task trains the network from common weights on its training documents, each whole and to its end token, the
   state carried along; the weights are averaged. ROUNDS times, each with another part of the documents, so every
   training word is learned from once.
3. Every document is scored to its end with its state carried along. Words without an output of their own
   share P(rest), dealt by (count + 0.1): the score is a proper log probability of the text.
4. For words beyond the frequent list, documents send hashes to the buckets and get back sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent as net
from .common import cut, table, text_bytes
from .language import held_out
from .textkit import bucket_bits, groups, mix, pack7, pieces, unpack7, words

LOW = -(2**63)
#: Longest list of frequent words that is sent to tasks; words that a task gathers before it reduces them.
FREQUENT, FLUSH = 1 << 18, 1 << 21
#: Averages of the weights; words of a task in one round at least, if there are as many; words that a task feeds to its
#: lanes at once; the most lanes, and the words for which there is one.
ROUNDS, TASK, FEED, LANES, LANE = 2, 1 << 21, 1 << 21, 512, 4096
#: The hash of the end token, which no word has but by chance.
END = np.uint64(0x9D3C1F2B5A7E4C11)


def _docs(batch: pa.RecordBatch):
    """(first row, ids, training flags, hashes with an end token after each document, first) by piece."""
    ids = batch.column(0).fill_null(LOW).to_numpy(zero_copy_only=False)
    train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
    for lo, hi, data, offs in pieces(batch.column(1)):
        w = words(data, offs, lower=True)
        first = w.first + np.arange(len(w.first))
        h = np.empty(first[-1], np.uint64)
        ends = first[1:] - 1
        h[ends] = END
        keep = np.ones(len(h), bool)
        keep[ends] = False
        h[keep] = w.hash
        yield lo, ids[lo:hi], train[lo:hi], h, first


def _count(bits: int):
    """Packed (hash, count) of training words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            b = (h >> np.uint64(64 - bits)).astype(np.int32)
            rows = [(int(b[s]), pack7(h[s:e]), c[s:e].astype(np.int64).tobytes()) for s, e in zip(*groups(b), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "grams", "counts"])

        n = 0
        for batch in batches:
            for _, _, train, h, first in _docs(batch):
                h = h[np.repeat(train, np.diff(first))]
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _merge(bits: int):
    """One bucket's words and counts, packed again; and its sums and most frequent words."""

    def run(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        h = np.concatenate([unpack7(x) for x in t.column("grams").to_pylist()])
        c = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()])
        h = (h & np.uint64(2 ** (64 - bits) - 1)) | (np.uint64(b) << np.uint64(64 - bits))
        h, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, c).astype(np.int64)
        top = np.lexsort((h, -c))[: FREQUENT >> max(0, bits - 2)]  # four times an even share; what is cut off is looked up by shuffle
        return pa.table({"bucket": pa.array([b], pa.int32()), "grams": [pack7(h)], "counts": [c.tobytes()], "top": [h[top].tobytes()], "top_c": [c[top].tobytes()], "n": pa.array([int(c.sum())]), "v": pa.array([len(h)])})

    return run


def _slots(known: np.ndarray) -> np.ndarray:
    """Where the words of each value of the top bits begin in the sorted list: at least twice as many slots as words."""
    bits = len(known).bit_length() + 1
    return np.searchsorted(known, np.arange(2**bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)


def _ids(model: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the network's vocabulary (REST beyond it) and in the sorted frequent list (or -1)."""
    known, slots = model["sorted"], model["slots"]
    at = slots[h >> np.uint64(65 - len(slots).bit_length())]
    end = len(known) - 1
    np.minimum(at, end, out=at)
    less = np.flatnonzero(known[at] < h)
    while len(less):  # on to the next word of the slot, until it is not less
        at[less] += 1
        less = less[at[less] <= end]
        less = less[known[at[less]] < h[less]]
    np.minimum(at, end, out=at)
    hit = known[at] == h
    rank = np.where(hit, model["rank"][at], net.REST)
    return np.minimum(rank, net.REST), np.where(hit, at, -1)


#: Numbers of the weights in one row of a task.
CHUNK = 1024


def _train(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, trainer, held, size, n = sent.value, None, [], 0, 0

        def feed(last: bool):
            nonlocal trainer, held, size
            if trainer is None:
                trainer = net.Trainer(model["net"], model["end"], min(LANES, max(8, size // LANE)))
            trainer.learn(held, last)
            held, size = [], 0

        for batch in batches:
            for _, _, _, h, first in _docs(batch):
                w = _ids(model, h)[0].astype(np.int16)
                held += [w[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                size += len(w)
                n += len(w)
                if size >= FEED:
                    feed(False)
        if not n:
            return
        feed(True)
        flat = np.concatenate([trainer.p[k].ravel() for k in net.NAMES])
        parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([q.tobytes() for q in parts], pa.binary()), pa.array([float(n)] * len(parts))], ["chunk", "weights", "n"])

    return run


def _mean(t: pa.Table) -> pa.Table:
    """Weighted mean of one chunk of the weights over some of the tasks; integers of 2^-40 sum alike in any order."""
    total, n = 0, 0.0
    for w, k in zip(t.column("weights").to_pylist(), t.column("n").to_pylist(), strict=True):
        total = total + np.rint(np.frombuffer(w, np.float32).astype(np.float64) * 2**30) * k
        n += k
    return pa.table({"chunk": t.column("chunk").slice(0, 1), "weights": [(total / n / 2**30).astype(np.float32).tobytes()], "n": [n]})


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        log_c = model["log_c"]
        for batch in batches:
            parts = [(ids, _ids(model, h), first) for _, ids, _, h, first in _docs(batch)]
            if not parts:
                continue
            ids = np.concatenate([p[0] for p in parts])
            word = np.concatenate([p[1][0] for p in parts])
            hot = np.concatenate([p[1][1] for p in parts])
            n = np.concatenate([np.diff(p[2]) for p in parts])
            first = np.r_[0, np.cumsum(n)]
            doc = np.repeat(np.arange(len(ids)), n)
            log10 = net.score(model["net"], word, first, model["end"]) / np.log(10)
            rest = np.bincount(doc, word == net.REST, len(ids))
            listed = np.bincount(doc, np.where(hot >= 0, log_c[hot], 0), len(ids))
            among = np.bincount(doc, np.where((hot >= 0) & (word == net.REST), log_c[hot], 0), len(ids))
            score = log10 + among - rest * model["log_rest"]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(np.bincount(doc, (hot >= 0) & model["seen"][hot], len(ids)).astype(np.int64)), pa.array(listed - n * model["log_total"]), pa.array(score)], ["doc_id", "n_tokens", "known", "base", "score"])

    return run


TAIL = "bucket int, ids binary, counts binary, grams binary"


def _tail(sent, bits: int):
    """Packed (document, word, count) of words beyond the frequent list, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = sent.value, [], 0

        def flush():
            ids, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, h))
            ids, h = ids[order], h[order]
            new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])])
            tf = np.diff(np.r_[new, len(h)]).astype(np.uint32)
            ids, h = ids[new], h[new]
            b = (h >> np.uint64(64 - bits)).astype(np.int32)
            rows = [(int(b[s]), ids[s:e].tobytes(), tf[s:e].tobytes(), pack7(h[s:e])) for s, e in zip(*groups(b), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "ids", "counts", "grams"])

        for batch in batches:
            for _, ids, _, h, first in _docs(batch):
                far = np.flatnonzero(_ids(model, h)[1] < 0)
                if len(far):
                    held.append((np.repeat(ids, np.diff(first))[far], h[far]))
                    size += len(far)
                if size >= FLUSH // 2:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _look_up(parts: int):
    """Counts of one bucket's words summed for each document: packed by groups of documents."""

    def run(tail: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        if tail.num_rows:
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in tail.column("ids").to_pylist()])
            tf = np.concatenate([np.frombuffer(x, np.uint32) for x in tail.column("counts").to_pylist()]).astype(np.float64)
            h = np.concatenate([unpack7(x) for x in tail.column("grams").to_pylist()])
            c = np.zeros(len(h))
            if counts.num_rows:
                known = unpack7(counts.column("grams")[0].as_py())
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                c = np.where(known[at] == h, np.frombuffer(counts.column("counts")[0].as_py(), np.int64)[at], 0)
            order = np.lexsort((h, ids))
            ids, tf, c = ids[order], tf[order], c[order]
            s, _ = groups(ids)
            doc, logs, hits = ids[s], np.add.reduceat(tf * np.log10(c + 0.1), s), np.add.reduceat(tf * (c > 0), s)
            g = (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(g, kind="stable")
            g, doc, logs, hits = g[order], doc[order], logs[order], hits[order].astype(np.int32)
            out = [(int(g[a]), doc[a:b].tobytes(), logs[a:b].tobytes(), hits[a:b].tobytes()) for a, b in zip(*groups(g), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["grp", "ids", "logs", "hits"])

    return run


def _sums(t: pa.Table) -> pa.Table:
    doc, logs, hits = (np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()]) for c, k in (("ids", np.int64), ("logs", np.float64), ("hits", np.int32)))
    ids, at = np.unique(doc, return_inverse=True)
    order = np.lexsort((logs, at))
    return pa.table({"doc_id": ids, "logs": np.bincount(at[order], logs[order], len(ids)), "hits": np.bincount(at, hits, len(ids)).astype(np.int64)})


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Words are runs without ASCII white space, A-Z lowered, then one end token; a null text is empty. A null
    doc_id is learned from and not held out; rows that repeat an id share the mean of what their words
    beyond the frequent list add (of equal texts, what each adds). With nothing to learn
    from every count is 0. Empty input gives an empty result; further columns are not carried."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out(10, 0)).alias("train"))
    bits = bucket_bits(text_bytes(texts) // 6, 1 << 19)  # about six bytes a word
    counted = texts.mapInArrow(_count(bits), "bucket int, grams binary, counts binary").groupBy("bucket").applyInArrow(_merge(bits), "bucket int, grams binary, counts binary, top binary, top_c binary, n long, v long")
    counted = cut(counted)
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    tops = counted.select("top", "top_c").toArrow()
    h = np.frombuffer(b"".join(tops.column("top").to_pylist()), np.uint64)
    c = np.frombuffer(b"".join(tops.column("top_c").to_pylist()), np.int64)
    order = np.lexsort((h, -c))[:FREQUENT]
    h, c = h[order], c[order]
    if END not in h:  # nothing was learned, or the end is rarer than the list's last word
        h, c = np.r_[END, h], np.r_[0, c]
    rank = np.arange(len(h))
    # the network's words are the first of the list, with the end token among them
    e = int(np.flatnonzero(h == END)[0])
    if e >= net.WORDS:
        h[[e, 0]], c[[e, 0]], e = h[[0, e]], c[[0, e]], 0
    own = np.zeros(net.WORDS)
    own[: min(len(c), net.WORDS)] = c[: net.WORDS]
    rest_mass = float(n - own.sum())
    by = np.argsort(h)
    model = {
        "sorted": h[by], "slots": _slots(h[by]), "rank": rank[by], "log_c": np.log10(c[by] + 0.1), "seen": c[by] > 0, "end": e, "net": net.start(own, rest_mass),
        "log_total": float(np.log10(n + 0.1 * (v + 1))),
        # words beyond the network's: counts and 0.1 for each and for all that are new
        "log_rest": float(np.log10(rest_mass + 0.1 * (max(0, v - net.WORDS) + 1))),
    }
    sc = spark.sparkContext
    parts = max(1, -(-int(n) // (ROUNDS * TASK)))
    for r in range(ROUNDS if n else 0):
        share = texts.where(F.col("train") & (F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == r))
        got = share.coalesce(parts).mapInArrow(_train(sc.broadcast(model)), "chunk int, weights binary, n double")
        # each task's weights are averaged with some others' first
        mean = got.withColumn("some", F.pmod(F.xxhash64("n", F.spark_partition_id()), F.lit(max(1, int(parts**0.5)))))
        mean = mean.groupBy("chunk", "some").applyInArrow(_mean, "chunk int, weights binary, n double").groupBy("chunk").applyInArrow(_mean, "chunk int, weights binary, n double")
        rows = sorted(mean.select("chunk", "weights").collect(), key=lambda x: x["chunk"])
        if not rows:  # no document in this part
            continue
        flat = np.concatenate([np.frombuffer(x["weights"], np.float32) for x in rows])
        at, p = 0, {}
        for k in net.NAMES:
            size = model["net"][k].size
            p[k] = flat[at : at + size].reshape(model["net"][k].shape)
            at += size
        model = model | {"net": p}
    sent = sc.broadcast(model)
    main = texts.mapInArrow(_score(sent), "doc_id long, n_tokens long, known long, base double, score double")
    tail = texts.mapInArrow(_tail(sent, bits), TAIL).groupBy("bucket").cogroup(counted.select("bucket", "grams", "counts").groupBy("bucket")).applyInArrow(_look_up(2**bits), "grp int, ids binary, logs binary, hits binary")
    sums = tail.groupBy("grp").applyInArrow(_sums, "doc_id long, logs double, hits long")
    again = texts.groupBy(F.coalesce("doc_id", F.lit(LOW)).alias("doc_id")).agg(F.count("*").alias("m"))
    sums = sums.join(again.where("m > 1"), "doc_id", "left").select("doc_id", (F.col("logs") / F.coalesce("m", F.lit(1))).alias("logs"), (F.col("hits") / F.coalesce("m", F.lit(1))).cast("long").alias("hits"))
    out = main.join(sums, "doc_id", "left").withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    return out.select(
        F.nullif("doc_id", F.lit(LOW)).alias("doc_id"),
        F.when(F.col("doc_id") == LOW, False).otherwise(held_out(10, 0)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("hits", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.col("logs"), 6).alias("base_score"),
        F.round(F.col("score") + F.col("logs"), 6).alias("score"),
    )


def op5_lm(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
