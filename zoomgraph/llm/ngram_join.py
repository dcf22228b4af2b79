"""Jaccard self-join of five-word shingle sets with prefix trees.

1. Counts: every document's set size and a signature of its set; equal sets form a class. Shingles that
   repeat within a task are counted, and the most frequent of the corpus (a bounded list) come last in the
   global order of shingles. The list only orders: any order gives the same links.
2. Candidates: sets of n shingles or more can reach the threshold only if their prefixes in that order,
   longer by shares(n), have shares(n) shingles in common. The prefixes go by signature, so that copies are
   one already where they are read, and meet in hash buckets, where a common shingle must also pass the
   length bound and the bound on what can come before and after it. A short list of holders counts for all
   its pairs; a long one for each holder with a few pivots, and for itself. A pair with half the shares is a
   candidate, a document with half of them in long lists is hot and stays in play. Only a document's two best
   candidates are verified now; the others stay in play for step 5.
3. Verification: around each first member ("centre") its candidates' ordered sets are stored in a prefix
   tree, which the centre's set walks: shared beginnings are counted once, and a subtree is left when the
   remaining lengths can no longer reach the threshold.
4. Components of the links found so far label the documents. Hot documents meet again with other pivots,
   taken from the most common label of a list, so that a large group of near copies grows together with
   a few candidates for each of its documents.
5. At last the prefixes of all documents in play meet once more. A document asks each larger component with which
   it has enough prefix shingles in common, whichever members hold them; the component's sets are stored
   in prefix trees, block by block, and every document that asks walks them. So no link between components
   is lost, none inside one is repeated, and rows are documents and components, not pairs of documents.

Only one document of each class in play, that is with a candidate, is read again after step 2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, table
from .components import components
from .textkit import bucket_bits, groups, mix, pack7, pieces, unpack7, windows, words

LOW = -(2**63)
N = 5
#: Shingles that a task gathers before it reduces them; the length of the list of frequent ones; the longest list
#: whose pairs are all candidates at once; candidates of one centre, or sets of one tree, verified together; shingles
#: of one tree; partners of a set in a round with pivots; pivots of a long list.
FLUSH, FREQUENT, SHORT, TOGETHER, TREE, TOP, PIVOTS = 1 << 20, 1 << 16, 8, 512, 1 << 20, 2, 6


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, by document and hash; too short ones are one shingle."""
    w = words(data, offs, lower=True)
    at, h = windows(w.hash, w.first, N)
    doc = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < N))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(N - 1):
            has = w.counts[short] > k
            whole[has] = mix(whole[has] * np.uint64(31) + w.hash[w.first[short[has]] + k])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(whole + w.counts[short].astype(np.uint64))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _batches(batches, *columns):
    """(ids and other columns, document and shingle arrays) piece by piece."""
    for batch in batches:
        ids = batch.column(0).fill_null(LOW).to_numpy(zero_copy_only=False)
        rest = [batch.column(i).to_numpy(zero_copy_only=False) for i in columns]
        for lo, hi, data, offs in pieces(batch.column(1)):
            yield (ids[lo:hi], *[r[lo:hi] for r in rest]), *shingles(data, offs)


def signature(h: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """A sum of the hashes of each document's shingles, n of them for each."""
    cum = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(seed)))]
    return (cum[np.cumsum(n)] - cum[np.cumsum(n) - n]).view(np.int64)


SEEDS = (0x51, 0xA7)
STATS = "doc_id long, n int, s1 long, s2 long, gram long, cnt int"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def out(doc_id, n, s1, s2, gram, cnt):
        k = len(doc_id) if doc_id is not None else len(gram)
        none = lambda t: pa.nulls(k, t)
        return pa.RecordBatch.from_arrays([pa.array(x, t) if x is not None else none(t) for x, t in ((doc_id, pa.int64()), (n, pa.int32()), (s1, pa.int64()), (s2, pa.int64()), (gram, pa.int64()), (cnt, pa.int32()))], ["doc_id", "n", "s1", "s2", "gram", "cnt"])

    def flush():
        g, c = np.unique(np.concatenate(held), return_counts=True)
        return out(None, None, None, None, g[c > 1].view(np.int64), c[c > 1].astype(np.int32))

    size = 0
    for (ids,), doc, h in _batches(batches):
        n = np.bincount(doc, minlength=len(ids))
        yield out(ids, n.astype(np.int32), *[signature(h, n, seed) for seed in SEEDS], None, None)
        held.append(h)
        size += len(h)
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def frequent(stats: DataFrame) -> np.ndarray:
    """The most frequent shingles, least frequent first."""
    top = stats.where("gram is not null").groupBy("gram").agg(F.sum("cnt").alias("c")).orderBy(F.desc("c"), "gram").limit(FREQUENT).select("gram").toArrow()
    return top.column("gram").to_numpy().view(np.uint64)[::-1].copy()


def ordered(doc: np.ndarray, h: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of each document in global order: by hash, then the frequent ones by rank. And the ranks."""
    key = np.zeros(len(h), np.int64)
    if len(last):
        order = np.argsort(last)
        at = np.minimum(np.searchsorted(last[order], h), len(last) - 1)
        key = np.where(last[order][at] == h, order[at] + 1, 0)
    by = np.lexsort((h, key, doc))
    return doc[by], h[by], key[by]


def least_overlap(a, b):
    """The fewest common shingles of sets of a and b: 100 * common >= 80 * union."""
    return (4 * (a + b) + 8) // 9


def shares(n):
    """How many prefix shingles two sets must have in common, the smaller one of n."""
    return np.maximum(1, n // 25)


PREFIX = "bucket int, ids binary, comps binary, weights binary, lens binary, at binary, grams binary"


def _prefixes(bits: int, frequent_, labelled: bool):
    """Packed prefix shingles by bucket, each with its set: by signature, or by id with its label and that one's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent_.value
        held, size = [], 0

        def flush():
            ids, comps, weights, n, at, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, h))
            ids, h = ids[order], h[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])]
            ids, h, order = ids[new], h[new], order[new]
            comps, weights, n, at = (x[order] for x in (comps, weights, n, at))
            b = (h >> np.uint64(64 - bits)).astype(np.int32)
            rows = [(int(b[s]), ids[s:e].tobytes(), *((comps[s:e].tobytes(), weights[s:e].tobytes()) if labelled else (b"", b"")), n[s:e].tobytes(), at[s:e].tobytes(), pack7(h[s:e])) for s, e in zip(*groups(b), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], [x.split()[0] for x in PREFIX.split(", ")])

        for (ids, *label), doc, h in _batches(batches, *([2, 3] if labelled else [])):
            n = np.bincount(doc, minlength=len(ids))
            if not labelled:
                ids = signature(h, n, SEEDS[0])
                label = ids, np.ones(len(ids), np.int64)
            doc, h, _ = ordered(doc, h, last)
            at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            keep = at < n[doc] - (4 * n[doc] + 4) // 5 + shares(n[doc])
            doc, h, at = doc[keep], h[keep], at[keep]
            held.append((ids[doc], *[x[doc] for x in label], n[doc].astype(np.int32), at.astype(np.int32), h))
            size += len(h)
            if size >= FLUSH // 2:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _opened(t: pa.Table, labelled: bool):
    """The columns of one bucket: ids, labels and their sizes, set sizes, places, shingles; each set once a shingle."""
    col = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])
    ids, n, at = col("ids", np.int64), col("lens", np.int32).astype(np.int64), col("at", np.int32).astype(np.int64)
    comps, weights = (col("comps", np.int64), col("weights", np.int64)) if labelled else (ids, ids)
    h = np.concatenate([unpack7(x) for x in t.column("grams").to_pylist()])
    order = np.lexsort((ids, n, h))
    order = order[np.r_[True, (h[order][1:] != h[order][:-1]) | (ids[order][1:] != ids[order][:-1])]] if len(order) else order
    return tuple(x[order] for x in (ids, comps, weights, n, at, h))


def _fits(i, j, n, at):
    """Whether a shingle at these places counts for sets i and j, i not the larger: indexed prefix of i, and what
    else can be common."""
    ok = at[i] < n[i] - (8 * n[i] + 8) // 9 + shares(n[i])
    return ok & (np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]) >= least_overlap(n[i], n[j]))


def _tally(a, b, n, votes):
    """Votes summed over equal (a, b, n)."""
    order = np.lexsort((n, b, a))
    a, b, n, votes = a[order], b[order], n[order], votes[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1])]) if len(a) else np.zeros(0, int)
    return a[new], b[new], n[new], np.add.reduceat(votes, new) if len(new) else votes


PAIRS = "grp int, a binary, b binary, n binary, votes binary"


def _summed(t: pa.Table):
    col = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])
    return _tally(col("a", np.int64), col("b", np.int64), col("n", np.int32), col("votes", np.int32).astype(np.int64))


def _elected(t: pa.Table) -> pa.Table:
    """Of one group of asking sets: each set's best pairs with enough votes; and who stays in play.

    Rows of a document with itself: hot if long lists hold it, else it has partners that are not tried yet."""
    a, b, n, votes = _summed(t)
    ok = votes >= (shares(n) + 1) // 2
    a, b, votes = a[ok], b[ok], votes[ok]
    warm = np.unique(a[a == b])
    order = np.lexsort((a, -votes, b, a == b))
    a, b = a[order], b[order]
    own = a == b
    s, e = groups(np.where(own, LOW, b))
    best = (np.arange(len(b)) - np.repeat(s, e - s) < TOP) & ~own
    rest = np.setdiff1d(np.r_[a, b], np.r_[a[best], b[best], warm])
    a, b = np.r_[a[best], rest, warm], np.r_[b[best], rest, warm]
    return pa.table({"a": pa.array(a), "b": pa.array(b), "hot": pa.array(np.arange(len(a)) >= len(a) - len(warm))})


def _asked(t: pa.Table) -> pa.Table:
    """Of one group of asking documents: the components that each has to try. n is the least size of a partner."""
    a, b, n, votes = _summed(t)
    ok = votes >= shares(n)
    return pa.table({"comp": pa.array(a[ok]), "id": pa.array(b[ok])})


def _packed(a, b, k, parts: int) -> pa.Table:
    """One vote for each (a, b, k), added up and packed by the asking set's group."""
    a, b, k, votes = _tally(a, b, k, np.ones(len(a), np.int64))
    g = (mix(b.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(g, kind="stable")
    g, a, b, k, votes = g[order], a[order], b[order], k[order].astype(np.int32), votes[order].astype(np.int32)
    rows = [(int(g[x]), *(c[x:y].tobytes() for c in (a, b, k, votes))) for x, y in zip(*groups(g), strict=True)]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, ty) for c, ty in zip(cols, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["grp", "a", "b", "n", "votes"])


def _candidates(labelled: bool, seed: int, parts: int):
    """Votes of one bucket of prefix shingles for pairs (the asking set last), packed by the asking set's group.

    Lists of up to SHORT holders give every pair, the larger set asking. In a longer one each holder asks
    the PIVOTS least by hashes of their ids; with labels, the pivots are of the most common label and the
    holders of others ask."""

    def run(t: pa.Table) -> pa.Table:
        ids, comps, _, n, at, h = _opened(t, labelled)
        s, e = groups(h)
        found = [(np.zeros(0, np.int64),) * 3]

        def pairs(one, asker):
            i, j = np.minimum(one, asker), np.maximum(one, asker)
            ok = (5 * n[i] >= 4 * n[j]) & (ids[i] != ids[j]) & _fits(i, j, n, at)
            if labelled:
                ok &= comps[i] != comps[j]
            found.append((ids[one[ok]], ids[asker[ok]], n[i[ok]]))

        size = e - s
        for m in range(2, SHORT + 1):
            at_m = s[size == m]
            for x in range(m):
                for y in range(x + 1, m):
                    if len(at_m):
                        pairs(at_m + x, at_m + y)
        for x, y in zip(s[size > SHORT], e[size > SHORT], strict=True):
            j = np.arange(x, y)
            of, asking = j, j
            if labelled:
                _, which, count = np.unique(comps[x:y], return_inverse=True, return_counts=True)
                most = np.argmax(count)
                of, asking = j[which == most], j[which != most]
            order = mix(ids[of].view(np.uint64) ^ np.uint64(seed))
            pivots = of[np.argpartition(order, PIVOTS - 1)[:PIVOTS]] if len(of) > PIVOTS else of
            for i in pivots:
                pairs(np.full(len(asking), i), asking)
            if not labelled:  # and the first that is not too small; each holder with itself
                i = np.searchsorted(n[x:y], (4 * n[x:y] + 4) // 5, "left") + x
                new = (i < j) & ~np.isin(i, pivots)
                pairs(i[new], j[new])
                found.append((ids[j], ids[j], (4 * n[j] + 4) // 5))  # by the smallest partner it can have
        return _packed(*(np.concatenate(c) for c in zip(*found, strict=True)), parts)

    return run


def _asks(parts: int):
    """Votes of one bucket of prefix shingles for (component, document of a smaller one), packed likewise.

    Of two components the one with fewer documents in play asks, of equal ones that of the smaller label: the same one
    whatever the shingle. A document counts a shingle for a component if some holder there is of like size;
    where there is one holder only, if the bounds of that pair hold."""

    def run(t: pa.Table) -> pa.Table:
        ids, comps, weights, n, at, h = _opened(t, True)
        order = np.lexsort((n, comps, weights, h))
        ids, comps, n, at, h = (x[order] for x in (ids, comps, n, at, h))
        # runs: holders of one shingle with one label; those of a shingle follow each other, from the smallest component
        s = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (comps[1:] != comps[:-1])])
        e = np.r_[s[1:], len(h)]
        last = np.searchsorted(h[s], h[s], "right") - 1
        found = [(np.zeros(0, np.int64),) * 3]
        asking, step = np.flatnonzero(last > np.arange(len(s))), 1
        while len(asking):
            of, size = asking + step, e[asking] - s[asking]
            b = np.repeat(s[asking] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            of = np.repeat(of, size)
            ok = (5 * n[e[of] - 1] >= 4 * n[b]) & (4 * n[s[of]] <= 5 * n[b])
            b, of = b[ok], of[ok]
            y = s[of]
            small, large = np.where(n[b] <= n[y], b, y), np.where(n[b] <= n[y], y, b)
            ok = (e[of] - y > 1) | _fits(small, large, n, at)
            b, y = b[ok], y[ok]
            found.append((comps[y], ids[b], (4 * n[b] + 4) // 5))
            step += 1
            asking = asking[last[asking] >= asking + step]
        return _packed(*(np.concatenate(c) for c in zip(*found, strict=True)), parts)

    return run


class Trie:
    """A compressed prefix tree of ordered sets: a node holds a run of shingles that its sets share.

    Nodes are made when a walk first reaches them."""

    def __init__(self, sets: list[np.ndarray], rank: list[np.ndarray]):
        # byte keys that sort as the global order does: rank, then hash
        keys = [np.stack([r.astype(">u8").view(np.uint64), s.astype(">u8").view(np.uint64)], 1).tobytes() for s, r in zip(sets, rank, strict=True)]
        self.sets = sets
        self.root = self._node(sorted(range(len(sets)), key=keys.__getitem__), 0)

    def _node(self, members: list[int], depth: int) -> dict:
        first, final = self.sets[members[0]], self.sets[members[-1]]
        m = min(len(first), len(final))
        same = first[depth:m] == final[depth:m]
        end = m if same.all() else depth + int(np.argmin(same))
        sizes = [len(self.sets[i]) for i in members]
        return {"run": first[depth:end], "end": end, "done": [i for i in members if len(self.sets[i]) == end], "rest": [i for i in members if len(self.sets[i]) > end], "least": min(sizes), "most": max(sizes)}

    def _children(self, node: dict) -> list[dict]:
        if "children" not in node:
            rest, end, k, node["children"] = node["rest"], node["end"], 0, []
            while k < len(rest):
                g, j = self.sets[rest[k]][end], k
                while j < len(rest) and self.sets[rest[j]][end] == g:
                    j += 1
                node["children"].append(self._node(rest[k:j], end))
                k = j
        return node["children"]

    def walk(self, probe: np.ndarray) -> Iterator[tuple[int, int]]:
        """(set, overlap) of every set that reaches the threshold with the probe."""
        known = np.sort(probe)
        if not len(known):
            return
        stack = [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            run = node["run"]
            if len(run):
                at = np.minimum(np.searchsorted(known, run), len(known) - 1)
                common += int((known[at] == run).sum())
            for i in node["done"]:
                if common >= least_overlap(len(self.sets[i]), len(probe)):
                    yield i, common
            if node["rest"] and common + min(node["most"] - node["end"], len(probe) - common) >= least_overlap(node["least"], len(probe)):
                stack.extend((c, common) for c in self._children(node))


def _sets(text: pa.ChunkedArray, last: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ordered sets of a group's texts and their ranks."""
    sets, ranks = [], []
    for _, _, data, offs in pieces(text):
        doc, h = shingles(data, offs)
        n = np.bincount(doc, minlength=len(offs) - 1)
        doc, h, key = ordered(doc, h, last)
        cut_at = np.cumsum(n)[:-1]
        sets += np.split(h, cut_at)
        ranks += np.split(key, cut_at)
    return sets, ranks


LINK = "a long, b long"


def _found(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify(frequent_):
    """Pairs of one centre and some of its candidates that reach the threshold."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        sets, ranks = _sets(t.column("text"), frequent_.value)
        centre = int(np.flatnonzero(ids == t.column("a")[0].as_py())[0])
        others = [i for i in range(len(ids)) if i != centre and len(sets[i])]
        hits = []
        if others:
            trie = Trie([sets[i] for i in others], [ranks[i] for i in others])
            hits = [int(ids[others[i]]) for i, _ in trie.walk(sets[centre])]
        return _found([int(ids[centre])] * len(hits), hits)

    return run


def _links(pairs: DataFrame, live: DataFrame, frequent_) -> DataFrame:
    """The pairs (a, b) that are links. A centre with many candidates is dealt over groups of TOGETHER."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("k"))
    asked = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part"), F.col("b").alias("id"))
    centres = size.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part")).withColumn("id", F.col("a"))
    rows = asked.union(centres).join(live.select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.groupBy("a", "part").applyInArrow(_verify(frequent_), LINK)


def _meet(frequent_):
    """For each document that asks one block of a component, a member of the block that it is linked with."""

    def run(t: pa.Table) -> pa.Table:
        ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
        sets, ranks = _sets(t.column("text"), frequent_.value)
        of = [i for i in np.flatnonzero(~asks) if len(sets[i])]
        a, b = [], []
        if of:
            trie = Trie([sets[i] for i in of], [ranks[i] for i in of])
            for i in np.flatnonzero(asks):
                for j, _ in trie.walk(sets[i]):
                    a.append(int(ids[of[j]]))
                    b.append(int(ids[i]))
                    break
        return _found(a, b)

    return run


def _bridges(asks: DataFrame, live: DataFrame, frequent_) -> DataFrame:
    """Of asks(comp, id), links (a, b) of the document with a member of the component, one for each block that has any.

    Components are dealt over blocks, and those who ask over chunks, of bounded numbers of sets and shingles; a
    block meets each chunk."""
    parts = lambda: F.ceil(F.greatest(F.count("*") / TOGETHER, F.sum("n") / TREE)).cast("int")
    chunks = asks.join(live.select(F.col("doc_id").alias("id"), "n"), "id").groupBy("comp").agg(parts().alias("c"))
    plan = live.groupBy("comp").agg(parts().alias("k")).join(chunks, "comp")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = live.select("comp", F.col("doc_id").alias("id")).join(plan, "comp").withColumn("part", dealt("k")).select("comp", "id", F.lit(False).alias("asks"), "part", every("c").alias("chunk"))
    askers = asks.join(plan, "comp").withColumn("chunk", dealt("c")).select("comp", "id", F.lit(True).alias("asks"), every("k").alias("part"), "chunk")
    rows = members.union(askers).join(live.select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.groupBy("comp", "part", "chunk").applyInArrow(_meet(frequent_), LINK)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of docs.

    Words are runs without ASCII white space after A-Z are lowered. Fewer than five words are one shingle;
    null or blank texts have an empty set and are linked with nothing. class_id: the smallest doc_id with
    the same set. component_id: the smallest reachable by links. Rows that repeat an id are joined in
    one component; if their texts differ, any one of them is compared with other documents. A null doc_id counts as the smallest id. Empty input gives an
    empty result; further columns are not carried."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = cut(texts.mapInArrow(_stats, STATS), F.sum(F.col("n").cast("long")).alias("n"))
    bits = bucket_bits((stats.measured["n"] or 0) // 4)  # about a quarter of a set is its prefix
    parts = max(64, 2 ** (bits - 3))
    sets = stats.where("doc_id is not null").select("doc_id", "n", "s1", "s2")
    classes = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id"))
    classed = cut(sets.join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", "s1", "class_id"))
    last = spark.sparkContext.broadcast(frequent(stats))
    release(stats)
    named = classed.where("n > 0").select(F.col("s1").alias("sig"), "class_id").distinct()

    def candidates(d: DataFrame, labelled: bool, seed: int) -> DataFrame:
        sent = d.mapInArrow(_prefixes(bits, last, labelled), PREFIX)
        return sent.groupBy("bucket").applyInArrow(_candidates(labelled, seed, parts), PAIRS).groupBy("grp").applyInArrow(_elected, "a long, b long, hot boolean")

    # signatures are looked up again as classes; two that share one by chance are both tried
    found = candidates(texts, False, 0).join(named.toDF("a", "ca"), "a").join(named.toDF("b", "cb"), "b")
    found = cut(found.where("ca <> cb or a = b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.max("hot").alias("hot")))
    ids = found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    hot = found.where("a = b and hot").select(F.col("a").alias("doc_id"), F.lit(True).alias("hot"))
    live = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(LOW))).join(ids.join(hot, "doc_id", "left").hint("merge"), "doc_id").join(classed.where("doc_id = class_id").groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    live = cut(live.dropDuplicates(["doc_id"]).select("doc_id", "text", "n", F.coalesce("hot", F.lit(False)).alias("hot")))
    pairs = found.where("a <> b").select("a", "b")
    links = cut(_links(pairs, live, last))

    def label(links: DataFrame) -> DataFrame:
        of = live.select("doc_id").join(components(links).withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"))
        sized = of.join(of.groupBy("comp").agg(F.count("*").alias("weight")), "comp")
        return live.join(sized, "doc_id").select("doc_id", "text", "comp", "weight", "n", "hot")

    more = cut(candidates(label(links).where("hot"), True, 1).where("a <> b").select("a", "b").join(pairs.union(pairs.select("b", "a")), ["a", "b"], "left_anti"))
    links = links.union(cut(_links(more, live, last)))
    labelled = cut(label(links))
    asks = labelled.mapInArrow(_prefixes(bits, last, True), PREFIX).groupBy("bucket").applyInArrow(_asks(parts), PAIRS).groupBy("grp").applyInArrow(_asked, "comp long, id long")
    links = links.union(_bridges(cut(asks), labelled, last))
    # rows of one id with several texts are one
    same = classed.where("n > 0").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b")
    same = classed.where("n > 0").join(same.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    final = components(links.union(same)).withColumnRenamed("id", "class_id")
    out = classed.join(final, "class_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    return out.select(*[F.nullif(F.col(c), F.lit(LOW).cast("long")).alias(c) if c != "n_shingles" else F.col(c) for c in out.columns])


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_ngram_join(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest id; rows that repeat an id stay or go together."""
    gone = near_duplicates(docs).where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__id"]), "left_anti")


OP2_SQL = r"""
WITH RECURSIVE s AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM s WHERE w IS NOT NULL),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(id, seen) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
    k AS (SELECT id, min(seen) AS component FROM r GROUP BY id),
    t AS (SELECT min(doc_id) AS class_id, list(doc_id) AS ids FROM (SELECT doc_id, list(g ORDER BY g) AS gs FROM g GROUP BY 1) GROUP BY gs)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(t.class_id, d.doc_id) AS class_id, coalesce(k.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.id = d.doc_id
LEFT JOIN (SELECT class_id, unnest(ids) AS doc_id FROM t) t ON t.doc_id = d.doc_id
"""
