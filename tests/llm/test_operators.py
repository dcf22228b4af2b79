"""Each operator on a small fixture with odd rows, on no rows, and against brute force."""

import hashlib
import itertools
import re
import tracemalloc
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from zoomgraph.llm import decontaminate, fingerprint, language, lm, mixing, ngram_join, recurrent, secrets, sharding, substrings, token_counts
from zoomgraph.llm.automaton import Automaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def made(spark, texts, start=0):
    rows = [(start + i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string").repartition(3)


def noise(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.integers(vocabulary, size=n))


@pytest.fixture(scope="module")
def corpus(spark):
    base, shared = noise(1, 120), noise(2, 40)
    texts = [base, base, base.replace("w1", "z9", 1), "x " + base, noise(3, 60) + " " + shared, noise(4, 80) + " " + shared, shared, "one two", "one two", "", None, noise(5, 900)]
    words = base.split()
    texts += [" ".join(words[:k] + ["q%d" % k] + words[k + 1 :]) for k in range(5, 115, 8)]
    return made(spark, texts)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def everything(docs, bench):
    return {
        "fingerprint": lambda: fingerprint.imatch(docs), "ngrams": lambda: ngram_join.near_duplicates(docs), "language": lambda: language.identify(docs), "shards": lambda: sharding.histogram_shards(docs), "lm": lambda: lm.lm_scores(docs), "substrings": lambda: substrings.remove_repeats(docs),
        "leaks": lambda: decontaminate.leaks(docs, bench), "mix": lambda: mixing.pareto_mix(docs), "secrets": lambda: secrets.find_secrets(docs), "tokens": lambda: token_counts.token_counts(docs),
    }


NAMES = ["fingerprint", "ngrams", "language", "shards", "lm", "substrings", "leaks", "mix", "secrets", "tokens"]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, "What is the capital of the land? It is the old city by the sea."), (1, None), (None, "")], "item_id long, text string")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_none(spark, odd_docs, bench, name):
    n = odd_docs.count()
    got = everything(odd_docs, bench)[name]().collect()
    assert len(got) == n or name == "leaks"
    twice = odd_docs.union(odd_docs)
    assert len(everything(twice, bench)[name]().collect()) == 2 * n or name == "leaks"
    assert everything(odd_docs.limit(0), bench)[name]().count() == 0


def test_fingerprint(spark, corpus):
    t = texts_of(corpus)
    got = {r["doc_id"]: r for r in fingerprint.imatch(corpus).collect()}
    ids = sorted(t)
    for i, d in enumerate(ids):
        x, y = t[d] or "", t[ids[(i + 1) % len(ids)]] or ""
        k = len(x) // 4
        assert got[d]["edited_sha256"] == hashlib.sha256((x[: len(x) - k] + y[:k]).encode()).hexdigest()
        assert got[d]["n_chars"] == len(x)
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1
    assert got[0]["fingerprint"] != got[4]["fingerprint"]


def test_fingerprint_uses_the_whole_band(spark):
    n = 9_000  # terms, each in two texts
    texts = [" ".join(f"t{j}" for j in range(k, n, 10)) for k in range(10)] * 2
    words = fingerprint.lexicon(made(spark, texts))
    codes = spark.range(n).select(F.xxhash64(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("h"))
    assert codes.where(fingerprint._known(words)(F.col("h"))).count() == n
    assert codes.where(fingerprint._known(words)(F.col("h") + 1)).count() == 0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_fingerprint(text, band):
    found = {signed(xxhash.xxh64(t.encode(), 42).intdigest()): t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}
    t = sorted(c for c, w in found.items() if w in band) or sorted(found) or [signed(xxhash.xxh64(("=" + text).encode(), 42).intdigest())]

    def fold(a):
        h = 42
        for c in a:
            h = xxhash.xxh64(c.to_bytes(8, "little", signed=True), h).intdigest()
        return h if a else 0

    nested = [[c for c in t if c >> 34 + 6 * k & 63 < share] for share in fingerprint.SHARES for k in range(fingerprint.FAMILIES)]
    return [fold(a) for a in [t, *nested]]


def test_fingerprints_by_brute_force(spark):
    texts = [noise(s, 30 + 11 * s, 900).replace("w7", "Été") for s in range(40)] + ["", None, "-- ?", "zz yy", noise(3, 63, 900) + " new"]
    t = dict(enumerate(x or "" for x in texts))
    df = Counter(w for x in t.values() for w in set(regex.split(r"[^\p{L}\p{N}]+", x.lower())) if w)
    band = {w for w, n in df.items() if 2 <= n <= 0.1 * len(t)}
    assert band and len(band) < len(df)

    def alike(a, b):
        both = [x == y for x, y in zip(a, b, strict=True) if x or y]
        return sum(both) / len(both) if both else 0.0

    shown = lambda a: "-".join(f"{h:016x}" for h in a)
    rows = fingerprint.imatch(made(spark, texts), most=0.1, least=0.002).collect()
    assert len(rows) == len(t)
    for r in rows:
        x, y = t[r["doc_id"]], t[(r["doc_id"] + 1) % len(t)]
        own, edited, after = (brute_fingerprint(z, band) for z in (x, x[: len(x) - len(x) // 4] + y[: len(x) // 4], y))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(edited))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(alike(own, edited)), pytest.approx(alike(own, after)))


def brute_components(t):
    sets = {}
    for d, x in t.items():
        w = WORD.findall((x or "").translate(LOW))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {d: d for d in t}
    for a in t:
        for b in t:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {k: x if v == y else v for k, v in comp.items()}
    return sets, comp


def test_ngram_join(spark, corpus):
    t = texts_of(corpus)
    sets, comp = brute_components(t)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(corpus).collect()}
    assert got == {d: (len(sets[d]), comp[d]) for d in t}


def test_trie_walk_is_exact():
    rng = np.random.default_rng(0)
    probe = np.arange(100, dtype=np.uint64)
    sets = [np.sort(rng.choice(130, size=int(n), replace=False).astype(np.uint64)) for n in rng.integers(1, 130, 200)] + [probe, probe[:80], probe[:79]]
    ranks = [np.zeros(len(s), np.int64) for s in sets]
    got = dict(ngram_join.Trie(sets, ranks).walk(probe))
    want = {i: len(np.intersect1d(s, probe)) for i, s in enumerate(sets)}
    assert got == {i: n for i, n in want.items() if 100 * n >= 80 * (len(sets[i]) + 100 - n)}


@pytest.mark.parametrize("bits", [8, 13])
def test_substrings(spark, corpus, monkeypatch, bits):
    monkeypatch.setattr(substrings, "bucket_bits", lambda *_: bits)
    t = texts_of(corpus)
    least = {}
    words = {d: WORD.findall(x or "") for d, x in t.items()}
    for d, w in words.items():
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    for r in substrings.remove_repeats(corpus).collect():
        w = words[r["doc_id"]]
        gone = set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < r["doc_id"]:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_shards_are_exact(spark, odd_docs):
    docs = odd_docs.unionByName(made(spark, [noise(i, 30 + i) for i in range(150)] + ["same text"] * 150, 100))
    rows = sharding.histogram_shards(docs, 8, block_rows=16).collect()
    keyed = sorted(rows, key=lambda r: (-1 if r["text_crc32"] is None else r["text_crc32"], -(2**63) if r["doc_id"] is None else r["doc_id"]))
    total, below, place = sum(r["size"] for r in rows), 0, Counter()
    for r in keyed:
        assert r["shard"] == sum(8 * below >= total * j for j in range(1, 8))
        assert r["slot"] == place[r["shard"]]
        assert r["size"] == len((r["text"] or "").encode()) + 1
        assert r["text_crc32"] == (None if r["text"] is None else zlib.crc32(r["text"].encode()))
        place[r["shard"]] += 1
        below += r["size"]


CLASHES = ["n", "hi", "lo", "c1", "c2", "c3", "key", "base", "hit", "v", "least", "most", "id", "row", "big1", "first", "whole", "last", "edge", "room", "__n", "__salt", "factor", "b1", "words", "comp", "a", "b"]


def test_any_other_name_may_occur(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(c + "-"), F.col("text")).alias(c) for c in CLASHES])
    want = Counter(map(tuple, docs.collect()))
    for stage in (sharding.histogram_shards, mixing.pareto_mix, language.identify):
        assert Counter(tuple(r[c] for c in docs.columns) for r in stage(docs).collect()) == want
    for stage in (mixing.stage_mixing, language.stage_language, ngram_join.stage_ngram_join, sharding.stage_sharding):
        rows = stage(spark, docs, "").collect()
        assert rows and {tuple(r[c] for c in docs.columns) for r in rows} <= set(want)


def test_tolerance_is_met(spark):
    rows = spark.createDataFrame([(int(x), i, 10) for i, x in enumerate(np.random.default_rng(0).integers(2**32, size=4000))], "hi long, lo long, size long")
    at = sharding.splitters(rows, 40_000, 4, probes=64, tolerance=0.05)
    sizes = Counter(r[0] for r in rows.select(sharding.shard_of(at)).collect())
    assert len(at) == 3 and all(abs(sizes[i] - 1000) <= 100 for i in range(4))


def test_mix_comes_near_targets(spark):
    rows = [(i, noise(i, 5 + i % 90), "en", f"s{i % 7}" if i % 3 else "hot", None) for i in range(900)] + [(901, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string")
    got = mixing.pareto_mix(docs).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in mixing.pareto_mix(docs.repartition(5)).collect())
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["size"] == len(WORD.findall(r["text"] or ""))
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-6
        assert target[s] - 90 <= taken[s] <= target[s] + 1e-6


def test_mix_draws_by_size(spark):
    sizes = [5] * 600 + [20] * 600 + [5_000] + [64, 40, 35, 30, 14, 9, 6, 4, 3, 2, 1] * 3
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "a" if i <= 1200 else "b") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.pareto_mix(docs).collect()
    for s in "ab":
        rows = [r for r in got if r["source"] == s]
        base = int(rows[0]["target"] // rows[0]["source_size"])
        left = rows[0]["target"] - sum(r["taken"] for r in rows)
        assert 0 <= left < min(r["size"] for r in rows if r["copies"] == base)  # nothing fits any more
        if s == "a":  # the long text is certain, the others are drawn about four to one
            n = Counter(r["size"] for r in rows if r["copies"] > base)
            assert n[5_000] == 1 and 2.5 < n[20] / n[5] < 6


def expressed(text):
    """The spans by Python's expressions."""
    return sorted((m.start(), k, m.end()) for k, (pattern, group, least) in enumerate(secrets.RULES.values()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least)


def test_secrets_match_expressions(spark):
    rng = np.random.default_rng(3)
    bits = ["password", "token", "API_key", "secret ", "=", ":", " ", '"', "abcd", "0123456789abcdef", "deadbeef" * 4, "AKIA", "ABCDEFGH1234", "x", "\n", "ü", "eyJa.b.c", "ghp_" + "a1" * 20]
    docs = made(spark, ["".join(rng.choice(bits, size=int(n))) for n in rng.integers(0, 50, 400)])
    t = texts_of(docs)
    for r in secrets.find_secrets(docs).collect():
        found = expressed(t[r["doc_id"]] or "")
        assert r["spans"] == secrets._shown(found)
        base = [x for x in found if x[1] < 3]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(secrets._shown(base).encode()).hexdigest()


def test_automaton_is_the_expressions():
    patterns = ["ab+c?", "(x|yz){2,3}d", "[0-9]{3}", r"\x41\.q*"]
    dfa, back = Automaton(patterns), Automaton(patterns, backward=True)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcxyzd019A.q "), size=int(n))) for n in rng.integers(0, 40, 500)]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    want = [sum(bool(re.search(p, t)) << k for k, p in enumerate(patterns)) for t in texts]
    for a, d, o in ((dfa, data, offs), (back, data[::-1], len(data) - offs[::-1])):
        at, mask = a.hits(d, o, lane=8, warm=3)
        got = np.zeros(len(texts), int)
        np.bitwise_or.at(got, np.searchsorted(o, at, "right") - 1, mask)
        assert got.tolist() == (want if a is dfa else want[::-1])
    starts = {(i, m.start() + j) for i, t in enumerate(texts) for j in range(len(t)) if (m := re.match(patterns[1], t[j:]))}
    at, mask = back.hits(data[::-1], len(data) - offs[::-1], lane=8)
    at = len(data) - 1 - at[mask & 2 > 0]
    assert {(int(np.searchsorted(offs, x, "right") - 1), int(x - offs[np.searchsorted(offs, x, "right") - 1])) for x in at} == starts


def test_secrets_in_very_long_texts(spark):
    texts = ["a" * 3_000_000, " " * 1_000_000 + "token=abcdefgh", "token" + " " * 500_000 + "= xyzxyzxyz", "f" * 31 + "\n" + "0" * 200_000 + "g", "password=" * 3_000]
    for r, t in zip(secrets.find_secrets(made(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        assert r["spans"] == secrets._shown(expressed(t))


def test_language_is_learned(spark):
    rng = np.random.default_rng(5)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["eau", "ou", "le", "que"], "cc": ["sch", "ung", "der", "ein"]}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k], size=int(m))) for m in rng.integers(1, 4, n))
    rows = [(i, say(k, 60), k) for i, k in enumerate(list(parts) * 60)]
    mixed = say("aa", 300) + " " + say("bb", 80)
    rows += [(500, mixed, None), (501, "12 34 !!", None), (502, None, "aa"), (503, "ÄÖ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    held = [i for i in range(180) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(180))
    assert np.mean([got[i]["lang_pred"] == list(parts)[i % 3] for i in held]) > 0.95
    assert got[500]["lang_pred"] == "aa" and 0.6 < got[500]["score"] < 0.95
    assert got[501]["lang_pred"] == got[502]["lang_pred"] == "und" and got[503]["lang_pred"] != "und"


def test_short_texts_and_many_languages_are_learned(spark):
    rng = np.random.default_rng(15)
    roots = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnop"), size=4)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(roots[k], size=5)), k) for i, k in enumerate(list(roots) * 30)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert not [i for i, t, _ in rows if got[i]["lang_pred"] == "und"]
    assert {got[i]["lang_pred"] for i, _, _ in held} == set(roots)
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.95


def test_field_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(16)
    k, sizes = 3, [4, 2, 1]
    em, tr = rng.random((3, 4, k)) + 0.1, rng.random((k, k)) + 0.1
    valid = np.arange(4) < np.array(sizes)[:, None]
    post, pair = language.posteriors(em, tr, valid)
    for d, n in enumerate(sizes):
        one, two, total = np.zeros((n, k)), np.zeros((max(0, n - 1), k, k)), 0.0
        for y in itertools.product(range(k), repeat=n):
            p = (np.full(k, 1 / k) @ tr)[y[0]] * np.prod([em[d, t, y[t]] for t in range(n)]) * np.prod([tr[y[t], y[t + 1]] for t in range(n - 1)])
            total += p
            for t in range(n):
                one[t, y[t]] += p
            for t in range(n - 1):
                two[t, y[t], y[t + 1]] += p
        np.testing.assert_allclose(post[d, :n], one / total)
        np.testing.assert_allclose(pair[d, : n - 1], two / total)
        assert not post[d, n:].any() and not pair[d, max(0, n - 1) :].any()


def test_forward_backward_over_blocks_is_exact(monkeypatch):
    rng = np.random.default_rng(6)
    first, tr = np.array([0, 5, 5, 42, 300]), rng.random((3, 3)) + 0.1
    em = rng.random((300, 3)) + 0.05
    monkeypatch.setattr(language, "BLOCK", 7)
    got = language.shares(em, first, tr)
    for d in range(4):
        e = em[first[d] : first[d + 1]]
        a, b = np.zeros_like(e), np.ones_like(e)
        for t in range(len(e)):
            a[t] = ((a[t - 1] if t else np.full(3, 1 / 3)) @ tr) * e[t]
            a[t] /= a[t].sum()
        for t in range(len(e) - 2, -1, -1):
            b[t] = (e[t + 1] * b[t + 1]) @ tr.T
            b[t] /= b[t].sum()
        p = a * b
        want = (p / p.sum(1, keepdims=True)).sum(0) if len(e) else np.zeros(3)
        np.testing.assert_allclose(got[d], want, atol=1e-9)


def test_lm_base_and_gain(spark):
    rng = np.random.default_rng(7)
    words = [["red", "blue", "green", "pink"], ["cat", "dog", "cow", "pig"]]
    texts = [" ".join(rng.choice(words[i % 2], size=60)) + f" rare{i}" for i in range(200)] + [None, ""]
    docs = made(spark, texts)
    rows = {r["doc_id"]: r for r in lm.lm_scores(docs).collect()}
    toks = {i: WORD.findall((t or "").translate(LOW)) + ["\n"] for i, t in enumerate(texts)}
    held = {i for i in toks if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(w for i in toks if i not in held for w in toks[i])
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        assert rows[i]["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs=1e-4)
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"], rows[i]["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, i in held)
    assert sum(rows[i]["score"] - rows[i]["base_score"] for i in held) > 0


@pytest.fixture
def small_net(monkeypatch):
    for name, value in {"HIDDEN": 5, "CLASSES": 3, "CLASS": 4, "WORDS": 12, "REST": 12, "TRUNCATE": 6}.items():
        monkeypatch.setattr(recurrent, name, value)
    rng = np.random.default_rng(17)
    return {k: rng.standard_normal(x.shape) * 0.5 for k, x in recurrent.start(np.arange(1.0, 13), 5.0).items()}


def test_gradient_agrees_with_differences(small_net):
    rng, p, end = np.random.default_rng(18), small_net, 2
    words, before, h0 = rng.integers(0, 13, (4, 6)), np.array([2, 1, 2, 5]), rng.standard_normal((4, 5)) * [[0], [1], [0], [1]]
    valid = np.arange(6) < np.array([6, 6, 3, 5])[:, None]
    g = recurrent.zeros(p)
    recurrent.gradient(p, words, h0, before, valid, end, g)
    g = recurrent.whole(p, g)
    loss = lambda: -recurrent.gradient(p, words, h0, before, valid, end, recurrent.zeros(p))[1]
    for k, x in p.items():
        for i in rng.choice(x.size, min(x.size, 25), replace=False):
            at, step = np.unravel_index(i, x.shape), 1e-5
            x[at] += step
            up = loss()
            x[at] -= 2 * step
            down = loss()
            x[at] += step
            assert (up - down) / (2 * step) == pytest.approx(g[k][at], abs=1e-6)


def test_probabilities_sum_to_one_and_windows_do_not_matter(small_net, monkeypatch):
    p, end = small_net, 2
    h = np.random.default_rng(19).standard_normal((7, 5))
    total = sum(np.exp(recurrent.log_prob(p, h, np.full(7, w))) for w in range(13))
    np.testing.assert_allclose(total, 1)
    words = np.random.default_rng(20).integers(0, 13, 60)
    words[[9, 10, 59]] = end
    first = np.array([0, 10, 11, 60])
    whole = recurrent.score(p, words, first, end)
    monkeypatch.setattr(recurrent, "WINDOW", 3)
    np.testing.assert_allclose(recurrent.score(p, words, first, end), whole)
    for d in range(3):  # word by word
        state, last, lp = np.zeros((1, 5)), end, 0.0
        for x in words[first[d] : first[d + 1]]:
            state = recurrent.step(p, p["embed"][[last]] @ p["input"] + p["bias"], state)[0]
            lp, last = lp + recurrent.log_prob(p, state, np.array([x]))[0], x
        assert whole[d] == pytest.approx(lp)


def test_trainer_reads_every_word_once_with_its_state(small_net, monkeypatch):
    docs = [np.r_[np.random.default_rng(i).integers(3, 13, n), 2].astype(np.int16) for i, n in enumerate([0, 3, 40, 7, 100, 1, 1, 25])]
    seen, real = [], recurrent.gradient

    def spy(p, words, h0, before, valid, end, g):
        h, lp = real(p, words, h0, before, valid, end, g)
        seen.append((words[valid], lp))
        return h, lp

    monkeypatch.setattr(recurrent, "gradient", spy)
    trainer = recurrent.Trainer(small_net, 2, 3, rate=0.0)
    trainer.learn(docs[:4])
    trainer.learn(docs[4:], True)
    assert Counter(np.concatenate([x for x, _ in seen]).tolist()) == Counter(np.concatenate(docs).tolist())
    flat = np.concatenate(docs).astype(np.int64)
    want = recurrent.score(small_net, flat, np.r_[0, np.cumsum([len(d) for d in docs])], 2).sum()
    assert sum(lp for _, lp in seen) == pytest.approx(want)  # with weights that stay, all states are those of scoring


def test_wand_is_exact():
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, size=int(rng.integers(3, 30))) % 60)) for i in range(100)]
    (index,), _ = decontaminate.build(rows)
    for _ in range(200):
        terms = np.unique(rng.integers(len(index.vocabulary), size=int(rng.integers(1, 40))))
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.item[index.at[t] : index.at[t + 1]]] += index.impact[index.at[t] : index.at[t + 1]]
        for least in (0.2, 0.6):
            got = dict(index.wand(terms, least))
            assert set(got) == set(np.flatnonzero(score >= least - 1e-9))
            assert all(s == pytest.approx(score[d]) for d, s in got.items())


def test_leaks(spark, bench):
    item = bench.first()["text"]
    texts = [noise(i, 300) for i in range(6)]
    texts[1] += " " + item
    texts[3] = noise(9, 57) + " " + item.upper() + " " + noise(10, 400)
    texts[4] += " " + " ".join(sorted(item.split()))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(made(spark, texts), bench).collect()}
    assert got == {(1, 0), (3, 0)}


def test_shares_of_a_large_test_set_find_the_same(spark, monkeypatch):
    items = [f"{noise(100 + i, 9 + i % 7, 80)}? {noise(200 + i, 5, 80)}." for i in range(60)] + ["", None, "..."]
    held = spark.createDataFrame(list(enumerate(items)) + [(None, items[0])], "item_id long, text string").repartition(4)
    docs = made(spark, [noise(i, 200, 80) + " " + items[i] + " " + noise(50 + i, 150, 80) for i in range(0, 60, 4)])
    found = lambda: sorted(map(str, decontaminate.leaks(docs, held).collect()))
    whole = found()
    assert len(whole) >= 16
    monkeypatch.setattr(decontaminate, "SENT", 1000)
    assert found() == whole


def test_token_allocation():
    tokens, bounds = np.array([0, 3, 8, 9, 12]), np.array([0, 4, 10, 12])
    counts = lambda rule: token_counts.allocate(tokens, bounds, rule)[0].tolist()
    assert counts("start") == [2, 2, 0] and counts("majority") == [1, 2, 1]
    np.testing.assert_allclose(counts("split"), [1.2, 0.8 + 1 + 1 / 3, 2 / 3])
    assert token_counts.allocate(tokens, bounds, "start")[1] == 2


def test_token_counts_cover_texts(spark, odd_docs):
    t = defaultdict(list)
    for r in odd_docs.collect():
        t[r["doc_id"]].append(r["text"] or "")
    for rule in token_counts.RULES:
        for r in token_counts.token_counts(odd_docs, rule=rule).collect():
            (x,) = t[r["doc_id"]]
            assert sum(r["section_tokens"]) == pytest.approx(r["n_tokens"])
            assert r["section_ends"] == [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", x)]
            assert r["n_chars"] == len(x)
    with pytest.raises(ValueError):
        token_counts.token_counts(odd_docs, rule="other")


def test_tokens_are_those_of_a_plain_encoder(spark):
    """Merging pair after pair, the least rank first, in each piece of the pattern."""
    import base64

    import regex

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def merged(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)) if len(parts) > 1 else (1 << 60, 0)
            if best[0] == 1 << 60:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    texts = ["It's été\n\n  two  lines\t\nwith 123 numbers!?\n", "a\nb\n\nc", noise(3, 40) + "\n" + noise(4, 30), "北京 😀\n　x", " " * 1_200 + "\n" + " " * 1_100 + "a", "\n" * 1_500]
    for r, t in zip(token_counts.token_counts(made(spark, texts), rule="start").orderBy("doc_id").collect(), texts, strict=True):
        tokens = [x for p in regex.findall(token_counts.PATTERN, t) for x in merged(p.encode())]
        ends = [m.end() for m in regex.finditer(b"\n", t.encode())]
        ends += [len(t.encode())] if not t.endswith("\n") else []
        want, at = [0] * len(ends), 0
        for x in tokens:
            want[next(i for i, e in enumerate(ends) if at < e)] += 1
            at += len(x)
        assert (r["n_tokens"], r["section_tokens"]) == (len(tokens), want)


def test_very_long_white_space(spark):
    texts = [" " * 1_000_000 + "a", "\n" * 300_000, "x" * 300_000]
    got = token_counts.token_counts(made(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_chars"] for r in got] == [1_000_001, 300_000, 300_000]
    assert all(sum(r["section_tokens"]) == r["n_tokens"] for r in got)


def test_scores_need_no_greatest_where_they_are_bounded(monkeypatch):
    p = recurrent.start(1e6 / np.arange(1, recurrent.WORDS + 1), 1e5)
    rng = np.random.default_rng(3)
    words = rng.integers(recurrent.WORDS + 1, size=(9, 32))
    h0, before, valid = np.zeros((9, recurrent.HIDDEN), np.float32), np.full(9, 2), np.ones((9, 32), bool)

    def both(p):
        g = recurrent.zeros(p)
        h, lp = recurrent.gradient(p, words, h0, before, valid, 2, g)
        return h, lp, recurrent.whole(p, g), recurrent.log_prob(p, np.repeat(h, 32, 0), words.ravel())

    plain = both(p)
    assert recurrent._layers(p)[2]
    monkeypatch.setattr(recurrent, "BOUND", 0.0)
    for a, b in zip(plain, both(p), strict=True):
        for k in a if isinstance(a, dict) else [None]:
            np.testing.assert_allclose(a if k is None else a[k], b if k is None else b[k], rtol=1e-3, atol=1e-3)
    monkeypatch.undo()
    large = p | {"class_w": p["class_w"] * 2000, "word_w": p["word_w"] * 2000}
    h, lp, g, of = both(large)
    assert not recurrent._layers(large)[2] and np.isfinite(lp) and np.isfinite(of).all() and all(np.isfinite(x).all() for x in g.values())


def test_workers_of_the_pipeline_hold_little_at_once():
    texts = [noise(i, 400, 20_000) for i in range(4_000)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    rng = np.random.default_rng(1)
    model = {"labels": ["a", "b", "c"], "weights": rng.standard_normal((language.FEATURES, 3)).astype(np.float32), "trans": np.eye(3)}
    sent = lambda x: types.SimpleNamespace(value=x)
    for run, most in ((ngram_join._stats, 90), (ngram_join._prefixes(8, sent(np.zeros(0, np.uint64)), False), 50), (lambda b: language._predict(sent(model), b), 40)):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        assert peak < most, peak
