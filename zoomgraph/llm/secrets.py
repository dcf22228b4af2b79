"""Secret scan with one combined deterministic automaton.

All rules are compiled together to a minimal automaton (automaton.py) that reads every byte of every text
once, from the last to the first, and so tells at which bytes a match of which rule begins. From the leftmost
beginning that no match before it covers, the rule's own automaton goes forward to the longest match's end: only bytes
of matches are read again. In the rules no two ways of matching end differently, so the longest match is
that of the expression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton
from .common import table
from .textkit import pieces


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
_GAP = r"""["']?\x20*[:=]\x20*["']?"""
#: kind -> (expression, group whose length counts, least length); the first three are the base kinds.
RULES = {
    "assign": (_KEY + _GAP + "([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
    "github": ("gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
}
#: What the combined automaton looks for: the rules, but for the one whose matches are whole runs, and so reach their
#: least length or none of their beginnings does.
FOUND = [{"hex": "[0-9a-f]{32}"}.get(name, pattern) for name, (pattern, _, _) in RULES.items()]
#: What comes before the group whose length counts.
HEADS = {"assign": _KEY + _GAP}
BASE = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _shown(found) -> str:
    names = list(RULES)
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)


@cache
def compiled() -> tuple[Automaton, list[Automaton], dict[int, Automaton]]:
    """The combined automaton, each rule's own, and those of the rules' heads by the rule's place."""
    alone = lambda p: Automaton([p], anywhere=False)
    return Automaton(FOUND, backward=True), [alone(p) for p, _, _ in RULES.values()], {list(RULES).index(n): alone(p) for n, p in HEADS.items()}


def spans(automata, data: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each document of a piece that has any: (start, place of the kind, end) of the rules' matches, in code points."""
    every, own, heads = automata
    n, out = len(data), {}
    at, mask = every.hits(data[::-1], n - offs[::-1])
    at, mask = (n - 1 - at)[::-1], mask[::-1]
    doc = np.searchsorted(offs, at, "right") - 1
    for d in np.unique(doc):
        here, lo, hi = doc == d, int(offs[d]), int(offs[d + 1])
        raw, found = data[lo:hi].tobytes(), []
        for k, (_, _, least) in enumerate(RULES.values()):
            begins = at[here & (mask >> k & 1 > 0)] - lo
            i = 0
            while i < len(begins):
                s = int(begins[i])
                e = own[k].longest(raw, s, hi - lo)
                if e - (heads[k].longest(raw, s, e) if k in heads else s) >= least:
                    found.append((s, k, e))
                i = int(np.searchsorted(begins, e))
        if found:
            chars = np.r_[0, np.cumsum((data[lo:hi] & 0xC0) != 0x80)]
            out[int(d)] = sorted((int(chars[s]), k, int(chars[e])) for s, k, e in found)
    return out


def _scan(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automata = sent.value
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        counts, sha, shown = [[], [], []], [], []
        for lo, hi, data, offs in pieces(batch.column(1)):
            all_found = spans(automata, data, offs)
            for j in range(hi - lo):
                found = all_found.get(j, [])
                base = [x for x in found if x[1] < len(BASE)]
                for k in range(len(BASE)):
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(_shown(base).encode()).hexdigest() if base else nothing)
                shown.append(_shown(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(shown, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for every row of docs: counts of the base kinds, a digest of their spans, and all spans.

    Null and empty texts have none. A null doc_id is kept and repeated rows are scanned each. Further
    columns are not carried. No shuffle: texts are scanned where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(compiled())
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lambda batches: _scan(sent, batches), SCHEMA)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda x: x.replace("'", "''")
    parts = []
    for k, (name, (pattern, group, least)) in enumerate(RULES.items()):
        p = quote(pattern)
        parts.append(f"""SELECT * FROM (SELECT doc_id, {k} AS k, '{name}' AS kind,
            unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'm': m[i], 'g': g[i]}})) AS x
            FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g, regexp_split_to_array(text, '{p}') AS p FROM documents WHERE regexp_matches(text, '{p}')))
            WHERE length(x.g) >= {least}""")
    union = "\n    UNION ALL ".join(parts)
    return f"""
WITH found AS ({union}),
    f AS (SELECT doc_id, k, x.s::BIGINT AS s, kind || ':' || x.s::BIGINT || ':' || (x.s + length(x.m))::BIGINT AS shown FROM found),
    a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(shown, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(shown, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""


OP9_SQL = _sql()
