"""Token counts of a document's sections, attributed by character offsets.

Every whole text is encoded once. The tokens' bytes give their character spans; spans are joined with the
sections' intervals, and a token that crosses a boundary is allocated by a rule:

- ``start``: to the section that holds its first character,
- ``majority``: to the section that holds most of its bytes, of equals the first,
- ``split``: to each section in the share of its bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level vocabularies split a text before merging; a fixed value of theirs.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of the pattern, from this many characters on: the pattern's engine steps back through such a run, on a stack
#: that overflows on very long ones.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
RULES = ("start", "majority", "split")
_made: dict[int, tuple] = {}


def encoder(ranks: bytes):
    """Encoder and the byte length of every token; made once in a worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _made:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        size = np.zeros(max(merges.values()) + 1, np.int64)
        for t, i in merges.items():
            size[i] = len(t)
        _made[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}), size
    return _made[key]


def encode(encoding, text: str) -> list[int]:
    """The tokens of a whole text, as the encoder itself gives them.

    Where white space ends the text the pattern takes it as one piece; before anything else it takes all but its
    last character as one piece, and goes on from that one. Long runs are cut by this rule beforehand."""
    out, at = [], 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def lines(raw: np.ndarray) -> np.ndarray:
    """Byte boundaries of the sections of a text: its lines, each with its line feed."""
    at = np.flatnonzero(raw == 10) + 1
    return np.r_[0, at[at < len(raw)], len(raw)] if len(raw) else np.zeros(1, np.int64)


def allocate(tokens: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and how many cross. tokens, bounds: byte positions, both covering the text.

    Both are sorted, so the interval join is one merge: cut tokens at the bounds, look up each piece."""
    n = max(0, len(bounds) - 1)
    if len(tokens) < 2 or not n:
        return np.zeros(n), 0
    cuts = np.union1d(tokens, bounds)
    size = np.diff(cuts)
    token = np.searchsorted(tokens, cuts[:-1], "right") - 1
    section = np.searchsorted(bounds, cuts[:-1], "right") - 1
    pieces = np.bincount(token, minlength=len(tokens) - 1)
    crossing = int((pieces > 1).sum())
    if rule == "split":
        return np.bincount(section, size / np.diff(tokens)[token], n), crossing
    first = np.r_[True, token[1:] != token[:-1]]
    if rule == "majority" and crossing:
        order = np.lexsort((section, -size, token))
        first = np.zeros(len(token), bool)
        first[order[np.r_[True, token[order][1:] != token[order][:-1]]]] = True
    return np.bincount(section[first], minlength=n).astype(float), crossing


SCHEMA = "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, section_ends array<long>, section_tokens array<double>"


def _count(ranks, rule: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoding, size = encoder(ranks.value)
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            raw = np.frombuffer(text.encode(), np.uint8)
            ids = np.array(encode(encoding, text), np.int64)
            tokens = np.r_[0, np.cumsum(size[ids])]
            bounds = lines(raw)
            # bounds lie between characters; a token may begin or end within one
            chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            counts, crossing = allocate(tokens, bounds, rule)
            rows.append((len(text), len(ids), len(bounds) - 1, crossing, chars[bounds[1:]].tolist(), np.round(counts, 6).tolist()))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_chars", "n_tokens", "n_sections", "n_crossing", "section_ends", "section_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """One row for each row of docs: characters, tokens, sections, tokens that cross, and of every section
    where it ends (in characters) and its tokens. They sum to n_tokens under each rule.

    Null and empty texts have no tokens and no sections. A null doc_id is kept, repeated rows are counted
    each, further columns are not carried. No shuffle; the vocabulary is read by the driver and sent."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lambda b: _count(ranks, rule, b), SCHEMA)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
