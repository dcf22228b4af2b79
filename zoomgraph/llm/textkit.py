"""Vectorised work on whole batches of text: words, hashes and windows as numpy arrays over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters and digits: all other ASCII bytes part them.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at once (some 40 bytes of arrays each, in every worker); one longer document makes a piece of its own.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
#: A second base of windows, for bits that are independent of the first.
SECOND = 0xA0761D6478BD642F | 1
_INV = pow(_P, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n + 1:
        n = max(n, 1 << 16, 2 * len(_powers.get("p", ())))
        for name, base in (("p", _P), ("i", _INV)):
            a = np.full(n + 1, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def pieces(text: pa.Array | pa.ChunkedArray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a string column; null rows are empty."""
    base = 0
    for arr in text.chunks if isinstance(text, pa.ChunkedArray) else [text]:
        if not len(arr):
            continue
        arr = arr.fill_null("") if arr.null_count else arr
        wide = pa.types.is_large_string(arr.type)
        _, offs, data = arr.buffers()
        offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(arr):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            hi = min(hi, len(arr))
            yield base + lo, base + hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi
        base += len(arr)


@dataclass
class Words:
    start: np.ndarray  # byte positions in the piece
    end: np.ndarray
    first: np.ndarray  # for each document the index of its first word, and the number of words
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, by prefix sums of a polynomial."""
    p, inv = _pow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * p[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start])


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Maximal runs without ``space`` (ASCII white space); none crosses from one document into the next."""
    ink = ~space[data]
    n = len(data)
    start, end = ink.copy(), ink.copy()
    if n:
        start[1:] &= ~ink[:-1]
        end[:-1] &= ~ink[1:]
        a, b = offs[:-1], offs[1:]
        some = b > a
        start[a[some]] = ink[a[some]]
        end[b[some] - 1] = ink[b[some] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(s, e, np.searchsorted(s, offs), spans_hash(LOWER[data] if lower else data, s, e))


def windows(h: np.ndarray, first: np.ndarray, k: int, base: int = _Q) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that start a whole window of k words, and the windows' Rabin-Karp hashes to ``base``.

    Longer windows are put together from halves, with the base's powers as weights."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = n - k + 1
    out, at, size, part = np.zeros(m, np.uint64), 0, 1, h
    bits = k
    while bits:
        if bits & 1:
            out = out * np.uint64(pow(base, size, 2**64)) + part[at : at + m]
            at += size
        bits >>= 1
        if bits:
            part = part[:-size] * np.uint64(pow(base, size, 2**64)) + part[size:]
            size *= 2
    last = np.repeat(first[1:], np.diff(first))[:m]
    ok = np.flatnonzero(np.arange(m) + k <= last)
    return ok, mix(out[ok])


def pack7(h: np.ndarray) -> bytes:
    """The low seven bytes of each hash; the top byte is known from the bucket."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpack7(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).reshape(-1, 7)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :7] = x
    return out.view(np.uint64).ravel()


def bucket_bits(units: int, each: int = 1 << 17) -> int:
    """Bits of hash buckets for about ``each`` of the counted units in a bucket; a byte at least."""
    return min(30, max(8, (max(1, units // each) - 1).bit_length()))


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of a sorted array."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.r_[0, cuts], np.r_[cuts, len(key)]
