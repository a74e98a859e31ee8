"""Words of many texts at once, as NumPy arrays.

A word is a run of letters, digits and combining marks; an ideograph or kana is a word of its own. Words are compared
in lower case by a 64-bit hash.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

_TABLES: tuple[np.ndarray, np.ndarray] | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_LIMIT = 0x20000  # code points with tables; those above are words of their own if letters, which nearly all are
_POWERS = np.ones((2, 1), dtype=np.uint64)  # of the base, and of its inverse modulo 2**64


def _kind(c: str) -> int:
    cat = unicodedata.category(c)
    if cat[0] in "LNM":
        o = ord(c)
        return 2 if cat == "Lo" and (0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF) else 1
    return 0


def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the kind (0 between words, 1 part of a word, 2 a word) and the lower case where that is one character."""
    global _TABLES
    if _TABLES is None:
        kind = np.full(_LIMIT + 1, 2, dtype=np.uint8)
        lower = np.arange(_LIMIT + 1, dtype=np.uint32)
        for i in range(_LIMIT):
            if 0xD800 <= i < 0xE000:
                kind[i] = 0
                continue
            c = chr(i)
            kind[i] = _kind(c)
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        _TABLES = kind, lower
    return _TABLES


def forget() -> None:
    """Leaves what was made for texts so far."""
    global _POWERS
    _POWERS = _POWERS[:, :1].copy()


def powers(n: int) -> np.ndarray:
    global _POWERS
    if _POWERS.shape[1] < n:
        p = np.ones((2, n + n // 8), dtype=np.uint64)
        p[0, 1:] = _BASE
        p[1, 1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS = np.multiply.accumulate(p, axis=1)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats. (np.unique hashes, which is far slower for many different values.)"""
    return counted(np.sort(values))[0]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted values and how often each is there."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.concatenate([first, [len(values)]]))


@dataclass
class Words:
    """Of all texts: each word's hash, text (index) and place (first character, one past the last, in the text)."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lower: np.ndarray  # code points of all texts, one separator after each
    offset: np.ndarray  # where each text begins in lower
    n: int


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, with a separator (0) after each, and where each begins."""
    parts = [t or "" for t in texts]
    lengths = np.fromiter((len(t) for t in parts), dtype=np.int64, count=len(parts))
    offset = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=offset[1:])
    cps = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if parts else np.zeros(0, np.uint32)
    return cps, offset


def words(texts: list[str | None]) -> Words:
    cps, offset = codepoints(texts)
    kind_of, lower_of = tables()
    high = len(cps) > 0 and int(cps.max()) >= _LIMIT
    capped = np.minimum(cps, np.uint32(_LIMIT)) if high else cps
    kind = kind_of.take(capped)
    lower = lower_of.take(capped)
    if high:
        lower = np.where(capped == _LIMIT, cps, lower)
    inside = kind > 0
    begins = inside.copy()
    begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
    start = np.flatnonzero(begins)
    if not len(start):
        z = np.zeros(0, dtype=np.int64)
        return Words(z.astype(np.uint64), z, z, z, lower, offset, len(texts))
    inside[:-1] &= ~inside[1:] | begins[1:]  # now each word's last character
    end = np.flatnonzero(inside) + 1
    up, down = powers(len(cps) + 1)
    sums = np.zeros(len(cps) + 1, dtype=np.uint64)
    np.cumsum((lower + np.uint32(1)) * up[: len(cps)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    counts = np.diff(np.searchsorted(start, offset))
    doc = np.repeat(np.arange(len(texts)), counts)
    begin = offset[doc]
    return Words(h, doc, start - begin, end - begin, lower, offset, len(texts))


def hash_word(word: str) -> int:
    """words()'s hash of one word in lower case."""
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
    h = sum((c + 1) * pow(int(_BASE), i, 1 << 64) for i, c in enumerate(low)) + len(low)
    return int(mix(np.array([h & _MASK], dtype=np.uint64))[0])


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of n words. A text of fewer words has one: all of them. A text of none has the one of no words."""
    counts = np.bincount(w.doc, minlength=w.n) if len(w.doc) else np.zeros(w.n, dtype=np.int64)
    firsts = np.zeros(w.n + 1, dtype=np.int64)
    np.cumsum(counts, out=firsts[1:])
    total = len(w.hash)
    keep = max(total - n + 1, 0)
    h = np.zeros(keep, dtype=np.uint64)
    for i in range(n):
        h += w.hash[i : i + keep] * np.uint64((0xD6E8FEB86659FD93 * (2 * i + 1)) & _MASK)
    whole = w.doc[:keep] == w.doc[n - 1 : n - 1 + keep] if keep else np.zeros(0, dtype=bool)
    hashes, docs = mix(h[whole]), w.doc[:keep][whole]
    short = np.flatnonzero(counts < n)
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k, d in enumerate(short):
            x = np.uint64(0x51ED270B)
            for v in w.hash[firsts[d] : firsts[d + 1]]:
                x = mix(np.array([(int(x) * 31 + int(v)) & _MASK], dtype=np.uint64))[0]
            extra[k] = mix(np.array([x], dtype=np.uint64))[0]
        hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
    return hashes, docs
