"""Hashes of words and shingles of whole texts, vectorised over a document's bytes.

A word is a run of ``[^\\x20\\x09-\\x0D]``. A word's hash is a polynomial over its UTF-8 bytes modulo
2^64 with its length mixed in, so all words of a document come from one prefix sum.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CACHE: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _CACHE.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:  # very long texts compute their own
            _CACHE[name] = have
    return have[:n]


def word_hashes(text: str | None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start bytes, end bytes) of the words of a text; A-Z are lower-cased first."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if lower:
        data = data.lower()
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    inside = ~_SPACE[a]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(a), "up"), out=prefix[1:])
    value = (prefix[end] - prefix[start]) * _powers(_INVERSE, len(a) + 1, "down")[start]
    return mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order; of the whole sequence if there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0xA0761D6478BD642F) + words[i : len(words) - n + 1 + i])
    return out


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingles(word_hashes(text)[0], n))
