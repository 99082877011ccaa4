"""Hashes of words and word shingles for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit number for each byte value at each of 64 places; a word's hash is the mixed sum over its bytes.
_TABLE = _RNG.integers(0, 1 << 63, 64 * 256, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 64 * 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but digits and lower-case letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of texts (bytes, lower-cased in ASCII here), separated as ``separator`` says: doc, start, length and hash of each."""

    def __init__(self, texts: list[bytes], separator: np.ndarray, prefixes: tuple[int, ...] = ()):
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        inside = ~separator[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, stop = edge[::2], edge[1::2]
        self.length = stop - self.start
        self.doc = np.searchsorted(ends, self.start, "right")
        #: words[bounds[i]:bounds[i + 1]] are those of text i
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.prefix_hash: list[np.ndarray] = []
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            self.prefix_hash = [self.hash for _ in prefixes]
            return
        at = np.cumsum(self.length) - self.length
        place = np.arange(int(self.length.sum()), dtype=np.int64) - np.repeat(at, self.length)
        value = _TABLE[(place & 63) << 8 | data[inside]]
        if self.length.max() > 64:
            value *= _ODD[np.minimum(place >> 6, 63)] + (place >> 6).astype(np.uint64) * np.uint64(2)
        self.hash = mix(np.add.reduceat(value, at) + self.length.astype(np.uint64) * _GOLDEN)
        for n in prefixes:
            cut = np.minimum(self.length, n)
            self.prefix_hash.append(mix(np.add.reduceat(np.where(place < n, value, np.uint64(0)), at) + cut.astype(np.uint64) + np.uint64(n << 32)))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's ``n``-word shingles; a shorter text's whole sequence is its one shingle."""
    words = Words(texts, SPACES)
    h = words.hash
    rolled = sum((h[i : len(h) - n + 1 + i] * _ODD[i] for i in range(n)), np.uint64(0)) if len(h) >= n else np.zeros(0, np.uint64)
    rolled = mix(rolled)
    sets = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= n:
            sets.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            sets.append(mix((h[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
