"""Word and shingle hashes of whole batches of texts with numpy (no Python step per word)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(2)
def _byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value per byte; A-Z have those of a-z; separators have 0."""
    v = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed))
    v[65:91] = v[97:123]
    v[list(WHITE)] = 0
    return v


class Powers:
    """Powers of an odd number modulo 2^64 and their inverses, grown as needed."""

    def __init__(self, base: int = _BASE):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            back = pow(self.base, -1, 1 << 64)
            for name, b in (("up", self.base), ("down", back)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes that are not white space, A-Z lower-cased) and the words per text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    space = np.zeros(256, bool)
    space[list(WHITE)] = True
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~space[buf]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = POWERS.to(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_values(0)[buf] * up[:-1], out=total[1:])
    h = (total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return mix64(h), np.diff(np.searchsorted(begin, edges))


def word_counts(texts: list[bytes]) -> np.ndarray:
    """The words per text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = np.zeros(256, bool)
    space[list(WHITE)] = True
    blank = space[buf]
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # the byte after a word; the join ends every text with a blank
    return np.diff(np.searchsorted(ends, np.cumsum([0] + [len(t) + 1 for t in texts])))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words (repeats included) and their number per text; a shorter text that
    has words is one shingle."""
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    upto = np.cumsum(n)
    start = np.repeat(first - (upto - n), n) + np.arange(int(n.sum()))
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    factors = [np.uint64(int(mix64(np.array([77 + k], np.uint64))[0]) | 1) for k in range(size)]
    every = padded[:len(words)].copy()  # from each word on, also beyond its text
    every *= factors[0]
    for k in range(1, size):
        every += padded[k:k + len(words)] * factors[k]
    h = every[start] + np.uint64(size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    own = counts[short].astype(np.uint64)
    for k in range(size):
        own += np.where(counts[short] > k, padded[first[short] + k] * factors[k], np.uint64(0))
    h[(upto - n)[short]] = own
    return mix64(h), n
