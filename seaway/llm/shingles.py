"""Word shingles of texts as 64-bit hashes, made without Python objects per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 20  # bytes hashed at a time; a longer word is hashed whole
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(size, np.uint64(b), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a whole text, A-Z lower-cased, in text order."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    out, at = [], 0
    while at < len(data):
        stop = at + SEGMENT
        if stop < len(data):  # cut behind a blank, or at the end of a word longer than the segment
            b = np.frombuffer(data, np.uint8, SEGMENT, at)
            blanks = np.flatnonzero(_SPACE[b])
            if len(blanks):
                stop = at + int(blanks[-1]) + 1
            else:
                while stop < len(data) and not _SPACE[data[stop]]:
                    stop += 1
        b = np.frombuffer(data, np.uint8, min(stop, len(data)) - at, at)
        at += len(b)
        blank = _SPACE[b]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        edge = np.concatenate([np.zeros(0 if blank[0] else 1, np.int64), edge, np.full(0 if blank[-1] else 1, len(b))])
        start, end = edge[0::2], edge[1::2]
        size = 1 << max(12, int(len(b)).bit_length())
        up, down = _powers(size)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
        out.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingles of ``words`` words; a shorter text is one shingle, a text without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    h = w[: len(w) - n + 1]
    for j in range(1, n):
        h = mix(h) * np.uint64(0xD1342543DE82EF95) + w[j : len(w) - n + 1 + j]
    return np.unique(mix(h + np.uint64(n)))
