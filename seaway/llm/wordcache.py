"""Tokens of texts by way of their distinct words: words are found and hashed as arrays, and each is encoded once while it stays in a bounded cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

from seaway.llm.shingles import mix

BYTES = 1 << 20  # text bytes hashed at a time
_STEP, _BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_RANDOM = np.random.default_rng(5).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(BYTES + 1, np.uint64(_STEP)), np.full(BYTES + 1, np.uint64(_BACK))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def between_blanks(buffer: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes other than spaces and line feeds. Texts in the buffer are parted by line feeds."""
    word = np.concatenate([[False], (buffer != 32) & (buffer != 10), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def with_blanks(buffer: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A new word at every run of spaces, line feed and text start, so that the words tile the buffer."""
    space = buffer == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start |= buffer == 10
    start[docs[docs < len(buffer)]] = True
    at = np.flatnonzero(start)
    return at, np.append(at[1:], len(buffer))


class WordCache:
    """Word to ids for words given as byte ranges, at most ``size`` words at a time.

    A word is known by two independent 64-bit hashes. When the cache is full, words that were not met again are dropped; no
    word is ever left out of a result, at worst it is encoded again. ``encode``: a list of words to (ids one after the other,
    number of ids of each word).
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], segments=between_blanks, lead: bytes = b"", part: bytes = b"\n", size: int = 1 << 20):
        self.encode, self.segments, self.lead, self.part, self.size = encode, segments, lead, part, size
        self._clear()

    def _clear(self) -> None:
        """``keys`` ascending, ``slot`` their entries; entry i has ``check[i]``, whether it was ``met`` again, and ``ids[start[i] : start[i + 1]]``."""
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.check, self.met = np.zeros(self.size, np.uint64), np.zeros(self.size, bool)
        self.start, self.count, self.ids = np.zeros(self.size + 1, np.int64), 0, np.zeros(1 << 16, np.int32)

    def _hashes(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers()
        base, out, length = int(start[0]), [], (end - start).astype(np.uint64)
        part = buffer[base : int(end[-1])]
        for table in _RANDOM:
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * up[: len(part)], out=total[1:])
            out.append(mix((total[end - base] - total[start - base]) * down[start - base] + length))
        return out[0], out[1]

    def _add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        if self.count + len(keys) > self.size:
            keep = np.flatnonzero(self.met[self.slot])
            keep = keep if len(keep) <= self.size // 2 else keep[:0]
            old_keys, old, start, check, held = self.keys[keep], self.slot[keep], self.start, self.check, self.ids
            self._clear()
            lengths = start[old + 1] - start[old]
            ends = np.cumsum(lengths)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[old] - (ends - lengths), lengths)
            self._add(old_keys, check[old], held[take], lengths)
        first, stop, used = self.count, self.count + len(keys), int(self.start[self.count])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[used : used + len(ids)] = ids
        self.start[first + 1 : stop + 1] = used + np.cumsum(n)
        self.check[first:stop], self.count = checks, stop
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, np.arange(first, stop, dtype=np.int32))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, found or not) of ascending keys."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.slot[at], self.keys[at] == keys

    def _some(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in order, number of ids of each word) for words within ``BYTES`` of each other."""
        words = lambda at: [buffer[s:e].tobytes().decode("utf-8", "surrogatepass") for s, e in zip(start[at], end[at], strict=True)]
        if end[-1] - start[0] > BYTES:  # one very long word
            return self.encode(words(np.zeros(1, np.int64)))
        key, check = self._hashes(buffer, start, end)
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        entry, known = self._find(uniq)
        self.met[entry[known]] = True
        while not known.all():  # a second time only if the first made room by dropping some
            new = np.flatnonzero(~known)[: self.size // 2]
            self._add(uniq[new], check[first[new]], *self.encode(words(first[new])))
            entry, known = self._find(uniq)
            self.met[entry[known]] |= len(new) == self.size // 2
        entry = entry[inverse]
        n = self.start[entry + 1] - self.start[entry]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[entry] - (ends - n), n)]
        odd = np.flatnonzero(self.check[entry] != check)
        if not len(odd):
            return ids, n
        parts = np.split(ids, ends[:-1])  # another word has the same first hash: encode these by themselves
        for i in odd:
            parts[i], _ = self.encode(words(np.array([i])))
            n[i] = len(parts[i])
        return np.concatenate(parts), n

    def encode_texts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order. Short texts share a buffer; long ones are worked on in parts between words."""
        held: list[bytes] = []
        size = 0
        for t in texts:
            held.append((self.lead + t.encode("utf-8", "surrogatepass") if t else b"") + self.part)
            size += len(held[-1])
            if size >= BYTES:
                yield from self._flush(held)
                held, size = [], 0
        if held:
            yield from self._flush(held)

    def _flush(self, held: list[bytes]) -> Iterator[np.ndarray]:
        buffer = np.frombuffer(b"".join(held), np.uint8)
        docs = np.concatenate([[0], np.cumsum([len(h) for h in held])])
        start, end = self.segments(buffer, docs)
        if not len(start):
            yield from (np.zeros(0, np.int32) for _ in held)
            return
        ids, counts, at = [], [], 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(end, start[at] + BYTES, side="right")))
            x, n = self._some(buffer, start[at:stop], end[at:stop])
            ids.append(x)
            counts.append(n)
            at = stop
        flat = np.concatenate(ids)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        word = ends[np.searchsorted(start, docs)]
        for i in range(len(held)):
            yield flat[word[i] : word[i + 1]]
