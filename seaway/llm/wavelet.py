"""A wavelet matrix: a sequence of ids as bit planes that answer access, rank, select and counting (Claude & Navarro 2012).

Plane by plane from the highest bit, the sequence is sorted stably by that bit. A plane is one bit per id plus one count per
512 bits, so the structure is about the size of the packed ids, and every answer needs one step per plane.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"SWM1"
BLOCK = 512  # bits between stored counts


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.counts, self.zeros = n, planes, counts, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        x = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes, counts, zeros = [], [], []
        for level in range(depth - 1, -1, -1):
            bit = (x >> x.dtype.type(level)) & x.dtype.type(1)
            one = bit.astype(bool)
            plane, count = cls._packed(one)
            planes.append(plane)
            counts.append(count)
            low = x[~one]
            zeros.append(len(low))
            x = np.concatenate([low, x[one]])
        return cls(len(ids), planes, counts, zeros)

    @staticmethod
    def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (len(bits) // BLOCK + 1) * BLOCK // 8
        plane = np.zeros(size, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        plane[: len(packed)] = packed
        ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return plane, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, np.int64)
        block = at // BLOCK
        words = self.planes[level].view(np.uint64)
        total = self.counts[level][block].astype(np.int64)
        first, last = block * (BLOCK // 64), at // 64
        for k in range(BLOCK // 64 - 1):
            inside = first + k < last
            total += np.where(inside, np.bitwise_count(words[np.minimum(first + k, len(words) - 1)]), 0)
        part = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
        return total + np.bitwise_count(words[np.minimum(last, len(words) - 1)] & part)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def access(self, at) -> np.ndarray:
        """The ids at the positions."""
        at = np.array(at, np.int64, ndmin=1)
        out = np.zeros(len(at), np.uint32)
        for level in range(len(self.planes)):
            bit = self._bit(level, at)
            ones = self._rank1(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out << np.uint32(1) | bit.astype(np.uint32)
        return out

    def rank(self, value: int, at) -> np.ndarray:
        """How often ``value`` occurs before each position."""
        stop = np.array(at, np.int64, ndmin=1)
        start = np.zeros_like(stop)
        if value < 0 or value >> len(self.planes):
            return np.zeros(len(stop), np.int64)
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return stop - start

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often ``value`` occurs in [start, stop)."""
        a, b = self.rank(value, [start, self.n if stop is None else stop])
        return int(b - a)

    def select(self, value: int, number: int) -> int:
        """The position of occurrence ``number`` (from 0) of ``value``; -1 if there are not so many."""
        return next(iter(self.occurrences(value, number, number + 1)), -1)

    def occurrences(self, value: int, first: int = 0, stop: int | None = None) -> np.ndarray:
        """The positions of occurrences ``first`` to ``stop`` of ``value``, ascending."""
        total = self.count(value)
        at = np.arange(first, total if stop is None else min(stop, total))
        if not len(at):
            return at
        start = np.zeros(1, np.int64)
        for level in range(len(self.planes)):
            a = self._rank1(level, start)
            start = self.zeros[level] + a if value >> (len(self.planes) - 1 - level) & 1 else start - a
        at = at + start[0]
        for level in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if one else at, bool(one))
        return at

    def _select(self, level: int, number: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the ones (or zeros) with the given numbers: the block by its count, then bit by bit inside it."""
        counts = self.counts[level].astype(np.int64)
        if not one:
            counts = np.arange(len(counts)) * BLOCK - counts
        block = np.searchsorted(counts, number, side="right") - 1
        left = number - counts[block]
        out = np.empty(len(number), np.int64)
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8), axis=1, bitorder="little") if len(number) > 64 else None
        for i, (b, k) in enumerate(zip(block, left, strict=True)):
            row = bits[b] if bits is not None else np.unpackbits(self.planes[level][b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")
            out[i] = b * BLOCK + np.flatnonzero(row if one else row == 0)[k]
        return out

    def to_array(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest to the highest bit."""
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], bitorder="little")[: self.n].astype(bool)
            out = np.empty_like(x)
            out[~one] = x[: self.zeros[level]]
            out[one] = x[self.zeros[level] :] | x.dtype.type(1 << (len(self.planes) - 1 - level))
            x = out
        return x

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QB", self.n, len(self.planes)) + np.array(self.zeros, "<u8").tobytes()
        return head + b"".join(c.astype("<u4").tobytes() for c in self.counts) + b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, depth = struct.unpack_from("<QB", data, 4)
        at = 13
        zeros = np.frombuffer(data, "<u8", depth, at).astype(int).tolist()
        at += 8 * depth
        size = n // BLOCK + 1
        counts = []
        for _ in range(depth):
            counts.append(np.frombuffer(data, "<u4", size + 1, at))
            at += 4 * (size + 1)
        planes = [np.frombuffer(data, np.uint8, size * BLOCK // 8, at + i * size * BLOCK // 8).copy() for i in range(depth)]
        return cls(n, planes, counts, zeros)
