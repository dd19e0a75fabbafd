"""A wavelet matrix over token ids: one bit plane per binary digit, highest
first; each plane lists the digit of every id in the order left by the plane
above, which moves ids with digit 0 before those with digit 1. With a running
count of ones per block, any id can be read, an id counted in any range and
its occurrences found, without decoding the rest.

File: a fixed header, the documents' ids and lengths, then per plane its bits
and block counts, each part compressed on its own.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK = 512             # bits per block of the rank directory
_HEADER = struct.Struct("<4sIqq")


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


def encode(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard; ``lengths`` are the ids of each document."""
    x = ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)
    bits = 8 * x.itemsize
    parts = [_pack(doc_ids.astype("<i8")), _pack(lengths.astype("<i8"))]
    for b in range(bits - 1, -1, -1):
        ones = (x & x.dtype.type(1 << b)).astype(bool)
        plane = np.packbits(ones, bitorder="little")
        plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
        per_block = np.bitwise_count(plane.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        parts += [_pack(plane), _pack(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4"))]
        if b and (k := int(per_block.sum())) not in (0, len(x)):
            y = np.empty_like(x)
            x.take(np.flatnonzero(~ones), out=y[:-k], mode="clip")      # "clip": without a buffer
            x.take(np.flatnonzero(ones), out=y[-k:], mode="clip")
            x = y
    head = _HEADER.pack(MAGIC, bits, len(ids), len(doc_ids))
    return head + np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)


class WaveletMatrix:
    """A shard's file, opened; planes are unpacked when first used."""

    def __init__(self, blob: bytes):
        magic, self.bits, self.n, self.n_docs = _HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size
        sizes = np.frombuffer(blob, "<i8", 2 + 2 * self.bits, at)
        ends = at + sizes.nbytes + np.cumsum(sizes)
        self._parts = [blob[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    @property
    def doc_ids(self) -> np.ndarray:
        return _unpack(self._parts[0], "<i8")

    @property
    def lengths(self) -> np.ndarray:
        return _unpack(self._parts[1], "<i8")

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(bytes, ones before each block, zeros in all) of a plane."""
        if level not in self._planes:
            ranks = _unpack(self._parts[3 + 2 * level], "<u4")
            self._planes[level] = (_unpack(self._parts[2 + 2 * level], np.uint8), ranks, self.n - int(ranks[-1]))
        return self._planes[level]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        plane, ranks, _ = self._plane(level)
        block = i // BLOCK
        rest = np.unpackbits(plane[block * BLOCK // 8:i // 8 + 1], bitorder="little")[:i - block * BLOCK]
        return int(ranks[block]) + int(rest.sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self._plane(level)[0][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = 2 * value + bit
            i = self._plane(level)[2] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences in [start, end) lie after all planes."""
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self._plane(level)[2] + a, self._plane(level)[2] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in [start, end)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _position(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) digit ``bit`` in a plane."""
        plane, ranks, _ = self._plane(level)
        before = ranks if bit else np.arange(len(ranks), dtype=np.int64) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        digits = np.unpackbits(plane[block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(digits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of a token."""
        start, end = self._range(token, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._position(level, bit, at - self._plane(level)[2] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.bits == 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            plane, _, zeros = self._plane(level)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            if zeros == self.n:
                continue
            out = np.empty_like(x)
            out[np.flatnonzero(~ones)] = x[:zeros]
            out[np.flatnonzero(ones)] = x[zeros:] | kind(1 << (self.bits - 1 - level))
            x = out
            del self._planes[level]
        return x
