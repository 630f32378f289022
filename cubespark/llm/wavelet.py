"""Wavelet matrix of a token sequence: bit planes with rank and select, in one compressed file."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVM2"
#: Tokens between two entries of a plane's rank directory.
STEP = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _directory(plane: np.ndarray) -> np.ndarray:
    pad = np.zeros(-len(plane) % (STEP // 8), np.uint8)
    per = _ONES[np.concatenate((plane, pad))].reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64)
    return np.concatenate(([0], np.cumsum(per))).astype("<i8")


def build(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of one shard: header, documents, and for each bit from the highest a rank directory and a plane.

    Each part is compressed by itself and read when it is first asked for.  ``ends``: where each document's tokens
    end.  A plane holds, in the order that the planes above have made, one bit of each token; tokens with a 0 then go
    before those with a 1, each in order.  Its directory has the ones before every STEP-th bit, and all of them.
    """
    bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    comp = zstandard.ZstdCompressor(level=1)
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    parts = [comp.compress(doc_ids.astype("<i8").tobytes()), comp.compress(ends.astype("<i8").tobytes())]
    for b in range(bits - 1, -1, -1):
        one = (seq >> b & 1).astype(bool)
        plane = np.packbits(one)
        parts += [comp.compress(_directory(plane).tobytes()), comp.compress(plane.tobytes())]
        seq = np.concatenate((seq.take(np.flatnonzero(~one)), seq.take(np.flatnonzero(one))))  # far faster than seq[one]
    head = struct.pack("<4sQQI", MAGIC, len(ids), len(doc_ids), bits)
    return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class WaveletMatrix:
    """Reads a file of ``build``: token access, counting and occurrences without decoding the sequence."""

    def __init__(self, data: bytes):
        magic, self.n, docs, self.bits = struct.unpack_from("<4sQQI", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = struct.calcsize("<4sQQI")
        sizes = struct.unpack_from(f"<{2 + 2 * self.bits}Q", data, at)
        at += 8 * len(sizes)
        self._parts: list[bytes | np.ndarray] = []
        for size in sizes:
            self._parts.append(data[at : at + size])
            at += size
        self.doc_ids, self.ends = self._part(0, "<i8"), self._part(1, "<i8")
        if len(self.doc_ids) != docs:
            raise ValueError("a wavelet matrix file with other documents than its header says")

    def _part(self, i: int, kind: str) -> np.ndarray:
        if isinstance(self._parts[i], bytes):
            self._parts[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._parts[i]), kind)
        return self._parts[i]

    def _ranks(self, level: int) -> np.ndarray:
        return self._part(2 + 2 * level, "<i8")

    def _plane(self, level: int) -> np.ndarray:
        return self._part(3 + 2 * level, "u1")

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        r, p = self._ranks(level), self._plane(level)
        n = int(r[i // STEP])
        a, b = i // STEP * (STEP // 8), i // 8
        n += int(_ONES[p[a:b]].sum())
        return n + (bin(p[b] >> (8 - i % 8)).count("1") if i % 8 else 0)

    def _zeros(self, level: int) -> int:
        return self.n - int(self._ranks(level)[-1])

    def _bit(self, level: int, i: int) -> int:
        return int(self._plane(level)[i // 8] >> (7 - i % 8) & 1)

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            v = v << 1 | bit
            i = self._zeros(level) + ones if bit else i - ones
        return v

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                z = self._zeros(level)
                lo, hi = z + a, z + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` stands at places ``lo`` to ``hi``, the end excluded."""
        hi = self.n if hi is None else min(hi, self.n)
        if token >> self.bits or hi <= lo:
            return 0
        a, b = self._range(token, lo, hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before place ``i``."""
        return self.count(token, 0, i)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the ``k``-th (from 0) such bit of a plane."""
        r = self._ranks(level)
        counts = r if bit else np.minimum(np.arange(len(r)) * STEP, self.n) - r
        block = int(np.searchsorted(counts, k, side="right")) - 1
        p = self._plane(level)[block * (STEP // 8) : (block + 1) * (STEP // 8)]
        places = np.flatnonzero(np.unpackbits(p)[: self.n - block * STEP] == bit)
        return block * STEP + int(places[k - int(counts[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of ``token``; IndexError where it has fewer."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            z = self._zeros(level)
            i = self._select(level, 1, i - z) if token >> (self.bits - 1 - level) & 1 else self._select(level, 0, i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """The whole sequence: the planes undone from the lowest."""
        v = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for b in range(self.bits):
            one = np.unpackbits(self._plane(self.bits - 1 - b), count=self.n).astype(bool)
            ones, up = np.flatnonzero(one), np.empty_like(v)
            z = self.n - len(ones)
            up.put(np.flatnonzero(~one), v[:z])
            up.put(ones, v[z:] | v.dtype.type(1 << b))
            v = up
        return v
