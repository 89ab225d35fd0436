"""Elias-Fano sequences in numpy: compact, memory-mapped, with batched access and successor search."""

from __future__ import annotations

import os
import uuid

import numpy as np

U1 = np.uint64(1)
_M1, _M2, _M4 = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))
_ONES, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_IN_BYTE = np.zeros(2048, np.int64)  # place of the r-th one of a byte, at 8 * byte + r
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _IN_BYTE[8 * _b + _r] = _p


def _bits(n: int) -> int:
    return max(0, int(n).bit_length())


class EliasFano:
    """A non-decreasing sequence of unsigned integers under 2**63.

    Low bits are packed; high bits are a unary bit vector with the count of ones before each word, so that access is a
    select of ones and a successor search is a select of zeros and a search inside one bucket.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.l, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        l = max(0, _bits(top // max(n, 1)) - 1) if n else 0
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if l:
            mask = (U1 << np.uint64(l)) - U1
            x = v & mask
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, w, x << s)
            over = np.flatnonzero(s + np.uint64(l) > 64)
            np.bitwise_or.at(low, w[over] + 1, x[over] >> (np.uint64(64) - s[over]))
        pos = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        size = (top >> l) + n + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[pos] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls(n, l, low, high, ones)

    def save(self, path: str) -> None:
        head = np.array([self.n, self.l, len(self.low), len(self.high)], np.uint64)
        with open(path, "wb") as f:
            for a in (head, self.low, self.high, self.ones):
                f.write(np.ascontiguousarray(a).tobytes())

    @classmethod
    def load(cls, path: str) -> EliasFano:
        a = np.memmap(path, np.uint64, "r").view(np.ndarray)
        n, l, nl, nh = (int(x) for x in a[:4])
        return cls(n, l, a[4 : 4 + nl], a[4 + nl : 4 + nl + nh], a[4 + nl + nh : 4 + nl + 2 * nh + 1].view(np.int64))

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[w] >> s
        over = np.flatnonzero(s > np.uint64(64 - self.l))  # the others lie in one word
        x[over] |= self.low[w[over] + 1] << (np.uint64(64) - s[over])
        return x & ((U1 << np.uint64(self.l)) - U1)

    @staticmethod
    def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Position of the r-th one of each word: byte sums at once in the word's bytes, then a table for the byte."""
        s = x - ((x >> U1) & _M1)
        s = (s & _M2) + ((s >> np.uint64(2)) & _M2)
        s = ((s + (s >> np.uint64(4))) & _M4) * _ONES  # ones up to the end of each byte
        r = r.astype(np.uint64)
        byte = np.bitwise_count((((r * _ONES) | _HIGH) - s) & _HIGH).astype(np.uint64)  # bytes whose sum is r at most
        byte = np.minimum(byte, np.uint64(7)) << np.uint64(3)
        before = ((s << np.uint64(8)) >> byte) & np.uint64(255)
        return (byte.astype(np.int64)) + _IN_BYTE[(((x >> byte) & np.uint64(255)) << np.uint64(3)) | ((r - before) & np.uint64(7))]

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions i (each in 0..n-1)."""
        w = np.searchsorted(self.ones, i, "right") - 1
        p = self._select_in_word(self.high[w], i - self.ones[w]) + w * 64
        return ((p - i).astype(np.uint64) << np.uint64(self.l)) | self._low_at(i)

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """Elements before the k-th zero, n beyond the last one."""
        if self.zeros is None:  # zeros up to the end of each word
            self.zeros = 64 * np.arange(1, len(self.ones)) - self.ones[1:]
        lo = np.searchsorted(self.zeros, k, "right")  # first word with more than k zeros up to its end
        w = np.minimum(lo, len(self.high) - 1)
        before = self.zeros[w] - 64 + np.bitwise_count(self.high[w])  # zeros before the word
        p = self._select_in_word(~self.high[w], k - before) + w * 64
        return np.where(lo < len(self.high), np.minimum(p - k, self.n), self.n)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first element that is not under x, or n; end of x's bucket of equal high bits)."""
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.l)).astype(np.int64)
        lo = np.where(h > 0, self._ones_before_zero(np.maximum(h - 1, 0)), 0)
        # the bucket is the run of ones behind its zero; a run over a word's length is measured by the next zero
        at = lo + h
        w, k = np.minimum(at >> 6, len(self.high) - 1), (at & 63).astype(np.uint64)
        bits = self.high[w] >> k
        bits |= np.where((k > 0) & (w + 1 < len(self.high)), self.high[np.minimum(w + 1, len(self.high) - 1)] << ((np.uint64(64) - k) & np.uint64(63)), np.uint64(0))
        gap = ~bits
        run = np.bitwise_count((gap & (~gap + U1)) - U1).astype(np.int64)
        end = np.minimum(lo + run, self.n)
        far = np.flatnonzero((run >= 64) | (at >> 6 >= len(self.high)))
        if far.size:
            end[far] = self._ones_before_zero(h[far])
        hi = end.copy()
        want = x & ((U1 << np.uint64(self.l)) - U1)
        open_ = np.flatnonzero(lo < hi)
        while open_.size:
            mid = (lo[open_] + hi[open_]) >> 1
            go = self._low_at(mid) < want[open_]
            lo[open_[go]] = mid[go] + 1
            hi[open_[~go]] = mid[~go]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first element that is not under x (n if there is none)."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first element that is not under x, whether it is x)."""
        i, end = self._search(x)
        hit = i < end
        ok = np.flatnonzero(hit)
        hit[ok] = self._low_at(i[ok]) == x[ok].astype(np.uint64) & ((U1 << np.uint64(self.l)) - U1)
        return i, hit


def replace(path: str, write) -> None:
    """Write a file under another name first, so that a repeated task never leaves half a file."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    write(tmp)
    os.replace(tmp, path)
