"""Elias-Fano sequences over memory-mapped files, queried in vectors."""

from __future__ import annotations

import numpy as np

_ONE, _SIX, _LOW6 = np.uint64(1), np.uint64(6), np.uint64(63)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) set bit of each word, by halving."""
    at = np.zeros(len(words), np.int64)
    k = k.copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = (words >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)
        n = _ones(low)
        right = k >= n
        k -= np.where(right, n, 0)
        at += np.where(right, half, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of 64-bit keys.

    The high part of each key is a gap in a bit string (a zero per value, a one per key), the
    low bits are packed; ``zeros`` counts the zeros before each word of the string.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @staticmethod
    def build(keys: np.ndarray) -> EliasFano:
        """keys: sorted uint64."""
        n = len(keys)
        top = int(keys[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = keys & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> _SIX).astype(np.int64), at & _LOW6
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        place = (keys >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) if n else 0) // 64 + 3
        high = np.zeros(size, np.uint64)
        np.bitwise_or.at(high, place >> 6, _ONE << (place & 63).astype(np.uint64))
        zeros = np.append(0, np.cumsum(64 - _ones(high)))[:-1]
        return EliasFano(n, bits, low, high, zeros.astype(np.int64))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.low, self.high, self.zeros

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> _SIX).astype(np.int64), at & _LOW6
        out = self.low[word] >> off
        spill = self.low[word + 1] << ((np.uint64(64) - off) & _LOW6)
        return (out | np.where(off > 0, spill, np.uint64(0))) & np.uint64((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of the first element equal to each key, -1 where there is none.

        The successor search goes to the gap of the key's high part and looks at the few
        elements in it.
        """
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        h = (keys >> np.uint64(self.bits)).astype(np.int64)
        inside = np.flatnonzero(h < int(self.zeros[-1]) + 1)
        h, want = h[inside], keys[inside] & np.uint64((1 << self.bits) - 1)
        # The place after the (h - 1)-th zero; ones up to the next zero are the elements.
        before = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, before, "right") - 1
        place = word * 64 + select_in_word(~self.high[word], before - self.zeros[word]) + 1
        place[h == 0] = 0
        first = place - h
        word, off = np.minimum(place >> 6, len(self.high) - 2), (place & 63).astype(np.uint64)
        window = self.high[word] >> off | np.where(off > 0, self.high[word + 1] << ((np.uint64(64) - off) & _LOW6), np.uint64(0))
        count = _ones((window ^ (window + _ONE)) >> _ONE)
        long = np.flatnonzero(window == _ALL)
        count[window == _ALL] = 64
        if len(long):  # a gap with over 63 elements: find its zero
            word = np.searchsorted(self.zeros, h[long], "right") - 1
            count[long] = word * 64 + select_in_word(~self.high[word], h[long] - self.zeros[word]) - place[long]
        lo, hi = first.copy(), first + count
        end = hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        some = np.flatnonzero(lo < end)
        hit = some[self._low(lo[some]) == want[some]]
        out[inside[hit]] = lo[hit]
        return out
