"""Elias-Fano coded sequences in numpy, queried many values at a time.

A strictly increasing sequence of n values below u keeps the low
``log2(u / n)`` bits of each in a packed array and the high parts as a bit vector:
value i sets bit ``(value >> low) + i``.  Zeros then separate buckets of equal high
part, so finding a value means one select on zeros and a search in its bucket.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQQQ")  # n, low bits, words of lows, words of highs
#: Words of a block, before each of which the clear bits so far are counted.
_BLOCK = 4
#: Values searched together, few enough for temporaries to stay in a core's cache.
_AT_ONCE = 8192
_ONE = np.uint64(1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    words = np.zeros((len(values) * width + 63) // 64 + 1, dtype=np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def encode(values: np.ndarray, universe: int) -> bytes:
    """Bytes of a non-decreasing sequence of values below ``universe``."""
    values = values.astype(np.uint64)
    n = len(values)
    low = max(0, (universe // max(1, n)).bit_length() - 1)
    lows = _pack(values & np.uint64((1 << low) - 1), low)
    n_bits = n + (universe >> low) + 2
    if n_bits >= 1 << 32:
        raise ValueError("a sequence has less than 2^32 bits of high parts")
    bits = np.zeros(-(-n_bits // (64 * _BLOCK)) * 64 * _BLOCK, dtype=np.uint8)
    bits[((values >> np.uint64(low)).astype(np.int64) + np.arange(n))] = 1
    highs = np.packbits(bits, bitorder="little").view("<u8")
    clear = 64 * _BLOCK - bits.reshape(-1, 64 * _BLOCK).sum(axis=1, dtype=np.int64)
    ranks = (np.cumsum(clear) - clear).astype("<u4")
    return _HEAD.pack(n, low, len(lows), len(highs)) + lows.astype("<u8").tobytes() + highs.tobytes() + ranks.tobytes()


def _byte_table() -> np.ndarray:
    """Place of the k-th set bit of a byte, at index k * 256 + byte (8 where there is none)."""
    out = np.full(8 * 256, 8, dtype=np.int64)
    for byte in range(256):
        places = [i for i in range(8) if byte >> i & 1]
        for k, place in enumerate(places):
            out[k * 256 + byte] = place
    return out


_IN_BYTE = _byte_table()
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each word, by sums over its bytes."""
    k = k.astype(np.uint64)
    s = x - ((x >> _ONE) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES
    place = np.bitwise_count(((k * _ONES | _TOPS) - s) & _TOPS).astype(np.uint64) << np.uint64(3)
    rank = k - (((s << np.uint64(8)) >> place) & np.uint64(255))
    return place.astype(np.int64) + _IN_BYTE[((x >> place) & np.uint64(255) | rank << np.uint64(8)).astype(np.int64)]


class EliasFano:
    def __init__(self, data, at: int = 0):
        """Reads the bytes that ``encode`` made, from ``at`` on; ``end`` is what follows."""
        self.n, self.low, n_low, n_high = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        self.lows = np.frombuffer(data, dtype="<u8", count=n_low, offset=at)
        at += self.lows.nbytes
        self.highs = np.frombuffer(data, dtype="<u8", count=n_high, offset=at)
        at += self.highs.nbytes
        self.zeros = np.frombuffer(data, dtype="<u4", count=n_high // _BLOCK, offset=at)
        self.end = at + self.zeros.nbytes
        # clear or set bits before each block
        self.before = (self.zeros.astype(np.int64), np.arange(len(self.zeros)) * (64 * _BLOCK) - self.zeros.astype(np.int64))
        self.blocks = self.highs.reshape(-1, _BLOCK)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.lows[word] >> shift
        more = np.where(shift > np.uint64(64 - self.low), self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (out | more) & np.uint64((1 << self.low) - 1)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit."""
        before = self.before[bit]
        block = np.searchsorted(before, k, side="right") - 1
        words = self.blocks[block] if bit else ~self.blocks[block]
        left = k - before[block]
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (sums <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left = left - np.where(word > 0, sums[rows, word - 1], 0)
        return ((block * _BLOCK + word) << 6) + _select_in_word(words[rows, word], left)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, dtype=np.int64)
        high = self._select(i.copy(), 1) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places i and i + 1: the next set bit is mostly in the same word."""
        i = np.asarray(i, dtype=np.int64)
        bit = self._select(i.copy(), 1)
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        rest = self.highs[word] >> off >> _ONE
        after = bit + 1 + np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):
            after[far] = self._select(i[far] + 1, 1)
        low = np.uint64(self.low)
        return ((bit - i).astype(np.uint64) << low) | self._low(i), ((after - i - 1).astype(np.uint64) << low) | self._low(i + 1)

    def find(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, or -1: the successor search stops at an equal one.  With
        ``lo`` and ``hi`` only the places from lo on and before hi are searched."""
        values = np.asarray(values, dtype=np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        parts = [slice(i, i + _AT_ONCE) for i in range(0, len(values), _AT_ONCE)]
        return np.concatenate([self._find(values[p], None if lo is None else lo[p], None if hi is None else hi[p]) for p in parts])

    def _find(self, values: np.ndarray, first: np.ndarray | None, end: np.ndarray | None) -> np.ndarray:
        high = (values >> np.uint64(self.low)).astype(np.int64)
        # a bucket is the run of set bits after the zero that ends the one before
        bit = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1, 0)
        start = bit - high
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        rest = ~(self.highs[word] >> off)
        run = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        run = np.minimum(run, 64 - off.astype(np.int64))
        stop = start + run
        long = np.flatnonzero(run == 64 - off.astype(np.int64))  # runs that leave their word
        if len(long):
            stop[long] = self._select(high[long], 0) - high[long]
        want = values & np.uint64((1 << self.low) - 1)
        if first is not None:
            start, stop = np.maximum(start, first), np.minimum(stop, end)
        lo, hi = start.copy(), stop.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        hit = (lo < stop) & (start < stop)
        hit[hit] = self._low(lo[hit]) == want[hit]
        return np.where(hit, lo, -1)
