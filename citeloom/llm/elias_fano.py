"""Elias-Fano codes of non-decreasing integers: about 2 + log2(universe / n) bits each, with a select structure."""

from __future__ import annotations

import numpy as np

STEP = 64  # a select sample for each so many values


class EliasFano:
    """n values: the low bits of each packed together; the high parts in unary, a one per value, in a bit vector.

    samples holds the place of every STEP-th one, so select() scans a few bytes and no table of 64-bit
    offsets is kept. An empty sequence and repeated values are allowed; values are below 2**62.
    """

    def __init__(self, n: int, low_width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_width, self.low, self.high, self.samples = n, low_width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        width = max(0, int((int(v[-1]) + 1) // n).bit_length() - 1)
        bits = (v[:, None] >> np.arange(width)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> width) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, width, low, np.packbits(high, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes())

    def slice(self, first: int, end: int) -> np.ndarray:
        """The values from place first to place end, read between the two select samples around them."""
        if first >= end:
            return np.empty(0, np.int64)
        at, after = first // STEP, -(-end // STEP)
        samples = np.frombuffer(self.samples, "<u4")
        start, stop = int(samples[at]), int(samples[after]) if after < len(samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[start >> 3 : (stop + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits) + (start & ~7)
        ones = ones[np.searchsorted(ones, start) :][first - at * STEP : end - at * STEP]
        return (ones - np.arange(first, end)) << self.low_width | self._low(first, end)

    def _low(self, first: int, end: int) -> np.ndarray:
        bit, width = first * self.low_width, self.low_width
        held = np.frombuffer(self.low, np.uint8)[bit >> 3 : (end * width + 7) >> 3]
        bits = np.unpackbits(held, bitorder="little")[bit & 7 :][: (end - first) * width].reshape(end - first, width)
        return (bits.astype(np.int64) << np.arange(width)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def rank(self, value: int) -> int:
        """How many values are below value, by selects."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.select(mid) < value else (low, mid)
        return low
