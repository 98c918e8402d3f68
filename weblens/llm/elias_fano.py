"""Elias-Fano coding of non-decreasing integers, with select."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: One sampled position for so many set bits of the high part.
SAMPLE = 512
_HEAD = struct.Struct("<QQB7x")


def _pack(values: np.ndarray, width: int) -> bytes:
    """`width` bits of each value, lowest bit first."""
    if not width or not len(values):
        return b""
    out = []
    for lo in range(0, len(values), 1 << 16):  # a multiple of 8 values fills whole bytes
        part = values[lo : lo + (1 << 16)]
        bits = (part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


@dataclass
class EliasFano:
    """n values below `bound`: `width` low bits of each, and the rest in unary in `high`.

    samples has the bit position of every SAMPLE-th set bit, so select scans at most a few words.
    """

    n: int
    bound: int
    width: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        width = max(0, (int(bound) // max(1, n)).bit_length() - 1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(n + (int(bound) >> width) + 1), dtype=np.uint8)
        bits[places] = 1
        mask = np.uint64((1 << width) - 1)
        low = np.frombuffer(_pack(values & mask, width), dtype=np.uint8)
        return cls(n, int(bound), width, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        body = self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()
        return _HEAD.pack(self.n, self.bound, self.width) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bound, width = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, (n * width + 7) // 8, at)
        at += len(low)
        high = np.frombuffer(data, np.uint8, (n + (bound >> width) + 1 + 7) // 8, at)
        at += len(high)
        return cls(n, bound, width, low, high, np.frombuffer(data, "<u8", (n + SAMPLE - 1) // SAMPLE, at))

    def _low(self, i: int) -> int:
        start, stop = i * self.width, (i + 1) * self.width
        chunk = int.from_bytes(self.low[start // 8 : (stop + 7) // 8].tobytes(), "little")
        return (chunk >> (start % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        here = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= (ones := here.bit_count()):
            left -= ones
            byte += 1
            here = int(self.high[byte])
        for _ in range(left):
            here &= here - 1
        place = byte * 8 + (here & -here).bit_length() - 1
        return ((place - i) << self.width) | self._low(i)

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """The values from the lo-th to before the hi-th. Only the bits between their samples are read."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, dtype=np.int64)
        first = int(self.samples[lo // SAMPLE]) // 8
        after = (hi - 1) // SAMPLE + 1
        last = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + first * 8
        # Set bits of the first byte that come before the sample.
        skipped = int(np.searchsorted(places, int(self.samples[lo // SAMPLE]))) + lo % SAMPLE
        high = (places[skipped : skipped + hi - lo] - np.arange(lo, hi)) << self.width
        if not self.width:
            return high
        begin = lo * self.width
        raw = self.low[begin // 8 : (hi * self.width + 7) // 8]
        bits = np.unpackbits(raw, bitorder="little")[begin % 8 :][: (hi - lo) * self.width].reshape(hi - lo, self.width)
        return high | (bits << np.arange(self.width, dtype=np.int64)).sum(axis=1)

    def values(self) -> np.ndarray:
        """All values."""
        return np.concatenate([np.zeros(0, dtype=np.int64), *(self.select_range(lo, min(self.n, lo + (1 << 16))) for lo in range(0, self.n, 1 << 16))])
