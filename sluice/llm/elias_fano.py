"""Elias-Fano lists: a rising sequence in about 2 + log2(range / length) bits an entry.

Each value is split into ``low_bits`` low bits, stored as they are, and the
rest, stored as a bit set in which entry ``i`` sets bit ``high(i) + i``. The
select structure holds the position of every 256th set bit, so a lookup reads
one sample and a short run of the bit set.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 256
HEAD = "<QqBQQQ"
HEAD_BYTES = struct.calcsize(HEAD)


def encode(values: np.ndarray) -> bytes:
    """A list that never falls, as bytes: header, low bits, high bits, select samples."""
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    base = int(values[0]) if n else 0
    rel = (values - base).astype(np.uint64)
    span = int(rel[-1]) + 1 if n else 1
    low_bits = max(0, (span // max(n, 1)).bit_length() - 1)
    low = _pack(rel & np.uint64((1 << low_bits) - 1), low_bits)
    ones = (rel >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros(((int(ones[-1]) if n else 0) // 8 + 1) * 8, dtype=np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    samples = ones[::EVERY].astype("<u8").tobytes()
    return struct.pack(HEAD, n, base, low_bits, len(low), len(high), len(samples)) + low + high + samples


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """Reads a list from its bytes without unpacking it."""

    def __init__(self, data: bytes) -> None:
        self.n, self.base, self.width, low, high, samples = struct.unpack_from(HEAD, data)
        view = memoryview(data)[HEAD_BYTES:]
        self.low = np.frombuffer(view[:low], dtype=np.uint8)
        self.high = np.frombuffer(view[low:low + high], dtype=np.uint8)
        self.samples = np.frombuffer(view[low + high:low + high + samples], dtype="<u8")
        self.bytes = HEAD_BYTES + low + high + samples

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The ``i``-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte, skip = at // 8, at % 8
        while True:
            run = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
            ones = np.flatnonzero(run[skip:])
            if left < len(ones):
                one = byte * 8 + skip + int(ones[left])
                return self.base + ((one - i) << self.width | self._low(i))
            left, byte, skip = left - len(ones), byte + 64, 0

    def _low(self, i: int) -> int:
        start = i * self.width
        part = bytes(self.low[start // 8:(start + self.width + 7) // 8])
        return int.from_bytes(part, "little") >> (start % 8) & ((1 << self.width) - 1)

    def select_range(self, first: int, stop: int) -> np.ndarray:
        """Values ``first`` to ``stop`` - 1, read from the sample before the first to the one after the last."""
        if not 0 <= first <= stop <= self.n:
            raise IndexError((first, stop))
        if first == stop:
            return np.zeros(0, dtype=np.int64)
        begin, skip, after = int(self.samples[first // EVERY]), first % EVERY, (stop - 1) // EVERY + 1
        byte, last = begin // 8, int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        run = np.unpackbits(self.high[byte:last], bitorder="little")
        run[:begin % 8] = 0
        ones = byte * 8 + np.flatnonzero(run)[skip:skip + stop - first]
        low = np.zeros(stop - first, dtype=np.int64)
        if self.width:
            at = first * self.width
            bits = np.unpackbits(self.low[at // 8:(stop * self.width + 7) // 8], bitorder="little")[at % 8:][:(stop - first) * self.width]
            low = bits.reshape(-1, self.width).astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))
        return self.base + ((ones - np.arange(first, stop)) << self.width | low)

    def values(self) -> np.ndarray:
        """All values."""
        return self.select_range(0, self.n)
