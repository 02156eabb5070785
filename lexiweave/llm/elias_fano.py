"""Elias-Fano coding of a non-decreasing integer sequence, with select."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: One position is stored for every so many values; select scans from there.
STRIDE = 256


@dataclass(frozen=True)
class EliasFano:
    """``n`` values below ``2 ** 62``: ``low_bits`` bits each in ``low``, the rest in unary in ``high``.

    ``marks`` holds the bit position in ``high`` of every STRIDE-th value as
    32-bit numbers, which bounds a sequence to 2**32 high bits. The space is
    about ``2 + low_bits`` bits a value.
    """

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    marks: np.ndarray

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if len(v) and bool((v[1:] < v[:-1]).any()):
            raise ValueError("values must not decrease")
        n = len(v)
        low_bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), at[::STRIDE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last - 1``, as int64; reads only their part of both bit strings."""
        if first >= last:
            return np.empty(0, np.int64)
        mark = int(self.marks[first // STRIDE])
        end = int(self.marks[(last - 1) // STRIDE + 1]) + 1 if (last - 1) // STRIDE + 1 < len(self.marks) else len(self.high) * 8
        bits = np.unpackbits(self.high[mark // 8 : (end + 7) // 8], bitorder="little")
        bits[: mark % 8] = 0
        skip = first % STRIDE
        at = np.flatnonzero(bits)[skip : skip + last - first] + mark // 8 * 8
        b0 = first * self.low_bits
        count = (last - first) * self.low_bits
        low = np.unpackbits(self.low[b0 // 8 : (b0 + count + 7) // 8], bitorder="little")[b0 % 8 : b0 % 8 + count]
        low = low.reshape(last - first, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return (at - np.arange(first, last) << self.low_bits) + low

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        return self.select_range(0, self.n)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.marks))
        return head + self.low.tobytes() + self.high.tobytes() + self.marks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        return cls(
            n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c, at + a + b)
        )
