"""Vectorised word kernels over Arrow text buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Everything works
on the UTF-8 buffer of an Arrow string column with numpy, so no Python string
or per-word Python object is made.  Words and word windows get 64-bit
polynomial hashes over randomised symbol values, taken from prefix sums: the
cost per byte is a few array passes, whatever the window length.

Memory: callers walk a batch in chunks of about ``CHUNK`` bytes (one longer
document makes a chunk of its own); a chunk needs about 30 bytes per text byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD1342543DE82EF95 | 1

_LANES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift multiply rounds)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    src = np.arange(256, dtype=np.uint64)
    if lower:
        src[65:91] += _U(32)
    return mix((src + _U(1)) * _U(0xA0761D6478BD642F))


_VALUES = {False: _byte_values(False), True: _byte_values(True)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept and grown by doubling)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1] = _U(b & (2**64 - 1))
            done = 2
            while done < size:
                step = _U(pow(b, done, 1 << 64))
                p[done : 2 * done] = p[:done] * step
                done *= 2
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


class Table:
    """Numbers distinct (hash, check) pairs of uint64 from 0 as they are added: open addressing in arrays."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self._slots = np.full(1 << bits, -1, np.int32)
        self._hash, self._check = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each pair, or -1."""
        slot = self._home(h)
        entry = self._slots[slot]
        left = np.flatnonzero((entry >= 0) & ((self._hash[entry] != h) | (self._check[entry] != check)))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            e = entry[left] = self._slots[slot[left]]
            left = left[(e >= 0) & ((self._hash[e] != h[left]) | (self._check[e] != check[left]))]
        return entry

    def add(self, h: np.ndarray, check: np.ndarray) -> None:
        """Number pairs that are distinct and new; beyond half full the slots are doubled and filled again."""
        n, end = self.n, self.n + len(h)
        while end > len(self._hash):
            self._hash, self._check = (np.concatenate([x, np.zeros_like(x)]) for x in (self._hash, self._check))
        self._hash[n:end], self._check[n:end] = h, check
        self.n = end
        if 2 * end > len(self._slots):
            self.bits = (2 * end - 1).bit_length()
            self._slots = np.full(1 << self.bits, -1, np.int32)
            n = 0
        self._place(np.arange(n, end, dtype=np.int32))

    def _place(self, entry: np.ndarray) -> None:
        slot, left = self._home(self._hash[entry]), np.arange(len(entry))
        while len(left):  # of those that want one slot the last gets it
            free = left[self._slots[slot[left]] < 0]
            self._slots[slot[free]] = entry[free]
            left = left[self._slots[slot[left]] != entry[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


def fold(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length and first 8 bytes of spans in one number: a check beside their hash."""
    lanes = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    return mix((lanes[starts] & _LANES[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) << _U(56))) if len(starts) else np.zeros(0, np.uint64)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Document ranges of about ``size`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the byte spans data[starts:ends]; with ``lower``, A-Z count as a-z."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _powers(_BASE, n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[lower][data] * p[:n], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some documents: byte starts and ends, and each document's range of words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Each document's sum of a value per byte."""
        acc = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=acc[1:])
        return acc[self.offsets[1:]] - acc[self.offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Find the words of documents ``data[offsets[i]:offsets[i+1]]``; none crosses documents."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~IS_SPACE[data]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = solid[1:-1][cuts]
    last[cuts - 1] = solid[1:-1][cuts - 1]
    starts = np.flatnonzero(first)
    return Words(data, offsets, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries of h (document borders are the caller's affair)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(_GRAM, len(h))
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p, out=acc[1:])
    return mix((acc[k:] - acc[:-k]) * inv[:n])


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """For window starts 0..n-1: whether the k-word window stays inside its document."""
    ok = np.zeros(n, bool)
    if n <= 0:
        return ok
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - k + 1, bounds[:-1])
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.minimum(lo, n), 1)
    np.add.at(step, np.minimum(hi, n), -1)
    return np.cumsum(step[:-1]) > 0


def document_of(bounds: np.ndarray) -> np.ndarray:
    """The document index of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def cover(marks: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words 0..n-1 that some marked k-word window (by start) covers."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + k, n), -1)
    return np.cumsum(step[:-1]) > 0
