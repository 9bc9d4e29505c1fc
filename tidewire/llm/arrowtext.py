"""Vectorised words, word hashes and rolling k-grams over Arrow text columns.

A whole slice of a batch is tokenised at once on its UTF-8 bytes: byte classes give the word bounds, prefix sums of
a polynomial give each word's 64-bit hash. Words never cross documents. A slice holds about ``SLICE_BYTES`` of text
(one longer document makes a slice of its own), so memory does not depend on the batch size. Hashing takes some 60
bytes for each byte of a slice, and a worker keeps 32 more for the powers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_U = np.uint64
_POW, _INV = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: ASCII white space: space and \t \n \v \f \r.
SPACES = b" \t\n\v\f\r"


def _classes(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes of words that end at white space.
SPACED = _classes(lambda b: b not in SPACES)
#: Bytes of alphanumeric words: 0-9, a-z (after lower-casing A-Z) and every byte of a non-ASCII character.
ALNUM = _classes(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of murmur3."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)
_BYTE2 = mix(np.arange(1001, 1257, dtype=np.uint64)) | _U(1)


class _Powers:
    """P^i and P^-i modulo 2^64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            cls.up = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _POW)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _INV)]), dtype=np.uint64)
        return cls.up, cls.down


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[at : at + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about SLICE_BYTES."""
    data, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a slice: ``doc`` (row in the slice), byte bounds, hashes; ``first[d]:first[d+1]`` are those of d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, second: bool = False):
        n = len(offsets) - 1
        self.n_docs = n
        inside = table[data]
        left, right = inside.copy(), inside.copy()
        if len(data):
            left[1:] &= ~inside[:-1]
            right[:-1] &= ~inside[1:]
            bounds = offsets[1:-1]
            bounds = bounds[(bounds > 0) & (bounds < len(data))]
            left[bounds] = inside[bounds]
            right[bounds - 1] = inside[bounds - 1]
        self.start = np.flatnonzero(left)
        self.end = np.flatnonzero(right) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        lowered = LOWER[data]
        self.hash = self._hashes(lowered, _BYTE)
        self.hash2 = self._hashes(lowered, _BYTE2) if second else None

    def _hashes(self, lowered: np.ndarray, values: np.ndarray) -> np.ndarray:
        up, down = _Powers.get(len(lowered) + 1)
        total = np.zeros(len(lowered) + 1, np.uint64)
        np.cumsum(values[lowered] * up[: len(lowered)], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        return mix((total[self.end] - total[self.start]) * down[self.start] + length * _U(0xA24BAED4963EE407))

    def grams(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every k consecutive words of one document."""
        h = self.hash2 if second else self.hash
        m = len(h) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return at, roll(h, k)[at]


def runs(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs first to last (exclusive) of word hashes, from prefix sums: the runs' lengths don't matter."""
    up, down = _Powers.get(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _U(0xA24BAED4963EE407))


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the index of its least one, the leftmost of equal ones."""
    at, size = np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        size += step
    return at


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes."""
    m = len(h) - k + 1
    acc = np.zeros(m, np.uint64)
    for j in range(k):
        acc = acc * _U(0xD6E8FEB86659FD93) + h[j : j + m]
    return mix(acc + _U(k))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
