"""Words and word shingles of whole Arrow text columns as flat numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased.  Words are named by 64-bit polynomial hashes that are read off a
prefix sum, so no Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_U = np.uint64


def _odd(n: int) -> np.ndarray:
    return _rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BYTE_CODE = _odd(256)
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[ord("A") : ord("Z") + 1] = BYTE_CODE[ord("a") : ord("z") + 1]


class Powers:
    """base^i and base^-i modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, size, 1 << 64))])
        return self.up[:n], self.down[:n]


BYTES = Powers(int(_odd(1)[0]))
SEQ_A, SEQ_B = Powers(int(_odd(1)[0])), Powers(int(_odd(1)[0]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(codes: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sums s and inverse powers d, so that (s[j] - s[i]) * d[i] names codes[i:j]."""
    up, down = powers.to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return sums, down


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """All words of a chunk: ``hash``, byte ``start`` and ``end``, and ``first``:
    row r has words first[r] to first[r + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, rows = len(data), len(offsets) - 1
        gap = SEPARATOR[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        word = ~gap
        before = np.ones(n, bool)
        before[1:] = gap[:-1]
        after = np.ones(n, bool)
        after[:-1] = gap[1:]
        self.start = np.flatnonzero(word & (before | cut[:-1]))
        self.end = np.flatnonzero(word & (after | cut[1:])) + 1
        sums, down = prefix_sums(FOLDED_CODE[data], BYTES)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offsets, "left")
        self.first[-1] = len(self.start)
        self.rows = rows

    def sequences(self) -> np.ndarray:
        """For each row 16 bytes that name its sequence of words."""
        out = np.zeros((self.rows, 2), np.uint64)
        a, z = self.first[:-1], self.first[1:]
        for k, powers in enumerate((SEQ_A, SEQ_B)):
            sums, down = prefix_sums(self.hash, powers)
            out[:, k] = mix((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))
        return out

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``size`` words, and where each row's begin.

        A row with fewer words has one, of all of them; without words, none."""
        a, z = self.first[:-1], self.first[1:]
        count = z - a
        each = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
        first = np.zeros(self.rows + 1, np.int64)
        np.cumsum(each, out=first[1:])
        at = np.repeat(a - first[:-1], each) + np.arange(first[-1])
        width = np.repeat(np.minimum(count, size), each)
        sums, down = prefix_sums(self.hash, SEQ_A)
        return mix((sums[at + width] - sums[at]) * down[at] + width.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), first
