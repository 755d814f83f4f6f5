"""Vectorised words and hashes over Arrow string columns.

Words are runs of bytes outside \\x20 and \\x09-\\x0D. A batch is cut into slices of a few MB of
text, so what numpy holds doesn't grow with the batch; a longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
U = np.uint64
#: Odd multipliers for polynomial hashes of bytes and of words.
BYTE_BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019))


class Powers:
    """base**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


@lru_cache(maxsize=2)
def powers(base: int) -> Powers:
    return Powers(U(base))


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of values[start:end] for each pair, from prefix sums; equal sequences hash alike anywhere."""
    up, down = powers(int(base)).to(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


@dataclass
class Slice:
    """Some rows of a batch. Word i is data[start[i]:end[i]]; row r has words first[r]:first[r+1]."""

    rows: slice
    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return ranges_hash(_BYTE_VALUE[self.data], self.start, self.end, BYTE_BASE)

    def text(self, r: int) -> bytes:
        return self.data[self.text_at[r] : self.text_at[r + 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """Words of a string column, slice by slice. lower: A-Z become a-z."""
    at, data = buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        own = at[row : stop + 1] - at[row]
        part = data[at[row] : at[stop]]
        part = _LOWER[part] if lower else part
        start, end = words_at(part, own)
        yield Slice(slice(row, stop), part, own, start, end, np.searchsorted(start, own))
        row = stop


def words_at(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    word = ~space
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = own[(own > 0) & (own < len(data))]
    before[edges], after[edges - 1] = True, True
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def arrow_rows(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
