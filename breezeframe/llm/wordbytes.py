"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow string column.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All of these are single bytes in UTF-8, so
byte runs and code-point runs are the same words. Texts are taken in slices of bounded bytes, so memory
does not follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return type(self), ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE_BYTES + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            ones = np.ones(1, dtype=np.uint64)
            self.up = np.cumprod(np.concatenate([ones, np.full(size - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([ones, np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Slice:
    """Consecutive rows of a string column and their words; ``first[i]`` is the first word of row ``i``."""

    row0: int
    n_rows: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, lower-cased in A-Z if asked."""
        codes = _BYTE_CODES[_LOWER[self.data] if lower else self.data]
        up, down = _POWERS.upto(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * up[: len(codes)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


#: Letters, digits and all bytes of non-ASCII characters are inside words, the rest separates them.
PUNCTUATED = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])


def slices(column: pa.Array, limit: int = SLICE_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[Slice]:
    """Slices of about ``limit`` bytes; a longer single text is a slice of its own. Null counts as empty.

    ``gaps`` tells which bytes separate words.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        bounds = offs[at : to + 1] - offs[at]
        yield _slice(at, whole[offs[at] : offs[to]], bounds, gaps)
        at = to


def _slice(row0: int, data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray) -> Slice:
    inside = ~gaps[data]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Slice(row0, len(bounds) - 1, data, bounds, start, end, row, first)
