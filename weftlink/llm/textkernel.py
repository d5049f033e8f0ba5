"""Vectorised text primitives over Arrow string buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 equals the pattern
`[^\\x20\\x09-\\x0D]+`. Everything works on a *slice*: consecutive rows whose bytes stay near a bound
(a single longer row forms a slice of its own), so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
INK = ~_BLANK

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_KEYS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


@dataclass
class Slice:
    """Rows `first`..`last` of a batch: their bytes, and where rows and words begin and end."""

    first: int
    last: int
    data: np.ndarray
    rows: np.ndarray  # len n + 1, offsets of rows in data
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    word_rows: np.ndarray  # len n + 1, offsets of rows among the words

    @property
    def n(self) -> int:
        return self.last - self.first

    def word_row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_rows))

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one for each byte) for each row."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.rows[1:]] - total[self.rows[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit content hash of each byte range, the same wherever the range lies."""
        up, down = _power_tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[self.data] * up[:-1], dtype=np.uint64, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    raw, at = strings(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        data, rows = raw[at[first] : at[last]], at[first : last + 1] - at[first]
        ink = INK[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = ink
        after = before[1:].copy()
        begin = before[:-1].copy()
        begin[rows[:-1][rows[:-1] < len(data)]] = False
        starts = np.flatnonzero(ink & ~begin)
        after[:-1] = ink[1:]
        after[-1:] = False
        inner = rows[1:]
        after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(ink & ~after) + 1
        yield Slice(first, last, data, rows, starts, ends, np.searchsorted(starts, rows))
        first = last
