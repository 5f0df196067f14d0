"""Words, lines and hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

Texts arrive as Arrow columns and are handled in slices of bounded size, so a
task holds a few megabytes of text and some arrays over them, whatever the
size of its partition. A single text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose text in ``column`` has at most ``limit`` bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them; a null is an empty text."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, raw, data = col.buffers()
    if not n or raw is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_tables: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        size = max(n, SLICE_BYTES + 1)
        if size > 4 * SLICE_BYTES:  # for one very long text: not kept
            return _powers(base, size)
        _tables[name] = _powers(base, size)
    return _tables[name][:n]


@cache
def byte_values(lower: bool, seed: int = 0) -> np.ndarray:
    """A random value per byte; with ``lower``, A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


class Rolling:
    """Hashes of any byte ranges of ``data``, from one running sum."""

    def __init__(self, data: np.ndarray, lower: bool = False, seed: int = 0):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        values = byte_values(lower, seed)[data]
        values *= _power_table("up", _ODD, max(n, 1))[:n]
        np.cumsum(values, out=self.sums[1:])
        self.down = _power_table("down", _INVERSE, n + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.down[starts]
        h += (ends - starts).astype(np.uint64)
        return mix(h)

    def windows(self, size: int) -> np.ndarray:
        """The hash of each range of ``size`` bytes, by start."""
        h = self.sums[size:] - self.sums[:-size]
        h *= self.down[: len(h)]
        return mix(h)


def byte_table(spec: str) -> np.ndarray:
    """True for the bytes that match a bracket pattern such as ``[^\\x20]``."""
    import re

    pattern = re.compile(spec.encode("latin-1"))
    return np.array([bool(pattern.fullmatch(bytes([b]))) for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 word offsets of the texts."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = table[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def shingles(tokens: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` tokens, by start, whatever text they are in."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = tokens[:n].copy()
    for k in range(1, size):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += tokens[k : k + n]
        h ^= h >> np.uint64(32)
    return mix(h)


def fits(offsets: np.ndarray, size: int) -> np.ndarray:
    """For each token, whether the run of ``size`` that it begins ends in its text."""
    return np.arange(offsets[-1]) + size <= np.repeat(offsets[1:], np.diff(offsets))


def code_points(data: np.ndarray) -> np.ndarray:
    """True for the first byte of each character."""
    return (data & 0xC0) != 0x80


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text of each token, from the texts' token offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
