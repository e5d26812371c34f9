"""Texts of an Arrow batch as bytes, and hashes of all their words at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes looked at together; longer texts are cut by those who call, never shortened.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[str, np.ndarray] = {}

#: The ASCII white space of the contracts: blank and \x09 to \x0d.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together; a longer text is a run by itself."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(at) - 1)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits count."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        powers = np.full(max(n, SLICE + 1), base)
        powers[0] = 1
        _powers[name] = np.cumprod(powers)
    return _powers[name][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for each pair, by sums of weighted bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    inverse = _power("down", _BASE_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a byte of ``apart``, and where each text's words begin."""
    word = ~apart[data]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[:1] = False
    edge = at[:-1][at[:-1] < at[1:]]  # first bytes of texts
    before[edge] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[:-1] = word[1:]
    after[-1:] = False
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)
