"""Vectorised views of text columns in Arrow batches, and rolling polynomial hashes.

Hashes are sums of ``value[c] * B**i`` in 64-bit arithmetic with random values per
symbol: one cumulative sum gives the hash of any span. Two different spans collide
with a chance of about 2**-56, whatever their length.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 3
_VALUES = np.random.default_rng(20240229).integers(1, 2**64 - 1, size=1 << 16, dtype=np.uint64) | np.uint64(1)
BYTE_VALUES = _VALUES[:256]
SYMBOL_VALUES = _VALUES[:512]
_POWERS: dict[str, np.ndarray] = {}

#: ASCII white space of the word rule: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about ``limit`` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i to n, kept for the worker's life."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * B**i, one longer than ``values``."""
    up, _ = powers(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) from their prefix sums."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word's index for each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = ~SPACE[data]
    before = np.empty_like(full)
    before[0] = False
    before[1:] = full[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(full)
    after[-1] = False
    after[:-1] = full[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(full & ~before)
    return starts, np.flatnonzero(full & ~after) + 1, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... for ``lengths[0]`` entries, then those of the next."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def pack(a: np.ndarray) -> bytes:
    """Bytes of a sorted array by byte planes, so that the shuffle's compression finds the runs."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def unpack(raw, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width)
    return np.ascontiguousarray(flat.T).view(dtype).reshape(-1)


@functools.cache
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give memory that is free again back to the system; a worker waits with what it holds."""
    pa.default_memory_pool().release_unused()
    if give := _malloc_trim():
        give(0)
