"""Words of Arrow text columns as NumPy spans and 64-bit hashes.

Texts are handled in blocks of whole texts, about ``BLOCK`` bytes each, so memory
depends on the block and on the longest single text, not on the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

# White space as in the words [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_STEP = np.uint64(_BASE)
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of True, never across a text's border."""
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    first, last = edges[edges < inside.size], edges[edges > 0] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each text's first word."""
    starts, ends = spans(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of spans, equal exactly for equal bytes but for chance."""
    size = data.size
    if _powers[0].size < size + 1:
        for i, factor in enumerate((_STEP, _BACK)):
            grown = np.full(size + 1, factor, np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[0][:size], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers[1][starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _MIX)


def windows(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` words within a text, and the index of its first word."""
    counts = np.diff(firsts)
    if hashes.size < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = np.zeros(hashes.size - width + 1, np.uint64)
    for k in range(width):
        factor = np.uint64((0x2545F4914F6CDD1D * (2 * k + 1)) & ((1 << 64) - 1))
        joined += mix(hashes[k : hashes.size - width + 1 + k] * factor + np.uint64(k))
    text = np.repeat(np.arange(counts.size), counts)
    whole = np.flatnonzero(text[: joined.size] == text[width - 1 :])
    return joined[whole], whole


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
