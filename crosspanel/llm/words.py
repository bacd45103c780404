"""Words of Arrow text columns as 64-bit hashes, found with NumPy over the column's bytes.

A word is a run of bytes other than ASCII white space; A-Z counts as a-z.  A null text counts as empty.
The hash is a polynomial of per-byte values modulo 2**64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits: for words without the punctuation on them.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LINE_END = np.zeros(256, bool)
LINE_END[0x0A] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)[_LOWER] | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; kept up to a slice's length."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= 2 * SLICE_BYTES:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for every span; equal spans get equal hashes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each row's offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most ``limit`` bytes, or of one longer row."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of non-separator bytes inside each row."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, in order."""
    starts, ends, row = spans(data, offsets, separator)
    return span_hashes(_BYTE[data], starts, ends), row


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def grams(hashes: np.ndarray, row: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the word combinations at positions i + each of ``gaps`` (rising from 0) inside a row."""
    n = len(hashes) - gaps[-1]
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, row.dtype)
    same = row[:n] == row[gaps[-1] :]
    at = np.flatnonzero(same)
    out = np.full(len(at), 0x632BE59BD9B4E019, np.uint64)
    for gap in gaps:
        out = mix(out + hashes[at + gap]) + np.uint64(gap + 1)
    return out, row[at]


def row_sets(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys of every row, one after another, and the rows' offsets into them."""
    order = np.lexsort((keys, row)) if len(keys) else np.empty(0, int)
    keys, row = keys[order], row[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    keys, row = keys[fresh], row[fresh]
    return keys, np.searchsorted(row, np.arange(rows + 1))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of the column."""
    data, offsets = utf8(column)
    for at, end in slices(offsets, limit):
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
