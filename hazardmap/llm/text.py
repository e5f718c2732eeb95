"""Vectorised word handling over Arrow text columns.

A batch of texts is seen as one byte array with offsets, so words and word n-grams of many
documents are found and hashed by a few numpy passes.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: ASCII white space: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither letter nor digit; bytes of other characters belong to words.
PUNCT = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes: first row, end row, bytes, offsets."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: maximal runs of bytes outside `breaks`, within one row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(n + 1, bool)
    np.logical_not(breaks[data], out=inside[:n])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        have = np.empty(max(n, SLICE_BYTES + 4096), np.uint64)
        have[0], have[1:] = 1, base
        have = np.multiply.accumulate(have)
        if n <= 8 * SLICE_BYTES:
            _powers[kind] = have
    return have


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each span of bytes after `fold`, the same wherever the span stands."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE[fold])[data] * _power("up", _R, n)[:n], out=total[1:])
    value = (total[ends] - total[starts]) * _power("down", _R_INV, n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def word_ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of the first word of each n-word window that lies in one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        value = value * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[at + k]
    return mix(value ^ np.uint64(n)), at
