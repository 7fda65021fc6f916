"""Vectorised words, word hashes and window hashes over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  All hashes are 64 bit
and depend on the bytes alone, never on a process or batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # text handled at once; a longer document is a slice of its own

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_WHITE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with at most ``most`` bytes (or one document) each."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word."""
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = ~_WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True  # documents touch each other without a separator
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lo = starts[0]
    part = data[lo : ends[-1]]
    if lower:
        part = _LOWER[part]
    lengths = ends - starts
    power = np.ones(int(lengths.max()) + 1, np.uint64)
    power[1:] = _ODD
    power = np.multiply.accumulate(power)
    gaps = np.diff(np.append(starts, ends[-1]))
    at = np.arange(len(part)) - np.repeat(starts - lo, gaps)
    np.minimum(at, len(power) - 1, out=at)  # white space weighs nothing wherever it stands
    h = np.add.reduceat(_BYTE[part] * power[at], starts - lo)
    return mix(h ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` word windows and a mask of those inside one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + n] * weight
            weight = weight * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(out), doc[:n] == doc[k - 1 :]
