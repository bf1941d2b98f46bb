"""Word hashes of Arrow text columns, computed on whole UTF-8 buffers with numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
a-z. Words are identified by 64-bit hashes. Nulls are empty texts. Long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE[65:91] = BYTE[97:123]
BASE = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 1 << 12


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


_POW = [_powers(_STEP)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes; a longer text is a run alone."""
    data, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first byte, end byte, per-row bounds into them) of the words of each row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(at), np.int64)
    gap = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[at[:-1][at[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[at[1:][at[1:] > 0] - 1] = True
    solid = ~gap
    first, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    size = end - first
    if not len(first):
        return np.zeros(0, np.uint64), first, end, np.zeros(len(at), np.int64)
    pos = np.flatnonzero(solid)
    rel = pos - np.repeat(first, size)
    value = BYTE[data[pos]] * _POW[0][rel & (_STEP - 1)]
    if size.max() > _STEP:
        far = np.flatnonzero(rel >= _STEP)
        value[far] *= mix((rel[far] >> 12).astype(np.uint64)) | U(1)
    h = np.add.reduceat(value, np.concatenate(([0], np.cumsum(size)[:-1])))
    return mix(h + size.astype(np.uint64)), first, end, np.searchsorted(first, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of k words; a row with fewer words is one run."""
    h, _, _, bound = words(data, at)
    runs = _runs(h, k) if len(h) >= k else h[:0]
    for lo, hi in zip(bound[:-1], bound[1:], strict=True):
        if hi - lo >= k:
            s = np.sort(runs[lo : hi - k + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]
        else:
            yield _runs(h[lo:hi], hi - lo) if hi > lo else h[:0]


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    out = np.full(n, U(k))
    for j in range(k):
        out *= U(0x9E3779B97F4A7C15)
        out += h[j : j + n]
        out ^= out >> U(29)
    return mix(out)
