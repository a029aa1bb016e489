"""Hashes of words and word windows for whole Arrow batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: A second, independent multiplier for the other half of 128-bit hashes.
_STEP2 = np.uint64(0xA0761D6478BD642F)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h + np.uint64(salt) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows of about ``most`` bytes of text (a longer text is a run by itself)."""
    column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum(np.asarray(pa.compute.binary_length(column), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, upto - at), column.slice(at, upto - at)
        at = upto


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and per row the index of its first word (one more entry at the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    space = _IS_SPACE[data]
    begins = np.empty(len(data), bool)
    begins[0], begins[1:] = True, space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(begins & ~space)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    spans = np.diff(np.append(at, len(data)))
    lead = at[0]
    inside = np.arange(lead, len(data)) - np.repeat(at, spans)
    powers = np.cumprod(np.full(int(spans.max()), _STEP, np.uint64))
    value = (_LOWER_BYTE if lower else _BYTE)[data[lead:]] * powers[inside]
    value[space[lead:]] = 0
    return mixed(np.add.reduceat(value, at - lead)), np.searchsorted(at, offsets)


def window_hashes(h: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of each run of ``size`` words, unscrambled, so that two runs join as in ``doubled``."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    step, n = (_STEP2 if second else _STEP), len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * step + h[k : k + n]
    return out


def doubled(windows: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hashes of windows of twice the size from those of ``size`` words."""
    n = len(windows) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = np.cumprod(np.full(size, _STEP2 if second else _STEP, np.uint64))[-1]
    return windows[:n] * step + windows[size:]


def shingle_sets(h: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles; fewer words count as one shingle."""
    every = mixed(window_hashes(h, size))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield mixed(window_hashes(h[a:b], b - a), salt=b - a)
        else:
            yield np.zeros(0, np.uint64)
