"""Words of whole Arrow batches as numpy arrays: boundaries and 64-bit hashes.

A text never becomes a Python list of words here. Bytes of the batch are
classified once, words are found as index pairs, and each word gets a
polynomial hash over its bytes that is then mixed. Hashes depend on nothing
but the word's bytes, so every worker and every run agrees on them.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The separators of a word, space and the controls from tab to carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_HASH_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def _release() -> None:
    """Give freed memory back: workers wait for the next task beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts(batches, column: int = 1, most: int = 1 << 20):
    """Cut record batches so that each part holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for cut in np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // most)) + 1:
            yield batch.slice(at, cut - at)
            at = int(cut)
        if at < batch.num_rows:
            yield batch.slice(at)
    _release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets of each text's words among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE))))
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per word; works through about a megabyte of words at a time."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    done = np.concatenate(([0], np.cumsum(lengths)))
    cuts = np.unique(np.concatenate((np.searchsorted(done, np.arange(0, done[-1], _HASH_BYTES)), [len(starts)])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        size = lengths[a:b]
        rel = done[a:b] - done[a]
        local = np.arange(done[b] - done[a]) - np.repeat(rel, size)
        values = _BYTE[data[np.repeat(starts[a:b], size) + local]] * _power(int(size.max()))[local]
        out[a:b] = np.add.reduceat(values, rel)
    return mix(out ^ lengths.astype(np.uint64))


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words: by hash, then checked byte by byte."""
    hashes = word_hashes(data, starts, ends)
    _, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    length = ends - starts
    model = first[numbers]
    if (length != length[model]).any() or not same_bytes(data, starts, starts[model], length):
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(starts, ends)], np.int64)
    return numbers.astype(np.int64)


def same_bytes(data, a, b, length, at_once: int = 1 << 17) -> bool:
    for k in range(0, len(a), at_once):
        size = length[k:k + at_once]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (data[np.repeat(a[k:k + at_once], size) + inside] != data[np.repeat(b[k:k + at_once], size) + inside]).any():
            return False
    return True


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words; a shorter, non-empty text is one shingle."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _BASE + hashes[k:k + n]
    return mix(out)
