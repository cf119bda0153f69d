"""Word and shingle hashes of whole texts, computed on Arrow buffers with numpy.

Words are ``[^\\x20\\x09-\\x0D]+``; a word's 64-bit hash depends on its bytes alone, a shingle's on its words' hashes and
their order. Different words or shingles get equal hashes with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wayfare.llm.subwords import mixed

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes laid end to end, and where each text begins and the last ends. NULL is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) so that each slice holds about ``most_bytes`` of text, or one longer text."""
    _, at = _bytes(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, side="right")) - 1)
        yield first, column.slice(first, end - first)
        first = end


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices by the bytes of a text column, so that results of long texts do not pile up."""
    for first, rows in slices(batch.column(column)):
        yield batch.slice(first, len(rows))


def word_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each word, end of each word, words per text)."""
    data, at = _bytes(column)
    solid = ~_IS_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, at))
    return data, starts, np.flatnonzero(ends) + 1, counts


def hashed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word, of the lower-cased (A-Z) word if asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    power = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    table = _BYTE[_LOWER] if lower else _BYTE
    solid = data[np.repeat(starts, sizes) + place]
    return mixed(np.add.reduceat(table[solid] * power[place], first) + sizes.astype(np.uint64))


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the texts laid end to end, words per text)."""
    data, starts, ends, counts = word_bounds(column)
    return hashed_words(data, starts, ends, lower), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every ``size``-word shingle, shingles per text); shorter texts have their whole sequence as one."""
    if not len(words):
        return words, counts
    weights = np.cumprod(np.full(size, 0xD1B54A32D192ED03, np.uint64))
    padded = np.concatenate([words, np.zeros(size - 1, np.uint64)])
    rolled = np.zeros(len(words), np.uint64)
    for k in range(size):
        rolled += padded[k : k + len(words)] * weights[k]
    starts = np.cumsum(counts) - counts
    left = np.repeat(starts + counts, counts) - np.arange(len(words))
    whole = left >= size
    for doc in np.flatnonzero((counts > 0) & (counts < size)):
        at, n = starts[doc], counts[doc]
        rolled[at] = (words[at : at + n] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
        whole[at] = True
    return mixed(rolled[whole]), np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each lower-cased text."""
    for _, rows in slices(column):
        hashes, counts = shingle_hashes(*word_hashes(rows, lower=True), size)
        ends = np.cumsum(counts)
        for begin, end in zip(ends - counts, ends):
            yield np.unique(hashes[begin:end])
