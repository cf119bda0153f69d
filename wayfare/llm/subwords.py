"""Hashed subword features of words, computed for many words at once, and what the text models share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def ngrams(words: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, hash, place) of every character n-gram of ``<word>``, and of each whole word.

    ``place`` is 0 inside a word, 1 for an n-gram that starts it, 2 for one that ends it, 3 for both or
    the whole word. n-grams of one size come in word order.
    """
    marked = "".join([f"<{w}>" for w in words])
    chars = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(chars))  # characters to the word's end
    first = np.zeros(len(chars), bool)
    first[starts] = True
    hashed = mixed(chars + np.uint64(0x9E3779B97F4A7C15))
    owners, hashes, places = [], [], []
    rolling = np.zeros(len(chars), np.uint64)
    for size in range(1, max(sizes) + 1):
        end = len(chars) - size + 1
        if end <= 0:
            break
        # rolling[i] covers chars[i : i + size]
        rolling = rolling[:end] * np.uint64(0x100000001B3) + hashed[size - 1 :]
        if size not in sizes:
            continue
        at = np.flatnonzero(left[:end] >= size)
        owners.append(owner[at])
        hashes.append(mixed(rolling[at] + np.uint64(size)))
        places.append(first[at].astype(np.int8) + 2 * (left[at] == size).astype(np.int8))
    if len(words):
        # a whole word: its characters weighted by place, independent of where it stands
        place = np.arange(len(chars)) - np.repeat(starts, lengths)
        weighted = mixed(hashed + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        whole = np.add.reduceat(weighted, starts)
        owners.append(np.arange(len(words)))
        hashes.append(mixed(whole))
        places.append(np.full(len(words), 3, np.int8))
    if not owners:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty.astype(np.int8)
    return np.concatenate(owners), np.concatenate(hashes), np.concatenate(places)


# New words scored together: their features take about 500 bytes a word for the moment.
_SCORED_AT_ONCE = 4_000


class WordScores(dict):
    """word -> number of its row in :attr:`rows`, grown by whole batches of new words.

    ``score(words)`` gives one row of floats per word. Kept by a Python worker from task to task and
    emptied when ``most`` words are known.
    """

    def __init__(self, score: Callable[[list[str]], np.ndarray], width: int, most: int):
        super().__init__()
        self.score, self.most = score, most
        self.rows = np.zeros((1024, width), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        if not new:
            return
        start, end = len(self), len(self) + len(new)
        if end > len(self.rows):
            more = np.zeros((max(end, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]), np.float32)
            self.rows = np.concatenate([self.rows, more])
        for at in range(0, len(new), _SCORED_AT_ONCE):
            part = new[at : at + _SCORED_AT_ONCE]
            self.rows[start + at : start + at + len(part)] = self.score(part)
        self.update(zip(new, range(start, end)))

    def numbers(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of the texts laid end to end, and the length of each text."""
        self.learn({w for words in texts for w in words})
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        return flat, lengths


def slices(column: pa.Array, words_of: Callable[[str | None], list[str]], most: int = 100_000) -> Iterator[list[list[str]]]:
    """The texts of a column as word lists, so many at a time that together they have about ``most`` words."""
    held: list[list[str]] = []
    size = 0
    for text in column:
        words = words_of(text.as_py())
        held.append(words)
        size += len(words)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
