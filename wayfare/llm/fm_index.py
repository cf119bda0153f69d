"""A compressed FM-index over a shard's word sequences, searched for many sequences at once.

The index keeps the Burrows-Wheeler transform in a wavelet matrix of packed bit vectors, the symbol counts, one
bit per suffix that marks where the first ``depth`` words change, and prefix sums of weights. Suffixes are ordered by
their first ``depth`` + 1 words, as far as searches look.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per binary digit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.digits = max(int(symbols - 1).bit_length(), 1)
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        for digit in reversed(range(self.digits)):
            bits = (sequence >> digit) & 1
            self.levels.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        everything = np.arange(symbols)
        self.origin = np.zeros(symbols, np.int64)
        self.origin = self._descend(everything, np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.digits - 1 - level)) & 1
            ones = bits.rank(at)
            at = np.where(one == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._descend(symbol, at) - self.origin[symbol]


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


class FMIndex:
    """Index of ``text`` (symbols from 1; 0 ends a sequence) for matches of ``depth`` words.

    ``weights[i]`` is how often the sequence with symbol i occurs in the shard.
    """

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int):
        n = len(text)
        self.size, self.depth = n, depth

        def shifted(ranks: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: max(n - by, 0)] = ranks[by:]
            return out

        # ranks by the first 1, 2, 4, ... words, then by depth and depth + 1 words from two that overlap
        ranks, reach = text.astype(np.int64) + 1, 1
        while 2 * reach <= depth:
            ranks = _ranked(ranks * (n + 2) + shifted(ranks, reach)) + 1
            reach *= 2
        whole = _ranked(ranks * (n + 2) + shifted(ranks, depth - reach)) + 1
        order = np.argsort(_ranked(whole * (n + 2) + shifted(ranks, depth + 1 - reach)), kind="stable")

        changes = np.ones(n, np.uint8)
        changes[1:] = whole[order[1:]] != whole[order[:-1]]
        self.blocks = BitVector(changes)
        self.block_starts = np.append(np.flatnonzero(changes), n)
        self.weight_before = np.concatenate([[0], np.cumsum(weights[order])])
        symbols = int(text.max()) + 1 if n else 1
        self.transform = WaveletMatrix(text[order - 1], symbols)  # text[-1] is an end mark
        counts = np.bincount(text, minlength=symbols)
        self.smaller = np.cumsum(counts) - counts

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffix ranges of ``symbol`` followed by what the ranges match."""
        base = self.smaller[symbol]
        both = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + both[: len(low)], base + both[len(low) :]

    def shortened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges that share the first ``depth`` words with the suffix at ``low``."""
        block = self.blocks.rank(low + 1) - 1
        return self.block_starts[block], self.block_starts[block + 1]

    def repeated(self, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place of ``text``: do the ``depth`` words from there weigh ``least`` in the index or more?

        The sequences at ``starts`` are streamed from right to left, all in step. A sequence's statistic is its match's
        length, capped at ``depth``: each word extends the match to the left, and a match longer than ``depth`` is cut on its
        right by moving to its block. A sequence whose match fails begins anew with its next word.
        """
        found = np.zeros(len(text), bool)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size)
        matched = np.zeros(len(starts), np.int64)
        for step in range(int(lengths.max()) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths, -step, side="left"))
            place = starts[:active] + lengths[:active] - 1 - step
            lows, highs = self.extended(text[place], low[:active], high[:active])
            grown = matched[:active] + 1
            lost = lows >= highs
            if lost.any():
                lows[lost], highs[lost], grown[lost] = 0, self.size, 0
            long = grown > self.depth
            if long.any():
                lows[long], highs[long] = self.shortened(lows[long])
                grown[long] = self.depth
            low[:active], high[:active], matched[:active] = lows, highs, grown
            full = grown == self.depth
            weight = self.weight_before[highs[full]] - self.weight_before[lows[full]]
            found[place[full]] = weight >= least
        return found
