"""Bitvectors with rank and select, for whole arrays of questions at once.

Bits are packed into 64-bit words. A directory has the ones before every block of eight words, a second one the ones before
every word inside its block, so ``rank`` reads two numbers and counts in one word, and ``select`` searches the
directory, looks at eight counts and halves one word six times. Beside the bits this takes 37 % more.
"""

from __future__ import annotations

import numpy as np

BLOCK_WORDS = 8


class BitVector:
    def __init__(self, bits: np.ndarray):
        """``bits``: booleans."""
        packed = np.packbits(bits, bitorder="little")
        words = -(-(len(bits) + 1) // (64 * BLOCK_WORDS)) * BLOCK_WORDS  # one position past the end can be asked for
        room = np.zeros(words * 8, dtype=np.uint8)
        room[: len(packed)] = packed
        self.words = room.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64).reshape(-1, BLOCK_WORDS)
        inside = np.cumsum(ones, axis=1)
        self.before_word = (inside - ones).astype(np.int16)
        self.before_block = np.concatenate([[0], np.cumsum(inside[:, -1])])

    @property
    def total(self) -> int:
        """Number of ones."""
        return int(self.before_block[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, dtype=np.int64)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before_block[word // BLOCK_WORDS] + self.before_word.reshape(-1)[word] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of each ``k``-th one, counted from 0."""
        k = np.asarray(k, dtype=np.int64)
        block = np.searchsorted(self.before_block, k, side="right") - 1
        left = k - self.before_block[block]
        inside = (self.before_word[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.before_word[block, inside]
        word = self.words[block * BLOCK_WORDS + inside]
        at = (block * BLOCK_WORDS + inside) * 64
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            upper = left >= low
            left = np.where(upper, left - low, left)
            word = np.where(upper, word >> np.uint64(half), word)
            at = at + half * upper
        return at
