"""Words and word hashes of many texts at once, on byte arrays.

Hashes are 64 bits: a polynomial over random byte values modulo 2**64, then mixed. They are the same on every machine.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed in one step; a longer word makes a longer step.
STEP = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
GRAM_FACTORS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            x = np.full(max(n, STEP + 1), base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def join_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with A-Z lowered, a line end before, between and after them; and where each text starts (one more
    entry than texts)."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    return LOWER[data], 1 + np.concatenate([[0], np.cumsum(sizes)])


def words(data: np.ndarray, blanks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't blanks; ``data`` starts and ends with a blank."""
    blank = blanks[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STEP, side="right")))
        base = int(starts[first])
        span = data[base : int(ends[last - 1])]
        up, down = powers(len(span) + 1)
        sums = np.empty(len(span) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_VALUES[span] * up[:-1], out=sums[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        first = last
    return out


def gram_hashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside each text, and how many each text has. ``counts``: words of each text.

    A text with 1 to n - 1 words has one gram, its whole sequence."""
    total = len(hashes)
    grams = np.maximum(counts - n + 1, np.minimum(counts, 1))
    out = np.empty(int(grams.sum()), dtype=np.uint64)
    first_word = np.concatenate([[0], np.cumsum(counts)])[:-1]
    first_gram = np.concatenate([[0], np.cumsum(grams)])[:-1]
    if total >= n:
        whole = np.zeros(total - n + 1, dtype=np.uint64)
        for k in range(n):
            whole += hashes[k : total - n + 1 + k] * GRAM_FACTORS[k]
        long = counts >= n
        starts = np.zeros(total + 1, dtype=np.int32)
        np.add.at(starts, first_word[long], 1)
        np.add.at(starts, first_word[long] + grams[long], -1)
        inside = np.cumsum(starts[:-1]) > 0
        at = np.ones(len(out), dtype=bool)
        at[first_gram[(counts > 0) & ~long]] = False
        out[at] = whole[inside[: total - n + 1]]
    for k in np.flatnonzero((counts > 0) & (counts < n)):
        own = hashes[first_word[k] : first_word[k] + counts[k]]
        mark = np.full(1, len(own), dtype=np.uint64) * BASE  # arrays wrap around without a warning
        out[first_gram[k]] = ((own * GRAM_FACTORS[: len(own)]).sum(dtype=np.uint64, keepdims=True) + mark)[0]
    return mix(out), grams


class HashTable:
    """64-bit keys to row numbers, by open addressing in arrays; whole arrays are looked up and added at once."""

    def __init__(self, bits: int = 16):
        self._make(bits)
        self.size = 0

    def _make(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        rows = self.rows[slot]
        open_ = np.flatnonzero((rows >= 0) & (self.keys[slot] != keys))
        while len(open_):
            at = (slot[open_] + 1) & self.mask
            slot[open_] = at
            rows[open_] = self.rows[at]
            open_ = open_[(rows[open_] >= 0) & (self.keys[at] != keys[open_])]
        return rows

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that aren't in the table; their rows follow on."""
        self._put(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
        self.size += len(keys)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        if 2 * (self.size + len(keys)) > len(self.keys):
            old_keys, old_rows = self.keys[self.rows >= 0], self.rows[self.rows >= 0]
            self._make((2 * (self.size + len(keys))).bit_length())
            self._put_all(old_keys, old_rows)
        self._put_all(keys, rows)

    def _put_all(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.rows[slot[left]] < 0
            ask = left[free]
            self.rows[slot[ask]] = rows[ask]  # of several the last stays
            won = self.rows[slot[ask]] == rows[ask]
            self.keys[slot[ask[won]]] = keys[ask[won]]
            left = np.concatenate([left[~free], ask[~won]])
            slot[left] = (slot[left] + 1) & self.mask
