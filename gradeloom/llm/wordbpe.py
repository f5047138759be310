"""Whole-text token ids from a tokenizer file, with a bounded cache of word encodings.

The tokenizer of ``word_bpe_49k.json`` never joins characters across white space: it folds white space, lower-cases,
cuts the text into runs of letters, digits and marks, and merges pairs inside a run. So a text's ids are the ids of its
pieces between blanks and line ends, one after the other, and each distinct piece needs the tokenizer once. ASCII is
lower-cased first, which the tokenizer does anyway. Texts that hold the start of a special token's string (``<|``) go
to the tokenizer whole. ``exact_by_words`` states for which tokenizers this holds; others are called on whole texts.
"""

from __future__ import annotations

import json
import os
from unicodedata import is_normalized

import numpy as np
import regex

from .textkernel import HashTable, join_texts, word_hashes, words

#: Words in the cache (about 60 MB) and runs kept as text beside it.
CACHE_WORDS = 800_000
RUN_WORDS = 50_000
# Fixed value: how word_bpe_49k.json cuts text into runs.
RUNS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RUNS = regex.compile(RUNS_PATTERN)
CUTS = np.zeros(256, dtype=bool)
CUTS[[10, 32]] = True


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: visible Latin-1 characters stand for
    themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


def exact_by_words(spec: dict) -> bool:
    """True if ids of a text are the ids of its pieces between blanks: no prefix, no pattern across white space."""
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and spec["normalizer"]["normalizers"][1].get("pattern") == {"Regex": "\\s+"}
        and bool(splits)
        and splits[0].get("type") == "Split"
        and splits[0].get("pattern") == {"Regex": RUNS_PATTERN}
        and splits[0].get("behavior") == "Removed"
        and splits[0].get("invert") is True
        and [s.get("type") for s in splits[1:]] == ["ByteLevel"]
        and not splits[1].get("add_prefix_space")
        and not splits[1].get("use_regex")
        and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    )


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    Known words are rows of a hash table (64-bit word hashes) that point into one array of ids. Beyond ``cache_words``
    the table starts anew; that changes the speed alone."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; the task's core is its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = exact_by_words(json.load(f))
        self.cache_words = cache_words
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable()
        self.ids = np.empty(1 << 16, dtype="<u4")
        self.ends = np.zeros(1 << 16, dtype=np.int64)  # of row i: ids[ends[i] : ends[i + 1]]
        self.runs: dict[str, list[int]] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, word: bytes) -> list[str] | None:
        """The runs that the tokenizer cuts a word into, if it leaves their letters as they are; else null.

        That holds for visible characters below U+0250 that are lower-case and composed."""
        if word.isalpha():
            return [word.decode()]
        s = word.decode()
        if s.isascii():
            return RUNS.findall(s) if s.isprintable() else None
        plain = max(s) < "\u0250" and s.isprintable() and s == s.lower() and is_normalized("NFC", s)
        return ([s] if s.isalpha() else RUNS.findall(s)) if plain else None

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add words to the table. Runs go to the tokenizer's model at once, other words through all its steps."""
        if len(self.runs) > RUN_WORDS:
            self.runs = {}
        known, tokenize = self.runs, self.tokenizer.model.tokenize
        sizes, whole, flat = np.empty(len(words), dtype=np.int64), [], []
        for i, w in enumerate(words):
            before = len(flat)
            pieces = self._pieces(w)
            if pieces is None:
                whole.append(i)
            else:
                for p in pieces:
                    ids = known.get(p)
                    if ids is None:
                        ids = known[p] = [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LETTERS))]
                    flat += ids
            sizes[i] = len(flat) - before
        if whole:  # they come last
            order = np.concatenate([np.setdiff1d(np.arange(len(words)), whole), whole])
            found = self._whole([words[i].decode() for i in whole])
            sizes[whole] = [len(x) for x in found]
            hashes, sizes = hashes[order], sizes[order]
        new = np.concatenate([np.array(flat, dtype="<u4"), *(found if whole else [])])
        rows, used = self.table.size, int(self.ends[self.table.size])
        while len(self.ids) < used + len(new):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.ends) < rows + len(words) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(new)] = new
        self.ends[rows + 1 : rows + len(words) + 1] = used + np.cumsum(sizes)
        self.table.add(hashes)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text; a null text has none."""
        if not self.by_words:
            return [x.tobytes() for x in self._whole([t or "" for t in texts])]
        special = [i for i, t in enumerate(texts) if t and "<|" in t]
        plain = [None if t and "<|" in t else t for t in texts] if special else texts
        data, first = join_texts(plain)
        starts, ends = words(data, CUTS)
        hashes = word_hashes(data, starts, ends)
        if self.table.size > self.cache_words:
            self._clear()
        rows = self.table.find(hashes)
        gaps = np.flatnonzero(rows < 0)
        if len(gaps):
            new, one = np.unique(hashes[gaps], return_index=True)
            raw = data.tobytes()
            self._learn(new, [raw[a:b] for a, b in zip(starts[gaps[one]].tolist(), ends[gaps[one]].tolist())])
            rows[gaps] = self.table.find(hashes[gaps])
        begin = self.ends[rows]
        sizes = self.ends[rows + 1] - begin
        done = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(begin - done[:-1], sizes) + np.arange(done[-1])]
        cut = done[np.searchsorted(starts, first)]
        out = [flat[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        if special:
            for i, ids in zip(special, self._whole([texts[i] for i in special])):
                out[i] = ids.tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop this process's encoders: Python workers are reused by later stages, which have no use for their caches."""
    _ENCODERS.clear()


def text_slices(column, most_bytes: int = 1_000_000):
    """Slices of an Arrow string column whose texts together stay near ``most_bytes``: yields (first row, texts)."""
    texts, first, size = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py()
        texts.append(text)
        size += len(text) if text else 0
        if size >= most_bytes:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts
