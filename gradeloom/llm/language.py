"""Language identification by prediction by partial matching over bytes.

A context tree per language holds how often each byte follows each context of up to ``ORDER`` bytes. A byte's
probability in a context is c / (n + d); the escape to the next shorter context has d / (n + d) (d: distinct bytes
seen there), spread over the bytes not seen in the longer context by the shorter context's probabilities; below the empty context
all 256 bytes are alike. A context that was never seen passes on to the shorter one at no cost. So the
probabilities of each context sum to one and -log2 of them are code lengths. Statistics are frozen after training: a
text's code length under each language is the sum over all its bytes, and the shortest wins.

Trees are sparse: for each order the grams that occur, as sorted numbers, with their probabilities, and the contexts with their
escapes (``Tree``). A process keeps the code lengths of the grams that it met in a hash table, so that a gram is worked out once.

Before that a text is normalised: A-Z become a-z, and each run of ASCII bytes that aren't letters becomes one blank, as digits,
marks and layout say nothing about a language. Then every byte of the whole text is coded, repeated lines too.

Sentences that the sample holds under two languages (quotations, notices, shared passages) say nothing about language:
each counts once in every tree, so that all languages expect it. Repeats of a sentence count once in training.

Training reads a bounded sample of the rows allowed by the caller: ``TRAIN_DOCS`` documents a language and ``TRAIN_TOTAL`` in all
(places that small languages leave go to the others), the first by a hash of the text, whatever their length; copies count as one. Of a text
of more than ``TRAIN_BYTES`` bytes it reads that many, as sentences picked by hash from all over the text (``excerpt``): the sample goes to the
driver, so its bytes must be bounded as well as its rows. The trees that are broadcast grow with that sample, not with the corpus. The order is the same for any number of languages.

Defined cases: null text or text with no letter gets ``und`` and score 0. With no training rows every text is ``und``.
Ties go to the first language by name. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import fields
from .scratch import own as own_column
from .textkernel import HashTable, mix

ORDER = 4
TRAIN_DOCS = 1_500
TRAIN_TOTAL = 8_000
TRAIN_BYTES = 30_000
#: Characters of a piece of a sentence that is too long to be picked as a whole.
PIECE = 500
#: Bytes in one step of scoring and of counting.
STEP_BYTES = 2_000_000
#: Grams whose code lengths a process keeps; with more it starts anew.
KEPT_GRAMS = 1_000_000
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")

BLANK = 32
NORMAL = np.full(256, BLANK, dtype=np.uint8)
NORMAL[97:123] = NORMAL[65:91] = np.arange(97, 123, dtype=np.uint8)
NORMAL[128:] = np.arange(128, 256, dtype=np.uint8)


def normalised(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of texts, a blank before each of them, and where each text's bytes start (one more entry than texts)."""
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    raw = NORMAL[np.frombuffer(b" " + b" ".join(parts), dtype=np.uint8)]
    first = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != BLANK) | (raw[:-1] != BLANK)
    keep[first[:-1]] = True  # a text's own blank
    begin = np.concatenate([[0], np.cumsum(keep)])[first]
    return raw[keep], begin


def gram_keys(data: np.ndarray, begin: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A number per byte: the byte with the ``order`` bytes before it; before a text's first byte there are blanks."""
    keys = data.astype(np.uint64)
    for back in range(1, order + 1):
        before = np.full(len(data), BLANK, dtype=np.uint64)
        before[back:] = data[:-back] if back < len(data) else data[:0]
        for k in range(back):  # bytes of the text before count as blanks
            at = begin[:-1] + k
            before[at[at < begin[1:]]] = BLANK
        keys |= before << np.uint64(8 * back)
    return keys


class Tree(NamedTuple):
    """Per order from 0 on: grams (ascending) with their probabilities, contexts (ascending) with what an escape is multiplied by."""

    grams: list[np.ndarray]
    probabilities: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def count_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The grams of full order that occur, ascending, with their counts."""
    keys, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(text.encode())
        size += len(held[-1]) + 1
        if size >= STEP_BYTES or i + 1 == len(texts):
            own, n = np.unique(gram_keys(*normalised(held), order), return_counts=True)
            both, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keys, held, size = both, [], 0
    return keys, counts


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def plant(keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Tree:
    """The tree of a language from its grams of full order; shorter contexts have the sums of the longer ones."""
    tree = Tree([], [], [], [])
    for k in range(order + 1):
        grams, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(at, counts, len(grams))
        contexts, own = np.unique(grams >> np.uint64(8), return_inverse=True)
        n, d = np.bincount(own, c, len(contexts)), np.bincount(own, minlength=len(contexts)).astype(np.float64)
        if k:
            lower = tree.probabilities[-1][np.searchsorted(tree.grams[-1], grams & np.uint64((1 << 8 * k) - 1))]
        else:
            lower = np.full(len(grams), 1 / 256)
        full = d == 256
        rest = np.where(full, 1.0, 1.0 - np.bincount(own, lower, len(contexts)))
        tree.grams.append(grams)
        tree.probabilities.append(c / np.where(full, n, n + d)[own])
        tree.contexts.append(contexts)
        tree.escapes.append(np.where(full, 0.0, d / (n + d) / rest))
    return tree


def probability(tree: Tree, grams: np.ndarray, order: int) -> np.ndarray:
    """Probability of each gram's last byte after the ``order`` bytes before it."""
    if order < 0:
        return np.full(len(grams), 1 / 256)
    grams = grams & np.uint64((1 << 8 * (order + 1)) - 1)
    at, hit = _find(tree.grams[order], grams)
    out = np.empty(len(grams))
    out[hit] = tree.probabilities[order][at[hit]]
    gap = np.flatnonzero(~hit)
    if len(gap):
        at, known = _find(tree.contexts[order], grams[gap] >> np.uint64(8))
        out[gap] = probability(tree, grams[gap], order - 1) * np.where(known, tree.escapes[order][at] if len(tree.escapes[order]) else 1.0, 1.0)
    return out


class Coder:
    """Code lengths, in bits, of grams under each language of a model. Grams once met are rows of a hash table."""

    def __init__(self, model: dict):
        self.order = model["order"]
        self.trees = [plant(keys, counts, self.order) for keys, counts in model["trees"]]
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable()
        self.bits = np.empty((len(self.trees), 1 << 16))

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Row of each gram in ``bits``."""
        marks = mix(grams)  # one to one
        found = self.table.find(marks)
        gap = np.flatnonzero(found < 0)
        if not len(gap):
            return found
        if self.table.size > KEPT_GRAMS:
            self._clear()
            gap = np.arange(len(grams))
        new, one = np.unique(marks[gap], return_index=True)
        first, last = self.table.size, self.table.size + len(new)
        while self.bits.shape[1] < last:
            self.bits = np.concatenate([self.bits, np.empty_like(self.bits)], axis=1)
        for k, tree in enumerate(self.trees):
            self.bits[k, first:last] = -np.log2(probability(tree, grams[gap[one]], self.order))
        self.table.add(new)
        found[gap] = self.table.find(marks[gap])
        return found


_CODERS: dict[str, Coder] = {}


def coder(model: dict) -> Coder:
    """This process's coder of a model; the model itself holds gram counts alone."""
    if model["key"] not in _CODERS:
        _CODERS.clear()
        _CODERS[model["key"]] = Coder(model)
    return _CODERS[model["key"]]


def text_code_lengths(texts: list[str], model: dict) -> np.ndarray:
    """Bits of each whole text under each language."""
    own = coder(model)
    data, begin = normalised([t.encode() for t in texts])
    rows = own.rows(gram_keys(data, begin, own.order))
    return np.stack([np.add.reduceat(bits[rows], begin[:-1]) for bits in own.bits], axis=1)


def excerpt(text: str, most: int = TRAIN_BYTES) -> str:
    """The text, or of a longer one distinct sentences of at most ``most`` bytes, picked by hash and left in their order."""
    if len(text.encode()) <= most:
        return text
    pieces = list(dict.fromkeys(s[i : i + PIECE] for s in SENTENCE.split(text) for i in range(0, len(s), PIECE)))
    left, picked = most, []
    for at in sorted(range(len(pieces)), key=lambda k: (zlib.crc32(pieces[k].encode()), k)):
        left -= len(pieces[at].encode()) + 1
        if left < 0:
            break
        picked.append(at)
    return "\n".join(pieces[at] for at in sorted(picked))


def _excerpts(docs: DataFrame) -> DataFrame:
    def cut(batches):
        for batch in batches:
            yield batch.set_column(1, "text", pa.array([excerpt(t) for t in batch.column(1).to_pylist()], pa.string()))

    return docs.select("lang", "text", "mark").mapInArrow(cut, "lang string, text string, mark long")


def places(sizes: dict[str, int]) -> dict[str, int]:
    """Documents to learn from, of each language: TRAIN_DOCS at most, TRAIN_TOTAL in all, the same for all languages that have as many."""
    out: dict[str, int] = {}
    left = TRAIN_TOTAL
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, TRAIN_DOCS, left // (len(sizes) - i)))
        left -= out[lang]
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> dict:
    """The grams of all languages of ``docs``, from a bounded sample."""
    fit = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    mark = F.xxhash64("text")
    sizes = {r["lang"]: r["count"] for r in fit.groupBy("lang").agg(F.approx_count_distinct(mark).alias("count")).collect()}
    if not sizes:
        return {"key": "none", "langs": [], "trees": [], "order": order}
    wanted = places(sizes)
    shares = fit.sparkSession.createDataFrame([(lang, min(1.0, 2.0 * wanted[lang] / n), wanted[lang]) for lang, n in sizes.items()], "lang string, share double, places int")
    # about twice the rows wanted, then exactly the first of each language
    near = fit.withColumn("mark", mark).join(F.broadcast(shares), "lang").where((F.pmod("mark", F.lit(1 << 20)) / float(1 << 20)) <= F.col("share"))
    once = _excerpts(near).groupBy("lang", "mark").agg(F.min("text").alias("text"))  # copies take one place
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "text"))
    first = once.withColumn("nth", nth).join(F.broadcast(shares), "lang").where("nth <= places")
    texts: dict[str, list[str]] = {}
    for row in first.select("lang", "text").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    langs = sorted(texts)
    own = {lang: dict.fromkeys(s for t in texts[lang] for s in SENTENCE.split(t) if s) for lang in langs}
    held: dict[str, int] = {}
    for lang in langs:
        for s in own[lang]:
            held[s] = held.get(s, 0) + 1
    shared = [s for s, n in held.items() if n > 1]
    trees = [count_grams([*own[lang], *(s for s in shared if s not in own[lang])], order) for lang in langs]
    key = "-".join(f"{lang}:{len(k)}:{int(c.sum())}:{int((k.astype(np.int64) * c).sum())}" for lang, (k, c) in zip(langs, trees))
    return {"key": key, "langs": langs, "trees": trees, "order": order}


def predict(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score`` (the winner's posterior under equal priors)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # gram counts: bounded by the training sample
    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("__text")

    def score(batches):
        from .wordbpe import text_slices

        model = shared.value
        names = np.array([*model["langs"], "und"], dtype=object)
        for batch in batches:
            for first, texts in text_slices(batch.column(batch.num_columns - 1), STEP_BYTES):
                known = np.array([t is not None for t in texts]) & bool(model["langs"])
                best, sure = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
                if known.any():
                    bits = text_code_lengths([t for t in texts if t is not None], model)
                    best[known] = bits.argmin(1)
                    sure[known] = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                kept = [c.slice(first, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(sure)], names=[*keep, "lang_pred", "score"])

    return docs.select(*map(own_column, keep), text).mapInArrow(score, fields(docs, keep, "lang_pred string, score double"))


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Train on the rows outside the held-out fold (crc32 of doc_id as text), predict every row."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    base = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(base, train(base.where(~F.col("held_out"))), ["doc_id", "held_out"])
