"""Which of many words a text holds, in one pass over the text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

try:
    import ahocorasick
except ImportError:  # each word is looked for alone
    ahocorasick = None


def finder(words: Sequence[str]) -> Callable[[str], list[int]]:
    """A function from a text to the places, ascending, of the words that are in it. All words are found by one automaton."""
    if ahocorasick is None:
        return lambda text: [i for i, w in enumerate(words) if w in text]
    automaton = ahocorasick.Automaton()
    for i, w in enumerate(words):
        automaton.add_word(w, i)
    automaton.make_automaton()
    return lambda text: sorted({i for _, i in automaton.iter(text)})


def of_distinct(texts: pa.Array, make: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """``make`` of each text of an Arrow batch, nulls too, made once for each distinct one."""
    coded = texts.dictionary_encode(null_encoding="encode")
    return pa.array([make(t.as_py()) for t in coded.dictionary], kind).take(coded.indices)


def found_words(text: Column, words: Sequence[str]) -> Column:
    """Places in ``words`` (distinct, none empty) of those that a text holds; null texts hold none. Texts are taken from their Arrow batch one at a time, so a batch is never held twice."""
    words = list(words)
    held: list = []

    @F.arrow_udf(ArrayType(IntegerType()))
    def found(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(finder(words))
        return pa.array([held[0](t.as_py()) if t.is_valid else [] for t in texts], pa.list_(pa.int32()))

    return found(text)


def holds(found: Column, words: Sequence[str], known: Sequence[str]) -> Column:
    """One of ``words`` is among the ``found`` places of ``known``."""
    places = {w: i for i, w in enumerate(known)}
    return F.arrays_overlap(found, F.array(*(F.lit(places[w]) for w in words)))
