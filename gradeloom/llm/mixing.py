"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves of a tree domain - language - source. A budget of tokens runs down the tree: at each node the children get
shares by weight, none more than its subtree holds (its tokens times ``epochs``), and what one can't take goes to its siblings
by weight. As a child's limit is its whole subtree's, a shortage stays among the siblings below a node until all of
them are full, and only then reaches the node's own siblings. The shares have a closed form by running sums over the children in order
of limit / weight, so all nodes of a level are settled by one window.

A leaf's budget is whole epochs of its documents and a rest. Each epoch has its own order, a hash of seed, epoch and document, and
the rest is the token-prefix of the first epoch that isn't whole: the documents up to a cut, whose last one is taken in part. Finding the cut sums
tokens by leaf and hash bucket first, so that of a leaf with a third of all rows only the bucket with the cut is looked at, then the bucket of that with the cut, and so on; what is sorted at last is a small part.

Defined cases: null language or source is the node ``""``; the domain follows from the source. Null and empty texts have the end id
alone. Weights that aren't given are 1; weight 0 or less takes nothing. Rests below one token a leaf are dropped. Repeated
rows count each; rows equal in doc_id and text are interchangeable. Rows with a null doc_id take part like others. Empty tables give empty results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, own
from .wordbpe import encoder, text_slices

LEVELS = ("domain", "lang", "source")
#: Hash buckets of a leaf, by bits of a row's turn: of the bucket with the cut only such a part is looked at, in each of some steps.
BUCKET_BITS = 8
STEPS = 3
SEED = 5
#: Leaves that are broadcast; with more, documents and leaves are joined by shuffle.
BROADCAST_LEAVES = 50_000

#: The production query's weights by level and name; its domains are groups of sources by their number.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "es": 1.5, "fr": 1.5}, "source": {}}


def domain_of(source: Column) -> Column:
    """d0 to d3 by the number at the end of a source's name; ``other`` without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))


def with_leaves(docs: DataFrame) -> DataFrame:
    """``docs`` with their leaf: columns ``leaf_domain``, ``leaf_lang``, ``leaf_source``."""
    return docs.withColumns(
        {"leaf_domain": domain_of(F.col("source")), "leaf_lang": F.coalesce(F.col("lang"), F.lit("")), "leaf_source": F.coalesce(F.col("source"), F.lit(""))}
    )


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), leaf and ``tokens`` (with the end id) of each row."""

    def count(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(batch.num_columns - 1)):
                n = [len(x) // 4 + 1 for x in encoder(tokenizer).encode(texts)]
                kept = [c.slice(first, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=["doc_id", "mark", *(f"leaf_{k}" for k in LEVELS), "tokens"])

    rows = with_leaves(docs).select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text")).alias("mark"), *(f"leaf_{k}" for k in LEVELS), "text")
    return rows.mapInArrow(count, "doc_id long, mark long, leaf_domain string, leaf_lang string, leaf_source string, tokens long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(f"leaf_{level}") == name, F.lit(float(w))).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Add ``share`` to nodes with ``budget`` (their parent's), ``weight`` and ``limit``.

    In ascending order of limit / weight, ``level`` is what a weight of 1 would get if all nodes before were full; the greatest
    level is the one at which the budget is used up (or all are full)."""
    live = F.col("weight") > 0
    ratio = F.when(live, F.col("limit") / F.col("weight"))
    order = Window.partitionBy(*parents).orderBy(ratio.asc_nulls_last(), *(F.col(c) for c in nodes.columns if c.startswith("leaf_")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.when(live, F.col("weight")).otherwise(0.0)
    level = F.try_divide(F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.sum(weight).over(after))
    leveled = nodes.withColumn("level", F.when(live, level))
    top = F.max("level").over(Window.partitionBy(*parents))
    return leveled.withColumn("share", F.when(live, F.greatest(F.lit(0.0), F.least("limit", F.col("weight") * top))).otherwise(0.0)).drop("level")


def leaf_budgets(tokens: DataFrame, weights: dict[str, dict[str, float]], share: float, epochs: int) -> DataFrame:
    """Per leaf: its ``tokens``, and its budget as ``full`` epochs and a ``rest`` of tokens.

    The whole budget is ``share`` of all tokens."""
    names = [f"leaf_{k}" for k in LEVELS]
    leaves = materialise(tokens.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix-leaves", small=True)
    total = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    budget: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        own = names[: depth + 1]
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * float(epochs)).alias("limit")).withColumn("weight", _weight(level, weights))
        nodes = nodes.withColumn("budget", F.lit(float(share * total))) if budget is None else nodes.join(budget, names[:depth])
        parents = names[:depth] or [F.lit(0).alias("root")]
        budget = fill(nodes, parents).select(*own, F.col("share").alias("budget"))
    settled = leaves.join(budget, names).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))
    full = F.floor(F.col("budget") / F.col("tokens")).cast("int")
    return settled.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))


def turn(epoch: Column, seed: int = SEED) -> Column:
    """A row's place in an epoch's order."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("doc_id"), F.col("mark"))


def mixing_plan(tokens: DataFrame, weights: dict[str, dict[str, float]], share: float, epochs: int, seed: int = SEED) -> DataFrame:
    """Leaf budgets with the cut of the rest: ``cut_turn``, ``cut_id``, ``cut_mark``, and ``cut_take``, the tokens taken of that document."""
    names = [f"leaf_{k}" for k in LEVELS]
    plan = materialise(leaf_budgets(tokens, weights, share, epochs), "mix-budgets", small=True)
    small = plan.count() <= BROADCAST_LEAVES
    partial = plan.where("rest > 0").select(*names, "full", "rest")
    rows = tokens.join(F.broadcast(partial) if small else partial, names).withColumn("turn", turn(F.col("full"), seed)).drop("rest", "full")
    start = partial.select(*names, "rest", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("bucket"))
    for step in range(STEPS):  # rows of the cut's bucket, its buckets' sums, and the one that holds the cut
        keys = names if step == 0 else [*names, "bucket"]
        inside = rows if step == 0 else rows.withColumn("bucket", F.shiftright("turn", 64 - step * BUCKET_BITS))
        near = inside.join(F.broadcast(start) if small else start, keys).withColumn("finer", F.shiftright("turn", 64 - (step + 1) * BUCKET_BITS))
        sums = near.groupBy(*names, "start", "finer", "rest").agg(F.sum("tokens").alias("n"))
        before = Window.partitionBy(*names).orderBy("finer").rowsBetween(Window.unboundedPreceding, -1)
        ends = sums.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        start = materialise(ends.where("start < rest and rest <= start + n").select(*names, "rest", "start", F.col("finer").alias("bucket")), "mix-cut", small=True)
    rows = rows.withColumn("bucket", F.shiftright("turn", 64 - STEPS * BUCKET_BITS))
    own = Window.partitionBy(*names).orderBy("turn", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.join(F.broadcast(start) if small else start, [*names, "bucket"]).withColumn("end", F.col("start") + F.sum("tokens").over(own))
    cut = inside.where("end - tokens < rest and rest <= end").select(
        *names, F.col("turn").alias("cut_turn"), F.col("doc_id").alias("cut_id"), F.col("mark").alias("cut_mark"), (F.col("rest") - F.col("end") + F.col("tokens")).alias("cut_take")
    )
    return plan.join(cut, names, "left")


def selected(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (with leaf, ``doc_id`` and ``mark``) once for each epoch that takes them: adds ``epoch`` and ``cut_take`` (null: whole)."""
    names = [f"leaf_{k}" for k in LEVELS]
    cuts = plan.select(*names, "full", "rest", "cut_turn", "cut_id", "cut_mark", "cut_take")
    few = plan.count() <= BROADCAST_LEAVES
    joined = rows.join(F.broadcast(cuts) if few else cuts, names)
    at = F.struct(F.col("turn").alias("a"), F.col("doc_id").alias("b"), F.col("mark").alias("c"))
    cut = F.struct(F.col("cut_turn").alias("a"), F.col("cut_id").alias("b"), F.col("cut_mark").alias("c"))
    once = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full")))).withColumn("turn", turn(F.col("epoch"), seed))
    inside = (F.col("epoch") < F.col("full")) | ((F.col("rest") > 0) & (at <= cut))
    whole = (F.col("epoch") < F.col("full")) | (at != cut)
    return once.where(inside).withColumn("cut_take", F.when(~whole, F.col("cut_take"))).select(*map(own, rows.columns), "epoch", "cut_take")


def mix(docs: DataFrame, tokenizer: str, end_id: int, weights: dict[str, dict[str, float]] | None = None, share: float = 0.8, epochs: int = 3) -> DataFrame:
    """A row for each document and epoch that is taken: leaf, ``epoch``, ``tokens``, and ``take``, the tokens of its prefix that are taken."""
    tokens = materialise(count_tokens(docs, tokenizer, end_id), "mix-tokens")
    plan = materialise(mixing_plan(tokens, weights or WEIGHTS, share, epochs), "mix-plan", small=True)
    taken = selected(tokens, plan)
    return taken.select(
        "doc_id",
        *(F.col(f"leaf_{k}").alias(k) for k in LEVELS),
        F.col("epoch").cast("int"),
        "tokens",
        F.coalesce("cut_take", "tokens").alias("take"),
    )


def mix_documents(docs: DataFrame, tokenizer: str, end_id: int, weights: dict[str, dict[str, float]] | None = None, share: float = 0.9) -> DataFrame:
    """The rows of ``docs`` that one epoch's budgets take, with all their columns; a document at a cut stays whole."""
    tokens = materialise(count_tokens(docs, tokenizer, end_id), "mix-tokens")
    plan = materialise(mixing_plan(tokens, weights or WEIGHTS, share, 1), "mix-plan", small=True)
    renamed = {c: f"__own_{c}" for c in docs.columns if c in ("mark", "turn", "epoch", "full", "rest") or c.startswith(("leaf_", "cut_"))}
    rows = with_leaves(docs.withColumnsRenamed(renamed)).withColumn("mark", F.xxhash64(F.col("text")))
    return selected(rows, plan).select(*(own(renamed.get(c, c)).alias(c) for c in docs.columns))
