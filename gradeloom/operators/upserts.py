"""Resuming, merging and deduplicating by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import folded


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a finished row."""
    return tasks.join(done.select(*keys), keys, "left_anti")


def finished(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks with a finished row."""
    return tasks.join(done.select(*keys), keys, "left_semi")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``. An aggregate: it combines before the shuffle and sorts nothing."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in rest)).select(*log.columns)


def keep_last_at_first(log: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key, at the position of its first."""
    rest = [c for c in log.columns if c not in (*keys, position)]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("row"), F.min(position).alias(position))
    return best.select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in rest), position).select(*log.columns)


def keep_first(rows: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; null keys are equal to each other."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = rows.select("*", *((F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)))
    best = keyed.groupBy(*names).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return best.select(*(F.col(f"row.`{c}`").alias(c) for c in rows.columns))


def keep_first_folded(rows: DataFrame, text: str, by: list[str], order: list[str]) -> DataFrame:
    """The first spelling of each text that differs in case or white space alone."""
    return keep_first(rows, [*by, folded(F.col(text))], order)


def merge(old: DataFrame, new: DataFrame, keys: list[str], position: str | None = None) -> DataFrame:
    """Rows of ``old`` replaced by rows of ``new`` with their key, and new keys added; with ``position``, replaced rows keep their place
    and added ones follow the last."""
    rest = [c for c in old.columns if c not in keys and c != position]
    a = old.withColumn("__old", F.lit(True)).alias("a")
    b = new.withColumn("__new", F.lit(True)).alias("b")
    both = a.join(b, keys, "full_outer")
    pick = [F.when(F.col("b.__new"), F.col(f"b.`{c}`")).otherwise(F.col(f"a.`{c}`")).alias(c) for c in rest]
    if position is None:
        return both.select(*keys, *pick).select(*old.columns)
    last = old.agg(F.coalesce(F.max(position), F.lit(-1)).alias("__last"))
    place = F.coalesce(F.col(f"a.{position}"), F.col("__last") + 1 + F.col(f"b.{position}")).alias(position)
    return both.join(F.broadcast(last)).select(*keys, *pick, place).select(*old.columns)


def ordered_union(parts: list[DataFrame], position: str) -> DataFrame:
    """Rows of all parts, in the order of the parts and of ``position`` inside them (``part``, ``position``)."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge_specs(checks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Checks of several specs, the first of each check_id."""
    return keep_first(checks, [*by, "check_id"], order)


def duplicate_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def restore_order(rows: DataFrame, position: str) -> DataFrame:
    """Input order, at the sink alone."""
    return rows.orderBy(position)


def first_match(rows: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    """The first row that fits, as one row (none without a match)."""
    best = rows.where(condition).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return best.where("row is not null").select("row.*")


def first_n_per(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
