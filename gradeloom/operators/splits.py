"""Splits that keep the environments of a task together."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("train", "dev", "test")


def normalized(ratios: dict[str, float]) -> dict[str, float]:
    """Ratios that sum to 1; 0.7 / 0.1 / 0.2 if they sum to nothing."""
    total = sum(ratios.get(n, 0.0) for n in NAMES)
    if total <= 0:
        return dict(zip(NAMES, (0.7, 0.1, 0.2)))
    return {n: ratios.get(n, 0.0) / total for n in NAMES}


def quotas(groups: int, ratios: dict[str, float]) -> dict[str, int]:
    """Groups of each split. From three groups on, a split with a ratio isn't left empty; train is never empty if it has one."""
    r = normalized(ratios)
    n = {"train": int(groups * r["train"]), "dev": int(groups * r["dev"])}
    if groups >= 3 and r["dev"] > 0:
        n["dev"] = max(n["dev"], 1)
    n["test"] = groups - n["train"] - n["dev"]
    if groups >= 3 and n["test"] == 0 and r["test"] > 0:
        n["test"] = 1
        giver = next((s for s in ("train", "dev") if n[s] > 1), None)
        if giver:
            n[giver] -= 1
    if groups and n["train"] == 0 and r["train"] > 0:
        n["train"] = 1
        giver = next((s for s in ("test", "dev") if n[s] > 0), None)
        if giver:
            n[giver] -= 1
    n["dev"] = max(0, min(n["dev"], groups - n["train"]))  # train comes first where the rules ask for more than there is
    n["test"] = groups - n["train"] - n["dev"]
    return n


def group_key(task: str = "original_task_id", env: str = "env_id") -> Column:
    return F.coalesce(F.nullif(F.col(task), F.lit("")), F.col(env))


def ranked_groups(rows: DataFrame, key: Column, order: Column) -> tuple[DataFrame, int]:
    """Distinct keys with their rank by ``order`` (0-based), and their number.

    Ranks come from counts of 256 buckets of the order's first byte (two hexadecimal digits), so no task holds all keys."""
    groups = rows.select(key.alias("group_key")).distinct().withColumn("order", order)
    groups = groups.withColumn("bucket", F.substring("order", 1, 2))
    sizes = groups.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # at most 256 rows
    starts, run = [], 0
    for r in sorted(sizes, key=lambda r: r["bucket"]):
        starts.append((r["bucket"], run))
        run += r["n"]
    start = rows.sparkSession.createDataFrame(starts or [("", 0)], "bucket string, start long")
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("order", "group_key")) - 1
    return groups.join(F.broadcast(start), "bucket").select("group_key", (F.col("start") + inside).alias("rank")), run


def assign_splits(rows: DataFrame, ratios: dict[str, float], seed: int = 1337, key: Column | None = None) -> DataFrame:
    """``rows`` with ``group_key`` and ``split``. Groups are ordered by an MD5 of seed and key, which needs no driver."""
    key = group_key() if key is None else key
    ranks, n = ranked_groups(rows, key, F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_key").cast("string")).cast("binary")))
    q = quotas(n, ratios)
    split = F.when(F.col("rank") < q["train"], "train").when(F.col("rank") < q["train"] + q["dev"], "dev").otherwise("test")
    return rows.withColumn("group_key", key).join(ranks, "group_key").withColumn("split", split).drop("rank")


def assign_splits_seeded(rows: DataFrame, ratios: dict[str, float], seed: int = 1337, key: Column | None = None, most: int = 1_000_000) -> DataFrame:
    """The same with the order of Python's seeded shuffle of the keys by first appearance (``row_idx``). Keys go to the driver: at most ``most``."""
    key = group_key() if key is None else key
    keys = rows.groupBy(key.cast("string").alias("group_key")).agg(F.min("row_idx").alias("first")).orderBy("first").limit(most + 1).collect()
    if len(keys) > most:
        raise ValueError(f"more than {most} groups: use assign_splits")
    names = [r["group_key"] for r in keys]
    random.Random(seed).shuffle(names)
    q = quotas(len(names), ratios)
    place = [(k, "train" if i < q["train"] else "dev" if i < q["train"] + q["dev"] else "test") for i, k in enumerate(names)]
    table = rows.sparkSession.createDataFrame(place, "group_key string, split string")
    return rows.withColumn("group_key", key.cast("string")).join(table, "group_key")


def split_counts(rows: DataFrame) -> DataFrame:
    """Environments and groups of each split, zero-filled."""
    fixed = rows.sparkSession.createDataFrame([(n,) for n in NAMES], "split string")
    per = rows.groupBy("split").agg(F.count("*").alias("envs"), F.count_distinct("group_key").alias("groups"))
    return fixed.join(per, "split", "left").select("split", F.coalesce("envs", F.lit(0)).alias("envs"), F.coalesce("groups", F.lit(0)).alias("groups"))


def assigned_split(dataset_split: Column, split: Column) -> Column:
    """The assigned split, else the row's own, else train; an unknown name is train."""
    name = F.lower(F.coalesce(dataset_split, split))
    return F.when(name.isin(*NAMES), name).otherwise("train")


def select_split(rows: DataFrame, name: str) -> DataFrame:
    """Rows of one split; an error if no row has a split at all."""
    if rows.where(F.col("split").isNotNull()).isEmpty():
        raise ValueError("no row has a split; assign splits first")
    return rows.where(F.col("split") == name)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``shuffle_rank``-able order for scale: a hash of key and seed."""
    return rows.withColumn("shuffle_key", F.xxhash64(F.col(key), F.lit(seed)))


def sample_first(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows in shuffled order (a sampling operator)."""
    return shuffled(rows, key, seed).orderBy("shuffle_key", key).limit(n).drop("shuffle_key")


def oracle_quota(envs: Column, teacher: Column, share: float) -> Column:
    """Gold samples beside ``teacher`` samples so that they are ``share`` of all: at least 1, at most the environments."""
    wanted = F.ceil(teacher * share / (1 - share)).cast("long")
    return F.when(teacher > 0, F.least(envs, F.greatest(F.lit(1), wanted))).otherwise(F.least(envs, F.lit(1)))
