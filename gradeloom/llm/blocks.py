"""Comparing the members of many blocks, however large a block is: first with its hub, then what the hub leaves open.

A block is a hub and the nodes that met in it; a node may be in several.

* ``star_rows`` deals a block's members out in salted groups of about STAR, each with a copy of the hub. So a group of m near copies costs m
  comparisons, in m / STAR tasks.
* ``open_pairs``: nodes that the hub doesn't link go on. A node that it does link is known to be in the hub's component; it goes on only if some node that
  isn't could link with it, by bounds that both have from the comparison with the hub. What goes on is cut into pieces by these bounds, and each pair of
  pieces is a block, but for pairs that the bounds exclude and pairs of two pieces that the hub links; so every pair that may matter is compared.
* ``piece_pairs`` deals all pairs of a block's members out, in pieces, where each must be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, width

#: Members that are compared with one copy of the hub; sizes of tables that may be broadcast.
STAR = 64
#: Pieces of a block that goes on, about, until they reach the caller's limit; bands of each bound in a large block.
PIECES = 32
BANDS = 4
WIDE = 1 << 32
BROADCAST_ROWS = 500_000


def _sized(members: DataFrame, key: str) -> DataFrame:
    """``key`` and number of members ``m`` of blocks with two at least."""
    sizes = members.groupBy(key).agg(F.count("*").alias("m")).where("m > 1")
    return F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes


def star_rows(members: DataFrame, node: str) -> DataFrame:
    """``hub``, ``salt``, ``node`` and ``member`` (0 for the copy of the hub, else 1) from ``hub`` and ``node``."""
    size = members.where(F.col("hub") != F.col(node)).groupBy("hub").agg(F.count("*").alias("m")).withColumn("salts", F.ceil(F.col("m") / STAR).cast("int"))
    large = size.where("salts > 1").select("hub", "salts")
    others = members.where(F.col("hub") != F.col(node)).join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "hub", "left")
    salt = F.pmod(F.xxhash64(node), F.coalesce("salts", F.lit(1))).cast("int")
    own = others.select("hub", salt.alias("salt"), node, F.lit(1).alias("member"))
    hubs = size.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias(node), F.lit(0).alias("member"))
    return own.unionByName(hubs)


def gather(rows: DataFrame, *keys: str, within: list[str]) -> DataFrame:
    """Rows with equal keys one after the other in one task, in the order of ``within``."""
    return rows.repartition(width(rows.sparkSession), *keys).sortWithinPartitions(*keys, *within)


def with_data(rows: DataFrame, data: DataFrame, node: str) -> DataFrame:
    """``rows`` with the columns of ``data``, a table of nodes; few rows are broadcast, so that only what is gathered is shuffled."""
    return data.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, node)


def _joined(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, list(keys))


def open_pairs(star: DataFrame, node: str, most: int) -> DataFrame:
    """``hub``, ``i``, ``j`` and ``node``: what goes on, dealt to pairs of pieces of at most about ``most``, fewer in smaller blocks.

    ``star`` has ``hub``, ``node``, ``linked`` (with the hub), ``low`` and ``high``; x and y can link only if ``low`` of each is at most ``high`` of the other.
    Pieces of a large block hold nodes with about the same bounds, so that whole pairs of pieces fall away; so do pairs of two pieces that the hub links."""
    loose = ~F.col("linked")
    bounds = star.groupBy("hub").agg(F.max("high").alias("top"), F.min("low").alias("bottom"), F.count_if(loose).alias("u")).where("u > 0").drop("u")
    left = _joined(star, bounds, "hub").where("linked or (low <= top and high >= bottom)").drop("top", "bottom")
    bounds = left.where(loose).groupBy("hub").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    going = _joined(left, bounds, "hub").where("not linked or (low <= top and high >= bottom)").drop("top", "bottom")
    going = materialise(going, "blocks-open", small=True)

    span = going.groupBy("hub").agg(F.count("*").alias("m"), *(f(c).alias(f"{c}_{n}") for c in ("low", "high") for f, n in ((F.min, "from"), (F.max, "to"))))
    band = lambda c: F.floor(BANDS * (F.col(c) - F.col(f"{c}_from")) / (F.col(f"{c}_to") - F.col(f"{c}_from") + 1e-9)).cast("int")
    cell = F.when(F.col("m") <= 2 * STAR, 0).otherwise(1 + (F.col("linked").cast("int") * BANDS + band("low")) * BANDS + band("high"))
    placed = _joined(going, span, "hub").select("hub", node, "linked", "low", "high", "m", cell.cast("long").alias("cell"))
    piece = F.least(F.lit(most), F.greatest(F.lit(STAR), F.ceil(F.col("m") / PIECES)))
    cells = placed.groupBy("hub", "m", "cell").agg(F.count("*").alias("n"), F.max(loose).alias("loose"), F.min("low").alias("low"), F.max("high").alias("high"))
    cells = cells.select("hub", "cell", "loose", "low", "high", F.ceil(F.col("n") / F.when(F.col("cell") == 0, 2 * STAR).otherwise(piece)).cast("int").alias("k"))
    cells = materialise(cells, "blocks-cells", small=True)
    other = cells.select("hub", *(F.col(c).alias(f"other_{c}") for c in ("cell", "loose", "low", "high", "k")))
    pairs = cells.join(other, "hub").where("(loose or other_loose) and low <= other_high and other_low <= high").select("hub", "cell", "k", "other_cell", "other_k")

    own = F.pmod(F.xxhash64(node), F.col("k"))
    mine, theirs = F.col("cell") * WIDE + F.col("own"), lambda j: F.col("other_cell") * WIDE + j
    place = F.transform(F.sequence(F.lit(0), F.col("other_k") - 1), lambda j: F.struct(F.least(mine, theirs(j)).alias("i"), F.greatest(mine, theirs(j)).alias("j")))
    place = F.when((F.col("cell") == F.col("other_cell")) & (F.col("k") > 1), F.filter(place, lambda p: p["i"] != p["j"])).otherwise(place)
    dealt = _joined(placed.select("hub", node, "cell"), pairs, "hub", "cell").withColumn("own", own).withColumn("place", F.explode(place))
    return dealt.select("hub", F.col("place.i").alias("i"), F.col("place.j").alias("j"), node)


def piece_pairs(members: DataFrame, key: str, node: str, most: Column) -> DataFrame:
    """``key``, ``i``, ``j``, ``own`` and ``node``: members dealt to pairs of pieces ``i`` <= ``j`` with their piece ``own``; ``most``: members of a piece, given ``m``."""
    place = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    return (
        members.join(_sized(members, key), key)
        .withColumn("k", F.ceil(F.col("m") / most).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(node), F.col("k")).cast("int"))
        .withColumn("place", F.explode(place))
        .select(key, F.col("place.i").alias("i"), F.col("place.j").alias("j"), "own", node)
    )
