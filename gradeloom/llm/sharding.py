"""A uniform shuffle of a table into shards of exact sizes.

1. Rows are written once with a number of their own; ``BLOCK_ROWS`` following numbers of a partition are a block. Nothing later depends on the
   order in which rows arrive.
2. Shards are cut into cells of at most ``CELL_ROWS`` places. How many rows each block sends to each cell is a draw from the
   multivariate hypergeometric law with both margins fixed. ``Matrix`` draws it on a binary tree
   over the blocks: a node divides what its cells take among its two halves. A task follows the path to its own block alone, so the
   matrix is never held as a whole; the driver knows the blocks' row counts only.
3. A block's rows are permuted locally (a permutation of its cells' labels) and exchanged.
4. Inside a cell, rows are ordered by a hash of their number: the second permutation. A row's slot is its cell's first place and its rank.

So every arrangement is equally likely up to the generators, sizes are exact, and hot keys, sources or copies don't matter, as no value of a row does. Another seed gives another
arrangement; the same written rows, seed and settings give the same one, also when tasks run again.

Shard sizes differ by one row at most (the law ``rows``). Groups of equal texts are not kept together: they may hold a third of all rows.

Defined cases: null ids, null texts and repeated rows are rows like others. An empty table gives no files with rows; fewer rows than shards leave shards
empty. Columns keep their names, but ``shard`` and ``slot`` of the input are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise, own, scratch_path, small_batches, width

BLOCK_ROWS = 1 << 20
CELL_ROWS = 50_000
#: Row numbers are partition << 33 | place.
PLACE_BITS = 33
#: From this population on, draws are by inversion around the mode; below, by numpy's generator, which takes no more.
LARGE = 10**9
REACH = 14


def even(total: int, parts: int) -> np.ndarray:
    """Sizes of parts that differ by one at most, the larger first."""
    return total // parts + (np.arange(parts) < total % parts)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` drawn without replacement, for any population."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, sample)) if sample and good else 0
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    sd = (sample * (good / total) * (bad / total) * ((total - sample) / max(1, total - 1))) ** 0.5
    # weights relative to the mode's, by the ratio of neighbours; beyond REACH deviations they vanish in a double
    x = np.arange(max(low, mode - int(REACH * sd) - REACH), min(high, mode + int(REACH * sd) + REACH) + 1, dtype=np.float64)
    up = np.log((good - x[:-1]) * (sample - x[:-1])) - np.log((x[:-1] + 1) * (bad - sample + x[:-1] + 1))
    log = np.concatenate([[0.0], np.cumsum(up)])
    weight = np.cumsum(np.exp(log - log.max()))
    return int(x[np.searchsorted(weight, rng.random() * weight[-1], side="right")])


def divided(rng: np.random.Generator, sizes: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows each class of ``sizes`` rows gives: a multivariate hypergeometric draw, class by class."""
    total = int(sizes.sum())
    if total < LARGE:
        return rng.multivariate_hypergeometric(sizes, sample, method="marginals")
    out, rest, left = np.zeros(len(sizes), dtype=np.int64), total, sample
    for k, size in enumerate(sizes.tolist()):
        rest -= size
        out[k] = hypergeometric(rng, size, rest, left)
        left -= int(out[k])
    return out


class Matrix:
    """Rows that each block sends to each cell. Only the rows of the matrix that are asked for are drawn, each by the path to its block."""

    def __init__(self, blocks: np.ndarray, cells: np.ndarray, seed: int):
        self.before = np.concatenate([[0], np.cumsum(blocks)])
        self.cells, self.seed = np.asarray(cells, dtype=np.int64), seed

    def row(self, block: int) -> np.ndarray:
        first, last, now = 0, len(self.before) - 1, self.cells
        while last - first > 1:
            mid = (first + last) // 2
            rng = np.random.default_rng([self.seed, first, last])
            left = divided(rng, now, int(self.before[mid] - self.before[first]))
            first, last, now = (first, mid, left) if block < mid else (mid, last, now - left)
        return now

    def labels(self, block: int) -> np.ndarray:
        """The cell of each row of a block: its row of the matrix, permuted."""
        rng = np.random.default_rng([self.seed, block, 1 << 40])
        return rng.permutation(np.repeat(np.arange(len(self.cells), dtype=np.int32), self.row(block)))


def cell_function(matrix: Matrix, index: dict[int, int]):
    """A pandas function from block and place in the block to the cell; a block's labels are drawn when its rows come."""
    held: dict = {}

    @F.pandas_udf("int")
    def cell_of(blocks: pd.Series, places: pd.Series) -> pd.Series:
        values, at = blocks.to_numpy(), places.to_numpy()
        out = np.empty(len(values), dtype=np.int32)
        for b in np.unique(values).tolist():
            if held.get("block") != b:
                held.update(block=b, labels=matrix.labels(index[b]))
            mine = values == b
            out[mine] = held["labels"][at[mine]]
        return pd.Series(out)

    return cell_of


class Layout:
    """Shards cut into as many cells each: shard k has the cells from k * pieces on."""

    def __init__(self, rows: int, shards: int, least_cells: int):
        self.rows, self.shards = rows, shards
        self.pieces = max(1, -(-least_cells // shards), -(-rows // (shards * CELL_ROWS)))
        self.sizes = np.concatenate([even(int(s), self.pieces) for s in even(rows, shards)])

    def shard(self, cell: Column) -> Column:
        return F.floor(cell / self.pieces).cast("int")

    def start(self, cell: Column) -> Column:
        """First place of a cell in its shard."""
        size = F.lit(self.rows // self.shards) + (self.shard(cell) < self.rows % self.shards).cast("long")
        piece = cell % self.pieces
        return piece * F.floor(size / self.pieces) + F.least(piece, size % self.pieces)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0) -> DataFrame:
    """Write the rows of ``docs``, uniformly shuffled, to folders ``shard=k`` at ``path``, with the gapless number ``slot`` in their shard; what is
    returned reads them back."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*map(own, columns)).alias("row"))
    frozen = materialise(rows, "numbered", compression="zstd")
    place = F.col("number").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    block = F.shiftright("number", PLACE_BITS) * ((1 << PLACE_BITS) // BLOCK_ROWS) + F.floor(place / BLOCK_ROWS)
    counts = frozen.groupBy(block.alias("block")).agg(F.count("*").alias("n")).orderBy("block").collect()  # one for each partition and million rows
    layout = Layout(sum(r["n"] for r in counts), shards, width(spark))
    matrix = Matrix(np.array([r["n"] for r in counts], dtype=np.int64), layout.sizes, seed)
    cell_of = cell_function(matrix, {r["block"]: k for k, r in enumerate(counts)})
    dealt = frozen.select("number", "row", cell_of(block, (place % BLOCK_ROWS).cast("int")).alias("cell"))
    dealt = dealt.repartitionById(len(layout.sizes), F.col("cell")).sortWithinPartitions("cell", F.xxhash64(F.lit(seed), "number"), "number")
    rank = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))  # a task has one cell
    out = dealt.select("row.*", (layout.start(F.col("cell")) + rank).alias("slot"), layout.shard(F.col("cell")).alias("shard"))
    with small_batches(spark):
        out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    discard(frozen)
    return spark.read.schema(out.schema).parquet(path)


def shard_digests(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Write ids and whole texts of ``docs`` to shards, read them back, and describe each row."""
    path = scratch_path(docs.sparkSession, "shards")
    found = write_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, shards, seed)
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    return found.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
