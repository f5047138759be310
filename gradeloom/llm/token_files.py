"""Token ids in Parquet list columns that can be read selectively.

``write_tokens`` encodes every text, and writes one row per document in ascending doc_id order: files are ranges of
doc_id, rows inside a file are sorted. Ids are dictionary coded (a vocabulary's dictionary page is small beside the
pages), the ascending number columns delta coded. Row groups and pages have set sizes and Parquet's column and offset
indexes, so a filter on doc_id reads the pages it needs and a query for lengths never touches the ids.

``read_tokens`` reads the files back and adds each document's place in the whole stream.

Defined cases: a null text is an empty one and holds the end id alone. Rows with a null doc_id come first. Repeated
doc_ids are kept, in a fixed order; an id or null of many rows is spread over several files. An empty table gives empty files. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch_path, small_batches, width
from .wordbpe import encoder, text_slices

TOKEN_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"

#: Sizes of the files' parts in bytes and rows.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


def file_options(row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Writer options: format version 2 (delta coding), dictionary for ids alone, row group and page sizes."""
    return {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
    }


def order_key(doc_id: Column) -> Column:
    """Null before all others."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """``parts - 1`` ascending values that cut a number column into ranges of about as many rows; a value of many rows may be there several times."""
    if parts < 2:
        return []
    return sorted(df.approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (4 * parts)))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    shards: int | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    **sizes: int,
) -> None:
    """Encode every whole text of ``docs`` into token files at ``path``."""
    shards = shards or width(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = range_bounds(base.select(order_key(F.col("doc_id")).alias("key")), "key", shards)
    shard = F.lit(0)
    if bounds:
        cuts, key = F.lit([int(b) for b in bounds]), order_key(F.col("doc_id"))
        same = F.array_size(F.filter(cuts, lambda b: b == key))
        shard = F.array_size(F.filter(cuts, lambda b: b < key)) + F.when(same > 1, F.pmod(F.xxhash64("text"), same)).otherwise(0)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def encode(batches):
        run: dict[int, int] = {}
        for batch in batches:
            ids, parts = batch.column(0), batch.column(2)
            for first, texts in text_slices(batch.column(1)):
                found = [x + end for x in encoder(tokenizer).encode(texts)]
                n = np.fromiter((len(x) // 4 for x in found), dtype=np.int64, count=len(found))
                own = parts.slice(first, len(texts)).to_numpy(zero_copy_only=False)
                start = np.empty(len(texts), dtype=np.int64)
                for s in np.unique(own):
                    at = own == s
                    sums = np.cumsum(n[at])
                    start[at] = run.get(int(s), 0) + sums - n[at]
                    run[int(s)] = run.get(int(s), 0) + int(sums[-1])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), pa.array(own, pa.int32()), pa.array(start), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), values)],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )

    rows = (
        base.select("doc_id", "text", shard.cast("int").alias("shard"))
        .repartitionById(max(1, len(bounds) + 1), F.col("shard"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, TOKEN_SCHEMA)
    )
    with small_batches(docs.sparkSession):
        rows.write.options(**file_options(**sizes)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token files with ``start``: ids of all documents before this one. The number of shards bounds what is collected."""
    files = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    bases, run = [], 0
    for row in totals:
        bases.append((row["shard"], run))
        run += row["n"]
    table = spark.createDataFrame(bases, "shard int, base long")
    return files.join(F.broadcast(table), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def crc_of_ids(batches):
    """doc_id, start and ids to doc_id, start, length and unsigned crc32 of the ids as little-endian 32-bit numbers."""
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, read them back, and digest each document's ids."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **options)
    return read_tokens(spark, path).select("doc_id", "start", "ids").mapInArrow(crc_of_ids, "doc_id long, start long, n_tokens long, ids_crc32 long")
