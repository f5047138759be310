"""Packing documents into sequences of fixed length by shortest-pack-first over the length histogram.

1. Each document's ids are cut into pieces of the full length and one remainder.
2. The histogram of piece lengths, at most ``length`` rows, goes to the driver. ``pack_histogram`` places lengths longest
   first into the pack with the most room, for whole counts at a time: it keeps packing patterns and their counts,
   never single pieces. Its work depends on the number of lengths, not of documents.
3. Pieces are ranked inside their length, in up to BUCKETS hash buckets of RANKED pieces or more, so that no length lands in one task. The buckets' counts, ``length`` + BUCKETS numbers, give each bucket's first rank, and a rank names the pattern, the pack and the
   slot of its piece by binary search in the table of patterns.

Full pieces need no room from others, so only remainders are really packed. Padding is what the last packs leave free.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed each for itself. An empty table gives
an empty result. Sequence numbers are dense from 0; offsets in a sequence have no gaps.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import fields, materialise
from .scratch import own as own_column
from .wordbpe import encoder, forget, text_slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Pieces of one length that are ranked together, about, at least; buckets in all, about, at most.
RANKED = 500
BUCKETS = 100_000


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """A row per piece of at most ``length`` ids, from every whole text."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                doc, start, size, crc, total = [], [], [], [], []
                for doc_id, ids in zip(batch.column(0).slice(first, len(texts)).to_pylist(), encoder(tokenizer).encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, length):
                        piece = ids[4 * at : 4 * (at + length)]
                        doc.append(doc_id)
                        start.append(at)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (doc, start, size, crc, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[dict[int, int], int]]:
    """Packing patterns ({piece length: pieces}) and how many packs have each.

    Lengths go longest first, each into the packs with the most room (the shortest packs); equal packs are treated as one
    pattern with a count, and a pattern is split where only some of its packs get a piece.
    """
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # free ids -> patterns with counts
    heap: list[int] = []

    def put(free: int, pattern, count: int) -> None:
        if free not in room:
            room[free] = []
            heapq.heappush(heap, -free)
        room[free].append((pattern, count))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        if left and (not heap or -heap[0] < size):
            per = length // size  # nothing fits: new packs, each filled with this length
            if left >= per:
                put(length - per * size, ((size, per),), left // per)
            if left % per:
                put(length - (left % per) * size, ((size, left % per),), 1)
            continue
        while left:
            if not heap or -heap[0] < size:
                per = length // size
                if left >= per:
                    put(length - per * size, ((size, per),), left // per)
                if left % per:
                    put(length - (left % per) * size, ((size, left % per),), 1)
                break
            free = -heap[0]
            pattern, count = room[free].pop()
            if not room[free]:
                del room[free]
                heapq.heappop(heap)
            # the next shortest packs have room for at least as many; go down to their level at once
            below = -heap[0] if heap else 0
            each = max(1, min(free // size, -(-(free - below) // size))) if left >= count else 1
            each = max(1, min(each, left // count)) if left >= count else 1
            take = min(count, left // each)
            if take < count:
                put(free, pattern, count - take)
            last = pattern[-1]
            grown = pattern[:-1] + ((size, last[1] + each),) if last[0] == size else pattern + ((size, each),)
            put(free - each * size, grown, take)
            left -= take * each
    return [(dict(p), c) for groups in room.values() for p, c in groups]


def placement(patterns: list[tuple[dict[int, int], int]], length: int) -> dict[str, np.ndarray]:
    """The table that turns (length, rank) into a place: a row per pattern and length, ascending by key."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for pattern, count in sorted(patterns, key=lambda x: sorted(x[0].items(), reverse=True), reverse=True):
        offset = 0
        for size, each in sorted(pattern.items(), reverse=True):
            rows.append((size, used.get(size, 0), each, sequence, offset))
            used[size] = used.get(size, 0) + each * count
            offset += size * each
        sequence += count
    rows.sort()
    names = ("size", "rank", "each", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(names)}


def bucket(each: Column) -> Column:
    """One of ``each`` buckets for a piece."""
    return F.pmod(F.xxhash64("doc_id", "start", "__tie"), each).cast("int")


def pack(pieces: DataFrame, length: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (``doc_id``, ``start``, ``length`` and further columns).

    ``__tie``, a number of each row, spreads rows that are otherwise equal or have no doc_id over buckets as others; it goes."""
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    ranked_together = max(RANKED, -(-sum(sizes.values()) // BUCKETS))
    each = np.zeros(length + 1, dtype=np.int64)  # buckets of each length
    for size, n in sizes.items():
        each[size] = -(-n // ranked_together)
    first = np.concatenate([[0], np.cumsum(each)])
    table = pieces.sparkSession.createDataFrame([(s, int(each[s]), int(first[s])) for s in sizes], "length long, __each int, __first int")
    spread = pieces.join(F.broadcast(table), "length").withColumn("__bucket", F.col("__first") + bucket(F.col("__each")))
    cells = spread.groupBy("__bucket").agg(F.count("*").alias("n")).toArrow()
    count = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    count[cells["__bucket"].to_numpy()] = cells["n"].to_numpy()
    before = np.cumsum(count) - count
    for size in sizes:
        before[first[size] : first[size + 1]] -= before[first[size]]
    places = placement(pack_histogram(sizes, length), length)
    shared = pieces.sparkSession.sparkContext.broadcast((places, before))
    ranked = spread.withColumn("__own", F.row_number().over(Window.partitionBy("__bucket").orderBy("doc_id", "start", "__tie")))
    wide = np.int64(1) << 44

    def place(batches):
        forget()
        places, before = shared.value
        keys = places["size"] * wide + places["rank"]
        for batch in batches:
            size, bucket, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__bucket", "__own"))
            rank = before[bucket] + own - 1
            at = np.searchsorted(keys, size * wide + rank, side="right") - 1
            inside = rank - places["rank"][at]
            each = places["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(places["sequence"][at] + inside // each), pa.array(places["offset"][at] + inside % each * size)],
                names=[*names, "sequence_id", "offset"],
            )

    names = [c for c in pieces.columns if c != "__tie"]
    return ranked.select(*map(own_column, names), "__bucket", "__own").mapInArrow(place, fields(pieces, names, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096) -> DataFrame:
    """Pieces of all documents with their sequences. Encoding is done once: the pieces are written, then ranked."""
    pieces = cut_pieces(docs, tokenizer, end_id, length).withColumn("__tie", F.monotonically_increasing_id())
    return pack(materialise(pieces, "pieces"), length)
