"""Exact Jaccard join of documents on word n-grams, by blocked sparse products.

Two documents link when 100 * |A and B| >= PERCENT * |A or B| for their sets of n-grams. The incidence matrix of documents by
n-grams is never multiplied as a whole:

1. ``shared_counts``: each task combines its own documents' n-grams and deals the rest out by hash range as packed arrays.
   A document whose n-grams occurring elsewhere are fewer than PERCENT of its set can't link (the union is no smaller
   than its set), so only the others go on. An n-gram met twice inside a task is known to be shared there and is dealt
   out once, so a passage of a third of all documents is no burden to a single range.
2. Equal sets are one class, represented by its smallest doc_id.
3. ``block_members``: linked sets share one of the first |A| - ceil(PERCENT/100 |A|) + 1 n-grams of each in any one order of all n-grams;
   the order here is by frequency for the most frequent ones (``heavy_grams``, bounded in number), which come last, then by
   hash, so that sets meet in rare n-grams rather than in a passage that thousands share. All representatives that meet in such an n-gram join the block of one of them, its hub: the one with the fewest n-grams of its own, then by
   hash. So every possible link lies in some block, copies of one text meet in few blocks, and their hub is about the text that they are copies of. The hubs of frequent n-grams are minima that each task combines, so no task
   gathers the sets of a frequent n-gram; the sets of another one are at most a task's share.
4. Each member of a block is compared with its hub, in salted groups (``blocks.star_rows``); what they differ in bounds how near others can be (``hub_bounds``), so most members of a group of near copies are
   done with that. ``link_block`` takes what is left in pairs of pieces: it multiplies a row of the block's incidence matrix with the rows not yet reached, accumulating overlap
   counts, and discards those below the bound that the sizes give: overlap >= PERCENT/(100+PERCENT) * (|A| + |B|). Rows that
   link join the row's tree and aren't looked at again; only tree edges leave the task, never all pairs of a group.
5. Components of these edges, and the classes, give every document its component.

Hashes have 64 bits in step 4 and about 38 in steps 1 and 3, where a collision can only let a set go on in vain.

Defined cases: null, empty and blank texts have no n-grams and no links. Texts of 1 to n - 1 words have one n-gram, the whole
sequence. Rows with a null doc_id have their count and a null component. Rows of one doc_id are one document: one row with
the largest count, linked through the set of each of its rows. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import gather, open_pairs, star_rows, with_data
from .components import components
from .scratch import fields, materialise, width
from .scratch import own as column
from .textkernel import gram_hashes, join_texts, mix, word_hashes, words
from .wordbpe import text_slices

N = 5
PERCENT = 80
#: N-grams that a task combines before it deals them out, sets in a piece of a block, ids that may be broadcast.
CHUNK = 1_000_000
BLOCK = 1_024
#: Bytes of text (as the table stores them) whose n-grams a task holds at a time; more ranges of hashes than this a task aren't made.
RANGE_BYTES = 8 << 20
RANGES = 64
BROADCAST_IDS = 500_000
#: Sets that hold an n-gram before it counts as frequent, and how many frequent ones are told apart at most.
OFTEN = 32
HEAVY = 1 << 19

PACKED = "part int, rows binary"
DEALT = "part int, docs binary, counts binary, residues binary, multi binary, sizes binary"


def need(n):
    """Least number of n-grams of a set of n that a linked set holds."""
    return -(-PERCENT * n // 100)


def gram_sets(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, one text after the other; and how many each has."""
    data, first = join_texts(texts)
    starts, ends = words(data)
    grams, counts = gram_hashes(word_hashes(data, starts, ends), np.diff(np.searchsorted(starts, first)), n)
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    sizes = np.zeros(len(texts), dtype=np.int64)
    kept = []
    for i in range(len(texts)):
        own = np.sort(grams[at[i] : at[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sizes[i] = len(own)
        kept.append(own)
    return (np.concatenate(kept) if kept else np.empty(0, dtype=np.uint64)), sizes


def _parts_of(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each hash, and the 32 bits that tell hashes of a range apart."""
    part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return part.astype(np.uint16 if parts <= 65536 else np.uint32), (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(values):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return start, np.diff(np.concatenate([start, [len(values)]]))


def _deal(doc_ids: np.ndarray, owner: np.ndarray, grams: np.ndarray, parts: int, combine: bool, turn: int, lone: np.ndarray | None = None):
    """Rows of DEALT for a chunk: per range, its documents with how many residues each has. ``owner`` ascends. ``lone``: a number of each document for ``multi``.

    With ``combine``, n-grams met more than once in the chunk are dealt out once, without document (``multi``), and each
    document's number of them goes with its size to the ranges in turn (``sizes``: doc, size, shared triples)."""
    keep = np.ones(len(grams), dtype=bool)
    multi = np.empty(0, dtype=np.uint64)
    if combine:
        order = np.argsort(grams)
        start, length = _runs(grams[order])
        multi = grams[order[start[length > 1]]]
        again = np.repeat(length > 1, length)
        keep[order[again]] = False
        sizes = np.stack([doc_ids, np.bincount(owner, minlength=len(doc_ids)), np.bincount(owner[~keep], minlength=len(doc_ids))], axis=1).astype(np.int64)
    part, residue = _parts_of(grams[keep], parts)
    order = np.argsort(part, kind="stable")
    part, residue, doc = part[order], residue[order], owner[keep][order]
    cut = np.searchsorted(part, np.arange(parts + 1))
    multi_part, multi_residue = _parts_of(multi, parts)
    order = np.argsort(multi_part, kind="stable")
    multi_cut = np.searchsorted(multi_part[order], np.arange(parts + 1))
    multi_residue = multi_residue[order]
    rows = []
    for p in range(parts):
        a, b, c, d = cut[p], cut[p + 1], multi_cut[p], multi_cut[p + 1]
        mine = combine and p == turn % parts
        if a == b and c == d and not mine:
            continue
        start, length = _runs(doc[a:b])
        ids = doc_ids[doc[a:b][start]]
        further = multi_residue[c:d] if lone is None else lone[doc[a:b][start]].astype(np.uint32)
        rows.append((p, ids.tobytes(), length.astype(np.uint32).tobytes(), residue[a:b].tobytes(), further.tobytes(), sizes.tobytes() if mine else b""))
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "docs", "counts", "residues", "multi", "sizes"])


def ranges(docs: DataFrame) -> int:
    """Number of hash ranges: a multiple of the shuffle partitions, so that a task goes through its n-grams range by range."""
    parts = width(docs.sparkSession)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return parts * max(1, min(RANGES, size // (parts * RANGE_BYTES)) if size < 1 << 60 else 1)  # Spark's mark of an unknown size is larger


def by_range(dealt: DataFrame, count: int) -> DataFrame:
    """Rows of a range (``part``) in one task, one range after the other."""
    parts = width(dealt.sparkSession)
    out = dealt.repartitionById(parts, F.col("part") % parts)
    return out.sortWithinPartitions("part") if count > parts else out


def _by_part(batches):
    """Rows with equal ``part``: yields (part, tuples of the other columns)."""
    held, rows = None, []
    for batch in batches:
        for part, *row in zip(*(col.to_pylist() for col in batch.columns)):
            if part != held and rows:
                yield held, rows
                rows = []
            held = part
            rows.append(row)
    if rows:
        yield held, rows


def _dealt(part: int, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a range: range and residue as one number, document, the same of multi, and the further numbers."""

    def whole(x, kind):
        return np.concatenate(x) if x else np.empty(0, dtype=kind)

    base = np.uint64(part) << np.uint64(32)
    keys = [np.frombuffer(r, dtype=np.uint32).astype(np.uint64) | base for _, _, r, _, _ in rows]
    docs = [np.repeat(np.frombuffer(d, dtype=np.int64), np.frombuffer(c, dtype=np.uint32)) for d, c, _, _, _ in rows]
    multi = [np.frombuffer(m, dtype=np.uint32).astype(np.uint64) | base for _, _, _, m, _ in rows]
    further = whole([np.frombuffer(s, dtype=np.int64) for *_, s in rows], np.int64)
    rows.clear()  # what was packed isn't needed beside what it holds
    return whole(keys, np.uint64), whole(docs, np.int64), whole(multi, np.uint64), further


def _pack(rows: np.ndarray, parts: int, by: int = 1) -> pa.RecordBatch:
    """Rows of numbers dealt by a hash of the first ``by``: a record per range with its columns as byte arrays."""
    mark = rank_of(rows[:, 0])
    for k in range(1, by):
        mark = rank_of(rows[:, k] ^ mark.view(np.int64))
    part = (mark % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    own = [p for p in range(parts) if cut[p] < cut[p + 1]]
    blobs = [np.ascontiguousarray(rows[order[cut[p] : cut[p + 1]]].T).tobytes() for p in own]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])


def _unpack(batches, columns: int) -> np.ndarray:
    return _unpack_rows([x for batch in batches for x in batch.column(1).to_pylist()], columns)


def _unpack_rows(blobs: list[bytes], columns: int) -> np.ndarray:
    found = [np.frombuffer(x, dtype=np.int64).reshape(columns, -1).T for x in blobs]
    return np.concatenate(found) if found else np.empty((0, columns), dtype=np.int64)


def shared_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` (size of its largest row's set), ``least`` (of its smallest that isn't empty) and ``shared`` (how many of all occur in other rows)."""
    parts, cut = width(docs.sparkSession), ranges(docs)

    def deal(batches):
        ids, owners, grams, held, turn = [], [], [], 0, 0

        def flush():
            return _deal(np.concatenate(ids), np.concatenate(owners), np.concatenate(grams), cut, True, turn)

        docs_so_far = 0
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in text_slices(batch.column(1)):
                own, sizes = gram_sets(texts)
                ids.append(all_ids[first : first + len(texts)])
                owners.append(np.repeat(np.arange(docs_so_far, docs_so_far + len(texts)), sizes))
                grams.append(own)
                docs_so_far += len(texts)
                held += len(own)
                if held >= CHUNK:
                    yield flush()
                    ids, owners, grams, held, docs_so_far, turn = [], [], [], 0, 0, turn + 1
        if ids:
            yield flush()

    def count(batches):
        for part, rows in _by_part(batches):
            keys, doc, multi, sizes = _dealt(part, rows)
            both = np.concatenate([keys, multi])
            order = np.argsort(both)
            start, length = _runs(both[order])
            hit = order[np.repeat(length > 1, length)]
            hit = hit[hit < len(keys)]
            ids, n = np.unique(doc[hit], return_counts=True)
            found = np.stack([ids, np.zeros(len(ids), dtype=np.int64), n], axis=1)
            yield _pack(np.concatenate([sizes.reshape(-1, 3), found]), parts)

    def total(batches):
        rows = _unpack(batches, 3)
        ids, at = np.unique(rows[:, 0], return_inverse=True)
        n, shared = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        np.maximum.at(n, at, rows[:, 1])
        np.add.at(shared, at, rows[:, 2])
        least, some = n.copy(), rows[:, 1] > 0
        np.minimum.at(least, at[some], rows[some, 1])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(least), pa.array(shared)], names=["doc_id", "n", "least", "shared"])

    dealt = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(deal, DEALT)
    by_doc = by_range(dealt, cut).mapInArrow(count, PACKED).repartitionById(parts, F.col("part"))
    return by_doc.mapInArrow(total, "doc_id long, n long, least long, shared long")


def _sets_of(docs: DataFrame, columns: str, cells, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and further columns made of each text's set; ``cells``: sets and sizes to Arrow arrays."""

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                own, sizes = gram_sets(texts)
                at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                blobs = [own[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                kept = [batch.column(k).slice(first, len(texts)) for k in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*kept, *cells(blobs, sizes)], names=[*names, *(c.split()[0] for c in columns.split(", "))])

    names = ["doc_id", *keep]
    return docs.select("doc_id", "text", *keep).mapInArrow(run, fields(docs, names, columns))


def digests_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, size ``n`` and ``digest`` of each set."""
    return _sets_of(docs, "n long, digest binary", lambda blobs, sizes: [pa.array(sizes), pa.array([hashlib.blake2b(b, digest_size=16).digest() for b in blobs], pa.binary())])


def grams_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lone`` and its set as ascending 64-bit numbers (``grams``)."""
    return _sets_of(docs, "grams binary", lambda blobs, sizes: [pa.array(blobs, pa.binary())], ("lone",))


def rank_of(ids: np.ndarray) -> np.ndarray:
    """A fixed random order of documents."""
    return mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def heavy_grams(sets: DataFrame, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (range and residue) of the most frequent n-grams, ascending, and how many sets hold each. At most HEAVY."""
    most_each = max(1, HEAVY // cut)

    def deal(batches):
        grams, held = [], 0

        def flush():
            own, n = np.unique(np.concatenate(grams), return_counts=True)
            part, residue = _parts_of(own, cut)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(cut + 1))
            residue, n = residue[order], np.minimum(n[order], 65535).astype(np.uint16)
            used = [p for p in range(cut) if at[p] < at[p + 1]]
            blobs = [[x[at[p] : at[p + 1]].tobytes() for p in used] for x in (residue, n)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "residues", "counts"])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                grams.append(np.frombuffer(blob, dtype=np.uint64))
                held += len(grams[-1])
                if held >= CHUNK:
                    yield flush()
                    grams, held = [], 0
        if held:
            yield flush()

    def most(batches):
        for part, rows in _by_part(batches):
            residue = np.concatenate([np.frombuffer(r, dtype=np.uint32) for r, _ in rows])
            n = np.concatenate([np.frombuffer(c, dtype=np.uint16) for _, c in rows]).astype(np.int64)
            own, at = np.unique(residue, return_inverse=True)
            total = np.bincount(at, n).astype(np.int64)
            top = np.argsort(-total, kind="stable")[:most_each]
            top = np.sort(top[total[top] >= OFTEN])
            if len(top):
                keys = (np.uint64(part) << np.uint64(32)) | own[top].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([total[top].tobytes()], pa.binary())], names=["keys", "counts"])

    dealt = by_range(sets.select("grams").mapInArrow(deal, "part int, residues binary, counts binary"), cut)
    rows = dealt.mapInArrow(most, "keys binary, counts binary").collect()
    keys = np.concatenate([np.empty(0, dtype=np.uint64), *(np.frombuffer(r["keys"], dtype=np.uint64) for r in rows)])
    counts = np.concatenate([np.empty(0, dtype=np.int64), *(np.frombuffer(r["counts"], dtype=np.int64) for r in rows)])
    order = np.argsort(keys)
    return keys[order], counts[order]


def block_members(sets: DataFrame) -> DataFrame:
    """``hub`` and ``doc_id``: the blocks that each set is in."""
    spark = sets.sparkSession
    parts, cut = width(spark), ranges(sets)
    keys, counts = heavy_grams(sets, cut)
    heavy = spark.sparkContext.broadcast((keys, counts))

    def places(grams: np.ndarray) -> np.ndarray:
        """Number of each gram among the frequent ones, -1 for others."""
        keys = heavy.value[0]
        if not len(keys):
            return np.full(len(grams), -1, dtype=np.int64)
        part, residue = _parts_of(grams, cut)
        own = (part.astype(np.uint64) << np.uint64(32)) | residue
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return np.where(keys[at] == own, at, -1)

    def prefixes(batches):
        """Documents with their ``lone``, whose each gram is, the grams that come first in the order, and their numbers among the frequent ones; in chunks."""
        counts = np.append(heavy.value[1], 0)
        ids, owners, grams, numbers, held = [], [], [], [], 0
        for batch in batches:
            for doc, blob, lone in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = np.frombuffer(blob, dtype=np.uint64)
                at = places(own)
                first = np.argsort(counts[at], kind="stable")[: len(own) - need(len(own)) + 1]
                owners.append(np.full(len(first), len(ids)))
                ids.append((doc, lone))
                grams.append(own[first])
                numbers.append(at[first])
                held += len(first)
                if held >= CHUNK:
                    yield np.array(ids, dtype=np.int64), *map(np.concatenate, (owners, grams, numbers))
                    ids, owners, grams, numbers, held = [], [], [], [], 0
        if ids:
            yield np.array(ids, dtype=np.int64), *map(np.concatenate, (owners, grams, numbers))

    def lead(batches):
        """Of each frequent n-gram the document that comes first, in this task."""
        found = np.empty((0, 3), dtype=np.int64)
        for ids, owners, _, numbers in prefixes(batches):
            hot = numbers >= 0
            found = _first_of(np.concatenate([found, np.column_stack([numbers[hot], ids[owners[hot]]])]))
        yield _pack(found, parts)

    def lead_all(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_first_of(_unpack(batches, 3)).tobytes()], pa.binary())], names=["rows"])

    hubs = np.full(len(keys), -1, dtype=np.int64)
    if len(keys):
        led = sets.select("doc_id", "grams", "lone").mapInArrow(lead, PACKED).repartitionById(parts, F.col("part")).mapInArrow(lead_all, "rows binary")
        for row in led.collect():  # at most HEAVY rows in all
            own = np.frombuffer(row["rows"], dtype=np.int64).reshape(-1, 3)
            hubs[own[:, 0]] = own[:, 1]
    hub_of = spark.sparkContext.broadcast(hubs)

    def deal(batches):
        for ids, owners, grams, numbers in prefixes(batches):
            hot = numbers >= 0
            yield _deal(ids[:, 0], owners[~hot], grams[~hot], cut, False, 0, ids[:, 1])
            pairs = np.unique(np.stack([hub_of.value[numbers[hot]], ids[owners[hot], 0]], axis=1), axis=0)
            packed = _pack(pairs, cut, 2)
            none = pa.array([b""] * packed.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([packed.column(0), none, none, none, none, packed.column(1)], names=["part", "docs", "counts", "residues", "multi", "sizes"])

    def meet(batches):
        for part, rows in _by_part(batches):
            met = _unpack_rows([s for *_, s in rows if s], 2)
            rows = [r for r in rows if not r[4]]
            lone = np.concatenate([np.empty(0, dtype=np.uint32), *(np.repeat(np.frombuffer(m, dtype=np.uint32), np.frombuffer(c, dtype=np.uint32)) for _, c, _, m, _ in rows)])
            keys, doc, _, _ = _dealt(part, rows)
            order = np.lexsort((rank_of(doc), lone, keys))
            start, length = _runs(keys[order])
            doc = doc[order]
            several = np.repeat(length > 1, length)
            pairs = np.concatenate([met, np.stack([np.repeat(doc[start], length)[several], doc[several]], axis=1)])
            yield _pack(np.unique(pairs, axis=0), parts, 2)

    def once(batches):
        pairs = np.unique(_unpack(batches, 2), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["hub", "doc_id"])

    dealt = by_range(sets.select("doc_id", "grams", "lone").mapInArrow(deal, DEALT), cut)
    return dealt.mapInArrow(meet, PACKED).repartitionById(parts, F.col("part")).mapInArrow(once, "hub long, doc_id long")


def _first_of(rows: np.ndarray) -> np.ndarray:
    """Of rows (key, document, its ``lone``) one for each key: the document that comes first."""
    order = np.lexsort((rank_of(rows[:, 1]), rows[:, 2], rows[:, 0]))
    start, _ = _runs(rows[order, 0])
    return rows[order[start]]


def link_block(sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a forest with the components of a block's links; positions in the block."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= PERCENT * (sizes[0] + sizes[1] - both) else []
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    often = times[code] > 1
    code, row = code[often], row[often]
    at = np.searchsorted(row, np.arange(m + 1))
    own = [code[at[i] : at[i + 1]] for i in range(m)]
    open_ = np.ones(m, dtype=bool)
    mask = np.zeros(len(times), dtype=bool)
    edges = []
    live = m
    for seed in range(m):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        while queue and open_.any():
            p = queue.pop()
            mask[own[p]] = True
            overlap = np.bincount(row[mask[code]], minlength=m)
            mask[own[p]] = False
            hit = np.flatnonzero(open_ & (100 * overlap >= PERCENT * (sizes[p] + sizes - overlap)) & (overlap > 0))
            edges += [(seed, int(h)) for h in hit]
            open_[hit] = False
            queue += hit.tolist()
            if len(hit) and 2 * open_.sum() < live:  # drop the rows that were reached
                live = int(open_.sum())
                stays = open_[row]
                code, row = code[stays], row[stays]
    return edges


def hub_bounds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``hub``, ``doc_id``, whether they are ``linked``, and bounds for others, ``low`` and ``high``.

    Sets link if they differ in at most r * (|x| + |y|) n-grams, r = (100 - PERCENT) / (100 + PERCENT). Let d be in how many a set differs from the hub and s how many
    of these occur in other documents too. x and y have at most the smaller s of such differences in common, and differ in all others: linked ones
    have 2 * min(s_x, s_y) >= d_x + d_y - r * (|x| + |y|). With low = d - r * |x| and high = 2 * s - low that is low_x <= high_y and low_y <= high_x."""
    r = (100 - PERCENT) / (100 + PERCENT)

    def compare(batches):
        centres: list[np.ndarray] = []  # several if the hub's doc_id has rows with different sets
        held = None
        for batch in batches:
            hub, salt, member, doc, lone, blobs = (batch.column(k).to_pylist() for k in range(6))
            out: list[tuple] = []
            for i in range(len(hub)):
                own = np.frombuffer(blobs[i], dtype=np.uint64)
                if member[i] == 0:
                    centres = [*centres, own] if (hub[i], salt[i]) == held else [own]
                    held = (hub[i], salt[i])
                    continue
                assert (hub[i], salt[i]) == held
                for centre in centres:
                    at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                    both = int((centre[at] == own).sum())
                    out.append((hub[i], doc[i], both, len(own), len(own) + len(centre) - both, lone[i], len(centres)))
            _, _, both, n, union, own_lone, several = (np.array([r[k] for r in out], dtype=np.int64) for k in range(7))
            low = np.where(several > 1, -1e18, union - both - r * n)  # bounds are those of one hub
            high = np.where(several > 1, 1e18, 2 * (union - both - own_lone) - low + 1e-6)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array(100 * both >= PERCENT * union), pa.array(low), pa.array(high)],
                names=["hub", "doc_id", "linked", "low", "high"],
            )

    loaded = with_data(star_rows(members, "doc_id"), sets.select("doc_id", "lone", "grams"), "doc_id").select("hub", "salt", "member", "doc_id", "lone", "grams")
    return gather(loaded, "hub", "salt", within=["member", "doc_id"]).mapInArrow(compare, "hub long, doc_id long, linked boolean, low double, high double")


def link_edges(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between representatives."""
    star = materialise(hub_bounds(members, sets), "gram-star")
    dealt = open_pairs(star, "doc_id", BLOCK)

    def link(batches):
        held: tuple | None = None
        docs: list[int] = []
        sets_: list[np.ndarray] = []
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4).to_pylist())
            a, b = [], []
            for hub, i, j, doc, blob in rows:
                if (hub, i, j) != held:
                    for x, y in link_block(np.array([len(s) for s in sets_]), sets_) if len(docs) > 1 else ():
                        a.append(docs[x])
                        b.append(docs[y])
                    held, docs, sets_ = (hub, i, j), [], []
                docs.append(doc)
                sets_.append(np.frombuffer(blob, dtype=np.uint64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(docs) > 1:
            found = link_block(np.array([len(s) for s in sets_]), sets_)
            yield pa.RecordBatch.from_arrays([pa.array([docs[x] for x, _ in found], pa.int64()), pa.array([docs[y] for _, y in found], pa.int64())], names=["a", "b"])

    loaded = with_data(dealt, sets.select("doc_id", "grams"), "doc_id").select("hub", "i", "j", "doc_id", "grams")
    rest = gather(loaded, "hub", "i", "j", within=["doc_id"]).mapInArrow(link, "a long, b long")
    return star.where("linked").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).unionByName(rest)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document of ``docs`` (``doc_id``, ``text``)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    counts = materialise(shared_counts(docs), "gram-counts", small=True)
    # with several rows of a doc_id this lets it go on if any of them could link, as its smallest set needs the fewest
    going = counts.where(f"n > 0 and 100 * shared >= {PERCENT} * least").select("doc_id")
    few = going.count() <= BROADCAST_IDS
    near = docs.join(F.broadcast(going) if few else going, "doc_id", "left_semi")
    sets = materialise(digests_of(near), "gram-digests")
    classes = materialise(sets.groupBy("digest").agg(F.min("doc_id").alias("rep")), "gram-classes", small=True)
    lone = counts.select("doc_id", F.when(F.col("least") == F.col("n"), F.greatest(F.col("n") - F.col("shared"), F.lit(0))).otherwise(0).alias("lone"))  # rows of one doc_id with sets of several sizes: not known
    reps = materialise(classes.select(F.col("rep").alias("doc_id")).join(lone, "doc_id"), "gram-lone", small=True)
    own = grams_of(docs.join(F.broadcast(reps) if few else reps, "doc_id"))
    own = materialise(own.where(F.length("grams") > 0), "gram-reps")  # read for frequencies, for meeting places and for the products
    edges = link_edges(materialise(block_members(own), "gram-blocks", small=True), own)
    found = components(materialise(edges, "gram-edges"))
    member = sets.select("doc_id", "digest").join(classes, "digest").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    known = counts.join(member, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    lost = docs.where("doc_id is null")
    return known.unionByName(digests_of(lost).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    Of several such rows with one doc_id and equal texts one stays; rows of one doc_id with different texts are one document and stay
    together. Rows with a null doc_id are left alone."""
    gone = materialise(jaccard_components(docs).where("doc_id <> component_id").select("doc_id"), "gram-gone", small=True)
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*map(column, docs.columns))
    keys = ["doc_id", "text"]
    mark = F.xxhash64(F.lit(1), "text").alias("__text")
    again = left.where("doc_id is not null").groupBy("doc_id", mark).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.col("__text"))
    again = materialise(again, "gram-repeats", small=True)
    if again.isEmpty():
        return left
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    marked = left.select(F.struct(*map(column, left.columns)).alias("row"), F.col("doc_id"), mark)  # names can't clash inside
    rows = marked.join(again, ["doc_id", "__text"], "left_anti").select("row")
    rows = rows.unionByName(marked.join(again, ["doc_id", "__text"], "left_semi").groupBy(*(F.col(f"row.{k}").alias(k) for k in keys)).agg(F.first("row").alias("row")).select("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in left.columns))


#: The same for documents with distinct doc_ids by plain joins, in DuckDB's SQL; quadratic in a passage's documents, so for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, len(g)::BIGINT AS n FROM s
), e AS (
  SELECT doc_id, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
