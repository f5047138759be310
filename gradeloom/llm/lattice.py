"""Near-duplicate vectors by lattice hashing.

Random projections take each unit vector into several 8-dimensional spaces, where the nearest point of the E8 lattice is its cell; a
table's key joins the cells of LATTICES spaces. Besides its own cell a vector probes the neighbouring cell on the far side
of its own remainder, in each space: 2**LATTICES keys a table. Two vectors are compared if they meet in a key of any of TABLES tables.

1. Equal vectors of a label are one class, represented by the smallest vec_id.
2. Keys alone are grouped. All that meet in a key join the block of the one that comes first in a fixed random
   order, its hub, so that a group of near copies meets in few blocks. That one is a minimum by key, which tasks combine; members find it by a join that is broadcast
   for keys with many members.
3. Each member of a block is compared with its hub, in salted groups (``blocks.star_rows``); angles obey the triangle inequality, so most members of a group of near copies are done
   with that. What is left is cut into pieces of BLOCK; the cosines of a pair of pieces are one matrix product in double precision, and only the edges of a forest of its links leave the task.
4. All links of a vector lie in its component, so links are counted there, again by products of pieces; their size grows with the component's, up to PIECE.

Vectors at the threshold of 0.98 meet in one table with probability 0.77 and so in one of eight with 1 - 8e-6; closer ones with
more. Recall is measured against brute force in the tests.

Defined cases: rows with a null label, a null, empty or zero vector, or one with null or non-finite components link with
nothing. Vectors of different lengths aren't compared. Rows with a null vec_id are left alone (component null, kept). Repeated vec_ids
are one vector each, but share one row's component. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BROADCAST_ROWS, gather, open_pairs, piece_pairs, star_rows, with_data
from .components import components
from .ngram_join import rank_of
from .scratch import materialise, width
from .textkernel import mix

TABLES = 8
LATTICES = 2
CELL = 0.7
SEED = 8
BLOCK = 1_024
#: Least and largest piece of a component whose links are counted; rows of a product that are held at a time.
LEAST_PIECE = 64
PIECE = 4_096
STRIP = 512
#: Members from which a key's hub is broadcast, and such keys at most; any further one has fewer members than a HEAVY_KEYS-th of all.
OFTEN = 1_024
HEAVY_KEYS = 200_000


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 (twice the integer points of even sum, and the same shifted by a half), doubled to integers."""

    def even(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
        rest = y[odd] - r[odd]
        k = np.abs(rest).argmax(1)
        r[odd, k] += np.where(rest[np.arange(len(odd)), k] >= 0, 1, -1)
        return r

    a, b = even(x), even(x - 0.5) + 0.5
    first = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(first[:, None], a, b)).astype(np.int64)


def _projections(dim: int) -> np.ndarray:
    """TABLES x LATTICES matrices of dim x 8 that keep a unit vector's expected length, over the cell size."""
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    raw = rng.standard_normal((TABLES, LATTICES, dim, 8))
    if dim < 8:
        return raw / np.sqrt(8) / CELL
    return np.linalg.qr(raw)[0] * np.sqrt(dim / 8) / CELL


_MATRICES: dict[int, np.ndarray] = {}


def keys(unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """For each unit vector (a row) its TABLES x 2**LATTICES keys; ``salt`` (its label) goes into each."""
    dim = unit.shape[1]
    if dim not in _MATRICES:
        _MATRICES[dim] = _projections(dim)
    factors = np.random.Generator(np.random.PCG64(SEED)).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(unit), TABLES, 2**LATTICES), dtype=np.uint64)
    for t in range(TABLES):
        cells = []
        for k in range(LATTICES):
            x = unit @ _MATRICES[dim][t, k]
            home = nearest_e8(x)
            probe = nearest_e8(home / 2 + 1.6 * (x - home / 2))
            cells.append([mix((c.view(np.uint64) * factors).sum(1, dtype=np.uint64) + np.uint64(k)) for c in (home, probe)])
        for j in range(2**LATTICES):
            whole = salt.copy()
            for k in range(LATTICES):
                whole = mix(whole * np.uint64(31) + cells[k][j >> k & 1])
            out[:, t, j] = mix(whole + np.uint64(1000 * t + dim * 7919))
    return out.reshape(len(unit), -1)


def _rows(batch_column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of an Arrow list column."""
    return batch_column.values.to_numpy(zero_copy_only=False).astype(np.float64), batch_column.offsets.to_numpy()


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keyed(vectors: DataFrame) -> DataFrame:
    """``key``, ``vec_id`` and its ``rank`` in the fixed order: the distinct keys of each vector."""

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            values, at = _rows(batch.column(2))
            size = np.diff(at)
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                x = values[at[own][:, None] + np.arange(dim)]
                found = keys(_unit(x), mix(label[own] + np.uint64(1)))
                flat = np.sort(found, axis=1)
                new = np.concatenate([np.ones((len(own), 1), dtype=bool), flat[:, 1:] != flat[:, :-1]], axis=1)
                vec = np.repeat(ids[own], new.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(flat[new].view(np.int64)), pa.array(vec), pa.array(rank_of(vec).view(np.int64))], names=["key", "vec_id", "rank"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(deal, "key long, vec_id long, rank long")


def block_members(vectors: DataFrame) -> DataFrame:
    """``hub`` and ``vec_id``: the blocks that each vector of a table of classes is in."""
    found = materialise(keyed(vectors), "vector-keys")
    hubs = found.groupBy("key").agg(F.min_by("vec_id", "rank").alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = materialise(hubs, "vector-hubs", small=True)
    heavy = hubs.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "key").limit(HEAVY_KEYS).select("key", "hub")
    pairs = found.join(F.broadcast(heavy), "key").select("hub", "vec_id")
    light = hubs.join(F.broadcast(heavy.select("key")), "key", "left_anti").select("key", "hub")
    return pairs.unionByName(found.join(light, "key").select("hub", "vec_id")).distinct()


def _groups(batches, keys: int):
    """Consecutive rows with equal first ``keys`` columns: yields (key, the other columns); the last column, of vectors, as a list of arrays."""
    held, parts = None, []

    def whole():
        return held, [np.concatenate(c) if i < len(parts[0]) - 1 else [x for c_ in c for x in c_] for i, c in enumerate(zip(*parts))]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)], axis=1)
        others = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys, batch.num_columns - 1)]
        values, at = _rows(batch.column(batch.num_columns - 1))
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = tuple(key[a].tolist())
            if own != held:
                if parts:
                    yield whole()
                held, parts = own, []
            parts.append([*(c[a:b] for c in others), [values[at[i] : at[i + 1]] for i in range(a, b)]])
    if parts:
        yield whole()


def _by_length(vectors: list[np.ndarray]):
    """Places of the vectors of each length, and the unit vectors as a matrix."""
    dims = np.array([len(v) for v in vectors])
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield at, _unit(np.stack([vectors[i] for i in at]))


def hub_angles(members: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``hub``, ``vec_id``, whether they are ``linked``, and bounds for others: two vectors whose angles to the hub differ by more than the threshold's don't link (``low``, ``high``)."""
    reach = float(np.arccos(threshold)) + 1e-9

    def compare(batches):
        for (hub, _), (member, ids, embeddings) in _groups(batches, 2):
            cosine = np.full(len(ids), -1.0)
            for at, x in _by_length(embeddings):
                if at[0] == 0:  # the hub comes first; vectors of another length are as far as can be
                    cosine[at] = x @ x[0]
            own = member == 1
            cosine = np.clip(cosine[own], -1.0, 1.0)
            angle = np.arccos(cosine)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), hub)), pa.array(ids[own]), pa.array(cosine >= threshold), pa.array(angle), pa.array(angle + reach)], names=["hub", "vec_id", "linked", "low", "high"])

    loaded = with_data(star_rows(members, "vec_id"), vectors.select("vec_id", "embedding"), "vec_id").select("hub", "salt", "member", "vec_id", "embedding")
    return gather(loaded, "hub", "salt", within=["member", "vec_id"]).mapInArrow(compare, "hub long, vec_id long, linked boolean, low double, high double")


def link_edges(members: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Edges ``a``, ``b`` of forests over each block's links."""
    star = materialise(hub_angles(members, vectors, threshold), "vector-star")

    def link(batches):
        for _, (ids, embeddings) in _groups(batches, 3):
            a, b = [], []
            for own, x in _by_length(embeddings):
                close = x @ x.T >= threshold
                open_ = np.ones(len(own), dtype=bool)
                for seed in range(len(own)):
                    if not open_[seed]:
                        continue
                    open_[seed] = False
                    queue = [seed]
                    while queue and open_.any():
                        hit = np.flatnonzero(close[queue.pop()] & open_)
                        open_[hit] = False
                        queue += hit.tolist()
                        a += [ids[own[seed]]] * len(hit)
                        b += [ids[own[h]] for h in hit]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = open_pairs(star, "vec_id", BLOCK)
    loaded = with_data(dealt, vectors.select("vec_id", "embedding"), "vec_id").select("hub", "i", "j", "vec_id", "embedding")
    rest = gather(loaded, "hub", "i", "j", within=["vec_id"]).mapInArrow(link, "a long, b long")
    return star.where("linked").select(F.col("hub").alias("a"), F.col("vec_id").alias("b")).unionByName(rest)


def count_links(found: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``vec_id`` and ``linked``: rows in other classes that each class links with directly, in its component."""

    def count(batches):
        for (_, i, j), (own, ids, times, embeddings) in _groups(batches, 3):
            n = np.zeros(len(ids), dtype=np.int64)
            for at, x in _by_length(embeddings):
                for first in range(0, len(at), STRIP):
                    rows = np.arange(first, min(first + STRIP, len(at)))
                    close = x[rows] @ x.T >= threshold
                    close[np.arange(len(rows)), rows] = False
                    if i != j:  # pairs inside a piece are counted in the piece's own block
                        close &= own[at[rows]][:, None] != own[at][None, :]
                    n[at[rows]] = close @ times[at]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["vec_id", "linked"])

    members = found.select(F.col("component"), F.col("node").alias("vec_id"))
    most = F.least(F.lit(PIECE), F.greatest(F.lit(LEAST_PIECE), F.ceil(F.col("m") / LEAST_PIECE)))
    dealt = piece_pairs(members, "component", "vec_id", most)
    loaded = with_data(dealt, vectors.select("vec_id", "times", "embedding"), "vec_id").select("component", "i", "j", "own", "vec_id", "times", "embedding")
    rows = gather(loaded, "component", "i", "j", within=["vec_id"]).mapInArrow(count, "vec_id long, linked long")
    return rows.groupBy("vec_id").agg(F.sum("linked").alias("linked"))


def usable(vector, label):
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(table: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``table`` (``vec_id``, ``embedding``, ``label``)."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("embedding"))  # -0.0 is 0.0
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding"), F.col("label"))
    # two marks stand for label and vector when rows look for their class; those of unusable rows are null and meet nothing
    marks = [F.when(good, F.xxhash64(F.lit(k), "label", "embedding")).alias(f"mark{k}") for k in (1, 2)]
    rows = rows.select("*", *marks)
    classes = rows.where("mark1 is not null").groupBy("mark1", "mark2", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    classes = materialise(classes, "vector-classes")
    vectors = classes.select(F.col("rep").alias("vec_id"), "label", "embedding", "times")
    members = materialise(block_members(vectors), "vector-blocks", small=True)
    found = materialise(components(materialise(link_edges(members, vectors, threshold), "vector-edges")), "vector-components", small=True)
    linked = count_links(found, vectors, threshold)
    known = (
        classes.select("mark1", "mark2", F.col("rep").alias("node"), "times")
        .join(found, "node", "left")
        .join(linked.withColumnRenamed("vec_id", "node"), "node", "left")
        .select("mark1", "mark2", F.coalesce("component", "node").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("links"))
    )
    known = materialise(known, "vector-known", small=True)
    spread = F.coalesce("mark1", F.monotonically_increasing_id()).alias("mark1")  # unusable rows still meet nothing (mark2 is null), but don't meet in one task either
    out = rows.select("vec_id", spread, "mark2").join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, ["mark1", "mark2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


#: The same for whole vectors with distinct vec_ids by comparing all of a label, in DuckDB's SQL; for small tables.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), k AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT c.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN k ON k.vec_id = c.vec_id
"""
