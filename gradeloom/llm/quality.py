"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Statistics of each whole text (lengths, shares of character classes, repetition of words and lines) are standardised and
mapped to ``cos(x W + b)`` features, whose inner products approximate a Gaussian kernel. Training rows' normal equations
are summed by partition and solved for ridge weights; raw scores of rows that the fit didn't see are calibrated to label
rates by pooling adjacent violators. Scoring is one pass over the texts without a shuffle.

Training uses at most ``TRAIN_ROWS`` labelled rows, the first by a hash of doc_id; its normal equations come from at most
``TRAIN_PARTS`` tasks.

Defined cases: null and empty texts have all-zero counts and get a score like any other. Repeated label rows of a doc_id count
once (the highest quality). Null labels are ignored. Without usable labels (none, or one class) every score is the share
of label 1, or 0.5 without labels. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fields, own
from .textkernel import join_texts, mix, word_hashes, words
from .wordbpe import text_slices

FEATURES = 384
TRAIN_ROWS = 60_000
TRAIN_PARTS = 8
RIDGE = 1e-4
SEED = 17


def _class_table() -> np.ndarray:
    t = np.zeros(256, dtype=np.int8)
    t[65:91] = 1
    t[97:123] = 2
    t[48:58] = 3
    for c in b".,;:'\"()-?":
        t[c] = 4
    for c in b"#$%&*@=+<>[]{}\\^_`~/":
        t[c] = 5
    t[ord("|")], t[ord("!")] = 6, 7
    t[[9, 11, 12, 13, 32]] = 8
    t[10] = 9
    t[128:] = 10
    return t


CLASS = _class_table()
STATISTICS = 20


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS numbers for each whole text."""
    raw = np.frombuffer(b"\n" + b"\n".join((t or "").encode() for t in texts) + b"\n", dtype=np.uint8)
    data, first = join_texts(texts)
    n_docs = len(texts)
    size = np.diff(first) - 1
    doc_of = np.repeat(np.arange(n_docs), np.diff(first))
    classes = np.bincount(doc_of * 16 + CLASS[raw[1:]], minlength=16 * n_docs).reshape(n_docs, 16).astype(np.float64)
    classes[:, 9] -= 1  # the line end that joins texts
    starts, ends = words(data)
    cut = np.searchsorted(starts, first)
    count = np.diff(cut)
    owner = np.repeat(np.arange(n_docs), count)
    length = (ends - starts).astype(np.float64)
    hashes = word_hashes(data, starts, ends)

    def repeats(of_doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each document and how often its most frequent one occurs."""
        both = np.sort((of_doc.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
        if not len(both):
            return np.zeros(n_docs), np.zeros(n_docs)
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        run = np.diff(np.concatenate([new, [len(both)]]))
        doc = (both[new] >> np.uint64(44)).astype(np.int64)
        most = np.zeros(n_docs)
        np.maximum.at(most, doc, run)
        return np.bincount(doc, minlength=n_docs).astype(np.float64), most

    distinct, most = repeats(owner, hashes)
    line_cut = np.zeros(256, dtype=bool)
    line_cut[10] = True
    line_a, line_b = words(data, line_cut)
    line_doc = np.searchsorted(first, line_a, side="right") - 1
    line_word = np.searchsorted(starts, line_a)
    words_to = np.searchsorted(starts, line_b)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)  # a line is told by the sum of its words' hashes
    np.cumsum(mix(hashes), out=sums[1:])
    lines = np.bincount(line_doc, minlength=n_docs).astype(np.float64)
    line_kinds, line_most = repeats(line_doc, mix(sums[words_to] - sums[line_word]))
    marked = np.concatenate([[0], np.cumsum(np.isin(CLASS[raw], (5, 6, 7)))])
    has_mark = (marked[ends] - marked[starts]) > 0

    def per(a, b):
        return np.divide(a, b, out=np.zeros(n_docs), where=b > 0)

    total = size.astype(np.float64)
    letters = classes[:, 1] + classes[:, 2] + classes[:, 10] / 2
    mean_len = per(np.bincount(owner, length, n_docs), count.astype(np.float64))
    var_len = per(np.bincount(owner, length**2, n_docs), count.astype(np.float64)) - mean_len**2
    n = count.astype(np.float64)
    out = np.stack(
        [
            np.log1p(total),
            np.log1p(n),
            per(classes[:, 1], letters),
            per(classes[:, 3], total),
            per(classes[:, 4], total),
            np.log1p(1000 * per(classes[:, 5], total)),
            np.log1p(1000 * per(classes[:, 6], total)),
            np.log1p(1000 * per(classes[:, 7], total)),
            per(classes[:, 8], total),
            np.log1p(1000 * per(classes[:, 9], total)),
            per(classes[:, 10], total),
            mean_len,
            np.sqrt(np.maximum(var_len, 0)),
            per(distinct, n),
            np.log1p(distinct) - np.log1p(n),
            per(most, n),
            per(line_kinds, lines),
            per(line_most, lines),
            per(np.bincount(owner, has_mark, n_docs), n),
            np.log1p(per(n, lines)),
        ],
        axis=1,
    )
    return out


def projection(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases for the kernel exp(-|x - y|**2 / (2 * STATISTICS))."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.standard_normal((STATISTICS, FEATURES)) / np.sqrt(STATISTICS), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features, and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    w, b = projection()
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))], axis=1)


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """X'X and X'y of the even and of the odd rows (``half``), summed in each partition, then over partitions."""
    d = FEATURES + 1

    def sums(batches):
        xx, xy = np.zeros((2, d, d)), np.zeros((2, d))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, STATISTICS)
            y, half = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            f = fourier(x, mean, scale)
            for h in (0, 1):
                xx[h] += f[half == h].T @ f[half == h]
                xy[h] += f[half == h].T @ y[half == h]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([m.tobytes() for m in xx], pa.binary()), pa.array([v.tobytes() for v in xy], pa.binary())], names=["half", "xx", "xy"])

    parts = rows.select("x", "y", "half").coalesce(TRAIN_PARTS).mapInArrow(sums, "half int, xx binary, xy binary").collect()
    return [
        (
            sum((np.frombuffer(r["xx"]).reshape(d, d) for r in parts if r["half"] == h), np.zeros((d, d))),
            sum((np.frombuffer(r["xy"]) for r in parts if r["half"] == h), np.zeros(d)),
        )
        for h in (0, 1)
    ]


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    penalty = np.full(len(xy), RIDGE * max(1.0, xx[-1, -1]))
    penalty[-1] = 1e-9
    return np.linalg.solve(xx + np.diag(penalty), xy)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function of least squares: pool adjacent violators."""
    order = np.argsort(raw, kind="stable")
    values, at = np.unique(raw[order], return_index=True)
    weight = np.diff(np.concatenate([at, [len(raw)]])).astype(np.float64)
    total = np.add.reduceat(y[order].astype(np.float64), at)
    blocks: list[list[float]] = []  # total, weight, first, last
    for i in range(len(values)):
        blocks.append([total[i], weight[i], values[i], values[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, _, last = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w
            blocks[-1][3] = last
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in ((b[0] + 0.5) / (b[1] + 1),) * 2])  # kept off 0 and 1 by half a row
    return xs, np.maximum.accumulate(ys)


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, label and half of at most about TRAIN_ROWS documents. Rows of one doc_id are one training row: the first by its statistics."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 0.97 * TRAIN_ROWS / n))
    known = known.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).cast("int"))

    def stats(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(0)):
                x = statistics(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), *(batch.column(i).slice(first, len(texts)) for i in (1, 2, 3))], names=["x", "y", "half", "doc_id"]
                )

    # at most TRAIN_ROWS rows of three numbers are broadcast
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").select("text", "y", "half", "doc_id")
    rows = found.mapInArrow(stats, "x array<double>, y double, half int, doc_id long")
    return rows.groupBy("doc_id", "y", "half").agg(F.min("x").alias("x")).select("x", "y", "half")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights and calibration; ``docs`` and ``labels`` hold only rows that may be learnt from."""
    from .scratch import materialise

    rows = materialise(_training_rows(docs, labels), "quality-train")
    first = rows.agg(F.count("*").alias("n"), F.avg("y").alias("rate")).first()
    if not first["n"] or first["rate"] in (0.0, 1.0):
        return {"flat": 0.5 if not first["n"] else float(first["rate"])}
    moments = rows.agg(*(f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([moments[f"m{i}"] for i in range(STATISTICS)])
    scale = np.array([max(moments[f"s{i}"], 1e-6) for i in range(STATISTICS)])
    halves = normal_equations(rows, mean, scale)
    beta = solve(halves[0][0] + halves[1][0], halves[0][1] + halves[1][1])
    other = [solve(*halves[1]), solve(*halves[0])]  # each half is scored by the other's weights

    def unseen(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, STATISTICS)
            half = batch.column(2).to_numpy(zero_copy_only=False)
            f = fourier(x, mean, scale)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(half == 0, f @ other[0], f @ other[1])), batch.column(1)], names=["raw", "y"])

    seen = rows.select("x", "y", "half").mapInArrow(unseen, "raw double, y double").toPandas()  # at most TRAIN_ROWS pairs
    xs, ys = isotonic(np.round(seen["raw"].to_numpy(), 6), seen["y"].to_numpy())
    return {"mean": mean, "scale": scale, "beta": beta, "xs": xs, "ys": ys}


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    if "flat" in model:
        return np.full(len(texts), model["flat"])
    raw = fourier(statistics(texts), model["mean"], model["scale"]) @ model["beta"]
    return np.clip(np.interp(raw, model["xs"], model["ys"]), 0.0, 1.0)


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score``; a column of that name is replaced."""
    keep = [c for c in keep if c != "score"]
    rows = docs.select(*map(own, keep)) if text_col in keep else docs.select(*map(own, keep), own(text_col))
    at = rows.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(at)):
                kept = [batch.column(k).slice(first, len(texts)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score_texts(texts, model))], names=[*keep, "score"])

    return rows.mapInArrow(run, fields(docs, keep, "score double"))


def held_out(folds: int = 4, fold: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores of every document, learnt from labels outside the held-out fold."""
    model = train(docs, labels.where(~held_out()))
    base = docs.select("doc_id", "text", held_out().alias("held_out"))
    return score(base, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns."""
    renamed = {"score": "__own_score"} if "score" in docs.columns else {}
    scored = score(docs.withColumnsRenamed(renamed), train(docs, labels.where(~held_out())), [renamed.get(c, c) for c in docs.columns])
    return scored.where(F.col("score") >= threshold).select(*(own(renamed.get(c, c)).alias(c) for c in docs.columns))
