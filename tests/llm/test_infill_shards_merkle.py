import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.llm import sharding
from gradeloom.llm.infill import cut_points, fill_in_middle, infill_digests, restored
from gradeloom.llm.merkle import fold, leaf_digest, manifest, proof_digests
from gradeloom.llm.rankselect import BitVector
from gradeloom.llm.scratch import scratch_path
from gradeloom.llm.sharding import Layout, Matrix, divided, even, hypergeometric, shard_digests, write_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=1500))
def test_rank_and_select(bits):
    bits = np.array(bits, dtype=bool)
    v = BitVector(bits)
    assert v.total == bits.sum()
    assert (v.rank(np.arange(len(bits) + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
    assert (v.select(np.arange(v.total)) == np.flatnonzero(bits)).all()


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aé\U0001f600 \t\n\x0b\x1c <P>", max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=6))
def test_cuts_are_those_of_the_units(rows):
    raw = [t.encode() for t, _, _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    n, a, b, points = cut_points(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, *(np.array([r[k] for r in rows]) for k in (1, 2)))
    for k, (text, x, y) in enumerate(rows):
        units = UNIT.findall(text)
        cuts = sorted((x % (len(units) + 1), y % (len(units) + 1)))
        assert n[k] == len(units)
        for cut, at in zip(cuts, (a[k], b[k])):
            head = "".join(units[:cut])
            assert at - offsets[k] == len(head.encode()) and points.rank(at) - points.rank(offsets[k]) == len(head)


def plain_infill(doc_id, text):
    text = text or ""
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, len(p), len(m), sha(out), sha(text)


def test_infill_equals_plain(spark, odd_texts):
    texts = [*odd_texts, "a <P> b", "<<S", "ends with <S", "M> begins", "  lead", "trail  ", "  \x85 　x"]
    rows = [(i, t, "x") for i, t in enumerate(texts * 6)] + [(None, "a b c", "x"), (7, "again", "y"), (7, "again", "y"), (None, None, None)]
    got = infill_digests(spark.createDataFrame(rows, "doc_id long, text string, form string")).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, ((i, *plain_infill(i, t)) for i, t, _ in rows)))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_infill_of_other_rates_and_marks(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 30)) for i in range(200)], "doc_id long, text string")
    marks = ("[pre.]", "[suf*]", "[mid+]")
    made = fill_in_middle(docs, seed=1, percent=100, spm_percent=0, marks=marks)
    got = made.join(docs, "doc_id").select(restored(F.col("output"), F.col("form"), marks).alias("r"), "text", "form", "output").collect()
    assert all(r.r == r.text for r in got)
    assert {r.form for r in got} == {"psm", "plain"} and all((r.form == "plain") == (r.text == "") for r in got)


def test_matrix_has_exact_margins():
    blocks, cells = np.array([5, 0, 17, 1, 40, 8, 29]), even(100, 7)
    m = Matrix(blocks, cells, 3)
    rows = np.array([m.row(k) for k in range(7)])
    assert (rows.sum(1) == blocks).all() and (rows.sum(0) == cells).all() and (rows >= 0).all()
    assert all((np.bincount(m.labels(k), minlength=7) == rows[k]).all() for k in range(7))
    assert not (rows == np.array([Matrix(blocks, cells, 4).row(k) for k in range(7)])).all()


def test_large_draws_follow_the_law(monkeypatch):
    rng = np.random.default_rng(5)
    small = rng.hypergeometric(300, 700, 400, 20_000)
    monkeypatch.setattr(sharding, "LARGE", 1)
    large = np.array([hypergeometric(rng, 300, 700, 400) for _ in range(20_000)])
    assert abs(small.mean() - large.mean()) < 0.3 and abs(small.std() / large.std() - 1) < 0.03
    assert [hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (4, 6, 10), (4, 6, 0))] == [0, 3, 4, 0]
    sizes = np.array([3 * 10**12, 10**12, 2 * 10**12])
    got = divided(rng, sizes, 3 * 10**12)
    assert got.sum() == 3 * 10**12 and (abs(got - sizes / 2) < 10**8).all()


@pytest.mark.parametrize("rows", [0, 3, 16, 100, 1001])
def test_shards_are_exact_whole_and_gapless(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    data = [(None if i % 5 == 0 else i // 2, None if i % 7 == 0 else "é" * (i % 4), "s", i, i) for i in range(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, cell string, slot long, number long").repartition(3, "number")
    out = write_shards(docs, scratch_path(spark, "t"), 16, 9)
    assert out.columns == ["doc_id", "text", "cell", "number", "slot", "shard"]
    got = out.collect()
    assert sorted(repr(tuple(r)[:4]) for r in got) == sorted(repr(tuple(d[:3]) + (d[4],)) for d in data)
    sizes = [sum(r.shard == k for r in got) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))


def test_every_place_is_equally_likely(spark):
    blocks, layout = np.array([5, 3, 4]), Layout(12, 2, 4)
    seen = np.zeros((12, len(layout.sizes)))
    for seed in range(3000):
        m = Matrix(blocks, layout.sizes, seed)
        row = 0
        for b in range(3):
            for cell in m.labels(b):
                seen[row, cell] += 1
                row += 1
    want = 3000 * layout.sizes / 12
    assert (((seen - want) ** 2 / want).sum(1) < 25).all()


def test_shard_digests(spark, odd_texts):
    rows = [(i, t, "x") for i, t in enumerate(odd_texts)]
    got = {r.doc_id: r for r in shard_digests(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def plain_merkle(rows):
    """The contract, one list at a time; rows as in DOCS."""

    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        """Root, and for each node its path as (left, right) pairs."""
        paths, places = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(places):
                run = at // 16 * 16
                paths[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
                places[k] = at // 16
            nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made[s] = own, *tree([leaf(r, r[1]) for r in own])
    root, tops = tree([made[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        own, subroot, paths = made[s]
        for r, path in zip(own, paths):
            path = path + top
            at = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                at = leaf(r, re.sub("[A-Z]", lambda m: m.group().lower(), r[1]))
            for left, right in path:
                at = sha(left + at + right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in path)), at, at == root))
    return out


def check_merkle(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"pos": F.lit(1), "grp": F.lit("x"), "digest": F.lit("y"), "a b": F.lit(2)})
    got = [tuple(r) for r in proof_digests(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_merkle(rows)))


def test_merkle_equals_plain(spark, odd_texts):
    names = ["web", None, "", "é", "Z"] + [f"s{k}" for k in range(14)]
    rows = [(i, odd_texts[i % len(odd_texts)], "en" if i % 3 else None, "web" if i % 2 else names[i % 19], i if i % 4 else None) for i in range(600)]
    rows += [(None, "no id", "en", "web", 1), (None, None, None, None, None), (5, "Twice", "en", "web", 1), (5, "Twice", "en", "web", 1), (77, "lone", "en", "lone source", 1)]
    check_merkle(spark, rows)


def test_merkle_of_few_and_of_equal_rows(spark):
    check_merkle(spark, [(1, "A", "en", "web", 1)])
    check_merkle(spark, [(1, "A", "en", "web", 1), (2, "B", "en", None, 1)])
    check_merkle(spark, [(3, "Same", "en", "web", 4)] * 300 + [(k, "x", "en", "web", 1) for k in range(257)])
    assert proof_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_proofs_are_for_the_manifest_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 3}") for i in range(100)], "doc_id long, text string, source string")
    found = manifest(docs, [F.col("doc_id"), F.col("text")], "doc_id", "source", {"other": leaf_digest([F.col("doc_id"), F.lit("forged")])}).proofs()
    rows = found.select("root", fold(F.col("digest"), F.col("proof")).alias("good"), fold(F.col("other"), F.col("proof")).alias("bad")).collect()
    assert len(rows) == 100 and all(r.good == r.root != r.bad for r in rows)
