import re
from collections import Counter

import numpy as np
import pytest

from gradeloom.llm import components, lattice, ngram_join
from gradeloom.llm.textkernel import HashTable, gram_hashes, join_texts, word_hashes, words


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(ids, texts):
    own = sets(texts)
    label = dict(zip(ids, ids))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    by_gram = {}
    for i, s in zip(ids, own):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    size = {i: len(s) for i, s in zip(ids, own)}
    for i, s in zip(ids, own):
        for j, both in Counter(j for g in s for j in by_gram[g] if j > i).items():
            if 100 * both >= 80 * (size[i] + size[j] - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (size[i], root(i)) for i in ids}


def test_gram_hashes_tell_sequences_apart():
    texts = ["a b c d e f", "A b C d e", "a b", "ab", "", None, "b a", "a  b\x0bc\x0cd\re"]
    data, first = join_texts(texts)
    s, e = words(data)
    grams, counts = gram_hashes(word_hashes(data, s, e), np.diff(np.searchsorted(s, first)), 5)
    assert counts.tolist() == [2, 1, 1, 1, 0, 0, 1, 1]
    assert grams[0] == grams[2] == grams[6] and len(set(grams.tolist())) == 5


def test_long_words_and_steps_hash_alike():
    import gradeloom.llm.textkernel as k

    texts = ["x" * 5000 + " y " + "z" * 3000, "z" * 3000]
    data, _ = join_texts(texts)
    s, e = words(data)
    whole = word_hashes(data, s, e)
    step, k.STEP = k.STEP, 64
    try:
        assert (word_hashes(data, s, e) == whole).all() and whole[2] == whole[3]
    finally:
        k.STEP = step


def test_hash_table():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    t = HashTable(4)
    for part in np.array_split(np.unique(keys), 7):
        t.add(part)
    assert (np.sort(t.find(np.unique(keys))) == np.arange(len(np.unique(keys)))).all()
    assert (t.find(rng.integers(2**63, 2**64 - 1, 100, dtype=np.uint64)) == -1).all()


def near_copies(n, seed=0, length=60):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10_000, length)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, length, rng.integers(0, 4)):
            w[k] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def check_join(spark, ids, texts):
    df = spark.createDataFrame(list(zip(ids, texts, [0] * len(ids))), "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute(ids, texts)


def test_join_on_near_copies_passages_and_odd_texts(spark, odd_texts):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = near_copies(60) + near_copies(40, 1) + [f"{passage} " + " ".join(f"u{i}_{k}" for k in range(30 + i)) for i in range(60)] + [passage + f" tail{i}" for i in range(30)] + odd_texts + ["same copy of one text here"] * 25
    ids = (np.arange(len(texts)) * 7 - 50).tolist()
    check_join(spark, ids, texts)


def test_join_cuts_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "CHUNK", 500)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 1)
    texts = near_copies(70, 3)
    check_join(spark, list(range(len(texts))), texts)


def test_join_at_the_bound(spark):
    a = [f"w{i}" for i in range(13)]  # 9 grams
    texts = [" ".join(a), " ".join(a[:-1]), " ".join(a[:-2]), " ".join(a[1:-1]), "b c d e", "b c d e f"]
    check_join(spark, list(range(len(texts))), texts)


def test_join_empty_null_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert ngram_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted(ngram_join.jaccard_components(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 2, None), (1, 2, 1), (2, 2, 1), (3, 0, 3)}
    kept = ngram_join.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "None"]


def test_join_links_a_short_row_beside_a_long_one_of_its_id(spark):
    long = " ".join(f"w{i}" for i in range(1_000))
    rows = [(1, "a b c d e f"), (2, long), (2, "a b c d e f"), (2, None), (4, "none like this one at all")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 2, 1), (2, 996, 1), (4, 2, 4)}


def test_keep_first_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 3), (2, "a b c d e f", 4), (3, None, 5), (3, None, 6), (4, "x y z", 7), (4, "other words in this row", 8), (None, "q", 9), (None, "q", 10)]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, `my row` int, row string, __text int")
    kept = ngram_join.keep_first(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.doc_id != 3) == sorted([("1", "a b c d e f"), ("4", "x y z"), ("4", "other words in this row"), ("None", "q"), ("None", "q")])
    assert [r.doc_id for r in got].count(3) == 1


def wider_copies(n, seed=9, length=60):
    """Copies with so many changes that a part of them doesn't link with any one hub."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in range(length)]
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, length, rng.integers(0, 3)):
            w[k] = f"e{rng.integers(0, 4)}"
        cut = rng.integers(0, 9)
        yield " ".join(w[cut : length - rng.integers(0, 9)])


def test_join_finds_links_beside_the_hub(spark, monkeypatch):
    from gradeloom.llm import blocks

    monkeypatch.setattr(blocks, "STAR", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "OFTEN", 3)
    texts = list(wider_copies(150)) + list(wider_copies(60, 3, 30))
    check_join(spark, list(range(len(texts))), texts)
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "ranges", lambda docs: 12)
    check_join(spark, list(range(len(texts))), texts)


def test_a_large_group_is_dealt_out_evenly(spark):
    """A group of near copies is compared in groups of a few dozen, and hardly any of it goes on to pairs of pieces."""
    from gradeloom.llm import blocks
    from gradeloom.llm.ngram_join import block_members, grams_of, hub_bounds

    texts = sorted(set(near_copies(3_000, 5, 120)))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, lone long")
    counts = {r.doc_id: r.n - r.shared for r in ngram_join.shared_counts(df.drop("lone")).collect()}
    sets_ = grams_of(spark.createDataFrame([(i, t, counts[i]) for i, t in enumerate(texts)], df.schema)).cache()
    members = block_members(sets_).cache()
    sizes = [r["n"] for r in blocks.star_rows(members, "doc_id").groupBy("hub", "salt").agg({"*": "count"}).toDF("hub", "salt", "n").collect()]
    assert max(sizes) < 3 * blocks.STAR and sum(sizes) > 2_000
    star = hub_bounds(members, sets_).cache()
    assert blocks.open_pairs(star, "doc_id", ngram_join.BLOCK).count() < 0.2 * len(texts)  # the hub is the text that the others are copies of


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 30)] + [(1, 1), (None, 2), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(5, 30)) and got[201] == 200 and 1 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest_lattice_point_by_search():
    rng = np.random.default_rng(0)
    x = rng.normal(scale=1.5, size=(300, 8))
    got = lattice.nearest_e8(x) / 2
    short = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    short.append(v)
    short += [np.array([1 if k >> b & 1 else -1 for b in range(8)]) / 2 for k in range(256) if bin(k).count("1") % 2 == 0]
    short = np.array(short)
    assert len(short) == 240
    ints = np.isclose(got % 1, 0).all(1)
    halves = np.isclose(got % 1, 0.5).all(1)
    assert (ints | halves).all() and np.isclose(got.sum(1) % 2, 0).all()
    own = ((x - got) ** 2).sum(1)
    other = ((x[:, None] - got[:, None] - short[None]) ** 2).sum(2).min(1)
    assert (own <= other + 1e-9).all()


def brute_vectors(rows):
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))]
    links = {i: 0 for i, _, _ in rows}
    label = {i: i for i, _, _ in rows}
    for a in range(len(good)):
        for b in range(a):
            (i, x, l), (j, y, m) = good[a], good[b]
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = label[i], label[j]
                for k in label:
                    if label[k] in (p, q):
                        label[k] = min(p, q)
    return links, label


def vectors(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        c = rng.normal(size=dim)
        rows += [((c + rng.normal(scale=0.08, size=dim)).tolist(), g % 3) for _ in range(rng.integers(1, 12))]
    rows += [(rng.normal(size=dim).tolist(), int(rng.integers(0, 3))) for _ in range(60)]
    rows += [rows[0]] * 5
    return [(i + 1, v, label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 4])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, [None] + [1.0] * 15, 0), (905, [1.0] * 16, None), (906, [1.0, 0.0], 0), (907, [2.0, 0.0], 0), (908, [-0.0, 1.0], 1), (909, [0.0, 1.0], 1)]
    rows = vectors() + odd
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    links, label = brute_vectors(rows)
    assert len(got) == len(rows)
    assert {i: r.component_id for i, r in got.items()} == label
    assert {i: r.n_links for i, r in got.items()} == links
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_recall_against_brute_force_at_scale(spark):
    """4,000 vectors of a label: groups of near copies just around the threshold, and a large one."""
    rng = np.random.default_rng(3)
    x = []
    for size in [1_500] + [25] * 80:
        centre = rng.normal(size=64)
        x.append(centre + rng.normal(scale=0.1, size=(size, 64)))
    x = np.concatenate([*x, rng.normal(size=(500, 64))])
    rng.shuffle(x)
    df = spark.createDataFrame([(i, v.tolist(), 7) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = lattice.near_duplicates(df).toPandas().sort_values("vec_id")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.98
    np.fill_diagonal(close, False)
    assert close.sum() > 100_000
    assert got.n_links.sum() >= 0.99 * close.sum() and (got.n_links.to_numpy() <= close.sum(1)).all()


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_driver_vectors_equal_brute_force(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    got = lattice.near_duplicates(df).toPandas().sort_values("vec_id")
    table = df.toPandas().sort_values("vec_id")
    want = np.zeros(len(table), dtype=np.int64)
    for label in table.label.dropna().unique():
        own = np.flatnonzero(table.label == label)
        x = np.stack(table.embedding.iloc[own]).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want[own] = (x @ x.T >= 0.98).sum(1) - 1
    assert got.n_links.sum() >= 0.99 * want.sum() and (got.n_links.to_numpy() <= want).all()


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_hubs_of_frequent_keys_and_links_beside_a_hub(spark, monkeypatch, broadcast):
    from gradeloom.llm import blocks

    monkeypatch.setattr(lattice, "OFTEN", 3)
    monkeypatch.setattr(lattice, "HEAVY_KEYS", 40)
    monkeypatch.setattr(lattice, "BLOCK", 5)
    monkeypatch.setattr(lattice, "LEAST_PIECE", 3)
    monkeypatch.setattr(lattice, "PIECE", 7)
    monkeypatch.setattr(lattice, "STRIP", 2)
    monkeypatch.setattr(lattice, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(blocks, "STAR", 4)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(scale=0.16, size=16)).tolist(), 0) for i in range(150)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, label = brute_vectors(rows)
    assert {i: r.component_id for i, r in got.items()} == label and {i: r.n_links for i, r in got.items()} == links


def test_no_vectors(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
