import re

import numpy as np
import pytest

from gradeloom.llm import language, quality


def frame(spark, rows, schema="doc_id long, text string, lang string, lang_pred string"):
    return spark.createDataFrame(rows, schema)


EN = "the quick brown fox jumps over the lazy dog and then the cat sat on the mat with this and that".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann lag die katze auf der matte mit".split()


def corpus(n=80):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(EN if i % 2 else DE, 12)), "en" if i % 2 else "de", "zz") for i in range(n)]


def blanked(text):
    return b" " + re.sub(rb"^ ", b"", re.sub(rb"[^a-zA-Z\x80-\xff]+", b" ", text.encode())).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def plain_ppm(train, order):
    """Counts by context, and a byte's probability by escapes with exclusion, each by its definition."""
    counts = {}
    for text in train:
        data = b" " * order + blanked(text)
        for i in range(order, len(data)):
            for k in range(order + 1):
                own = counts.setdefault(data[i - k : i], {})
                own[data[i]] = own.get(data[i], 0) + 1

    def p(context, byte):
        shorter = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        own = counts.get(context)
        if not own:
            return shorter(byte)
        n, d = sum(own.values()), len(own)
        if d == 256:
            return own[byte] / n
        if byte in own:
            return own[byte] / (n + d)
        return d / (n + d) * shorter(byte) / (1 - sum(shorter(b) for b in own))

    return p


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_code_lengths_against_plain_ppm(order):
    train = ["the cat sat on the mat", "é ü ß, Über 12 the END", "abracadabra", ""]
    p = plain_ppm(train, order)
    model = {"key": f"plain-{order}", "langs": ["x"], "trees": [language.count_grams(train, order)], "order": order}
    for text in ["the cat", "Zebra über 99 é!", "", "q", "abab 12,, abra", "cat ñandú \u4e2d"]:
        data = b" " * order + blanked(text)
        want = sum(-np.log2(p(data[i - order : i], data[i])) for i in range(order, len(data)))
        assert np.isclose(language.text_code_lengths([text], model)[0, 0], want, rtol=1e-9), text
    both = language.text_code_lengths(["the cat", "", "abra", "über"], model)
    assert np.allclose(both[:, 0], [language.text_code_lengths([t], model)[0, 0] for t in ["the cat", "", "abra", "über"]])


def test_probabilities_of_a_context_sum_to_one():
    tree = language.plant(*language.count_grams(["the cat sat on the mat", "é ü ß"]))
    for context in (b"    ", b"  th", b"the ", b"qqqq", b"zzth"):
        grams = (int.from_bytes(context, "big") << 8) + np.arange(256, dtype=np.uint64)
        assert np.isclose(language.probability(tree, grams, 4).sum(), 1)


def test_grams_beyond_the_table_are_worked_out_again(monkeypatch):
    model = {"key": "small", "langs": ["x"], "trees": [language.count_grams(["the cat sat"])], "order": 4}
    texts = ["one two three", "four five six", "the cat", "seven eight"]
    want = language.text_code_lengths(texts, model)
    monkeypatch.setattr(language, "KEPT_GRAMS", 5)
    assert np.allclose([language.text_code_lengths([t], model)[0] for t in texts * 2], np.concatenate([want, want]))


def test_places_go_to_languages_with_texts_enough(monkeypatch):
    got = language.places({"en": 10**9, "de": 10**6} | {f"x{i}": 1 for i in range(100)})
    assert got["en"] == got["de"] == language.TRAIN_DOCS and got["x3"] == 1
    assert sum(language.places({f"x{i}": 10**6 for i in range(9)}).values()) <= language.TRAIN_TOTAL


def test_eight_languages_have_the_same_order(spark):
    rng = np.random.default_rng(4)
    syllables = [["".join(rng.choice(list("bdfgklmnprstvz"))) + str(rng.choice(list("aeiou"))) for _ in range(14)] for _ in range(8)]
    word = lambda s: "".join(rng.choice(s, rng.integers(2, 4)))
    rows = [(i, " ".join(word(syllables[i % 8]) for _ in range(40)), f"l{i % 8}", "") for i in range(400)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in language.identify(df).collect()}
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].lang_pred == f"l{i % 8}" for i in held]) > 0.97
    model = language.train(df)
    assert model["order"] == language.ORDER == language.train(df.where("lang < 'l3'"))["order"] and len(model["langs"]) == 8


def test_languages_are_told_apart_and_odd_texts_have_results(spark):
    rows = corpus() + [(1000, None, "en", ""), (1001, "", None, ""), (1002, "12 34 !!", "en", ""), (1003, "x" * 30_000, None, ""), (1004, "über " * 9_000, None, ""), (None, "the cat", "en", "")]
    got = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    right = [got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80)]
    assert np.mean(right) == 1.0
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1004].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)


def test_no_training_rows(spark):
    rows = [(1, "the cat", None, ""), (2, None, None, "")]
    assert {r.lang_pred for r in language.identify(frame(spark, rows)).collect()} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0


def test_languages_of_long_texts_alone_are_learnt(spark):
    rng = np.random.default_rng(2)
    book = lambda words: ". ".join(" ".join(rng.choice(words, 12)) for _ in range(900))
    rows = [(i, book(EN) if i % 2 else corpus(2)[0][1], "en" if i % 2 else "de", "") for i in range(24)]
    assert min(len(t) for i, t, *_ in rows if i % 2) > language.TRAIN_BYTES
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in language.identify(frame(spark, rows)).collect())
    model = language.train(frame(spark, [r for r in rows if r[0] % 2]))
    assert model["langs"] == ["en"]


def test_excerpts_come_from_all_over_the_text():
    text = "\n".join(f"sentence {i} über" for i in range(5_000))
    got = language.excerpt(text)
    at = [int(s.split()[1]) for s in got.split("\n")]
    assert 0.9 * language.TRAIN_BYTES < len(got.encode()) <= language.TRAIN_BYTES and set(got.split("\n")) <= set(text.split("\n"))
    assert at == sorted(at) and np.histogram(at, 10, (0, 5_000))[0].min() > 50
    whole = language.excerpt("".join(chr(0x4E00 + i % 4_999) for i in range(50_000)))
    assert 0.9 * language.TRAIN_BYTES < len(whole.encode()) <= language.TRAIN_BYTES
    assert language.excerpt("short. text") == "short. text"


def test_copies_take_one_place_in_the_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [t for _, t, lang, _ in corpus(120) if lang == "en"]
    first = frame(spark, [(0, t, "en", "") for t in texts]).where("pmod(xxhash64(text), 1048576) < 100000").orderBy(F.xxhash64("text")).first().text
    seen = []
    monkeypatch.setattr(language, "TRAIN_DOCS", 10)
    monkeypatch.setattr(language, "count_grams", lambda t, order, count=language.count_grams: seen.append(len(t)) or count(t, order))
    language.train(frame(spark, [(0, t, "en", "") for t in texts + [first] * 90]))
    assert seen == [10]


def test_driver_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def brute_statistics(text):
    """All twenty numbers from their definitions, one text at a time."""
    from collections import Counter

    t = text or ""
    raw = t.encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", low) if w]
    lines = [tuple(w for w in re.split(rb"[\x20\x09-\x0D]+", x) if w) for x in low.split(b"\n") if x]
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    other, n, size = sum(c >= 128 for c in raw), len(words), len(raw)
    letters = upper + lower + other / 2
    share = lambda a, b: a / b if b else 0.0
    count = lambda chars: sum(c in chars for c in raw)
    marks = b"#$%&*@=+<>[]{}\\^_`~/"
    sizes = [len(w) for w in words]
    kinds, line_kinds = Counter(words), Counter(lines)
    return [
        np.log1p(size), np.log1p(n), share(upper, letters), share(count(b"0123456789"), size), share(count(b".,;:'\"()-?"), size),
        np.log1p(1000 * share(count(marks), size)), np.log1p(1000 * share(count(b"|"), size)), np.log1p(1000 * share(count(b"!"), size)),
        share(count(b"\x09\x0b\x0c\x0d\x20"), size), np.log1p(1000 * share(count(b"\n"), size)), share(other, size),
        np.mean(sizes) if n else 0.0, np.std(sizes) if n else 0.0, share(len(kinds), n), np.log1p(len(kinds)) - np.log1p(n), share(max(kinds.values(), default=0), n),
        share(len(line_kinds), len(lines)), share(max(line_kinds.values(), default=0), len(lines)), share(sum(any(c in marks + b"|!" for c in w) for w in words), n), np.log1p(share(n, len(lines))),
    ]


def test_statistics_against_definitions(odd_texts):
    texts = ["the cat the cat sat", None, "", "a | b !! c", "one\ntwo\none\n", "UPPER lower 123", "#a b$ (c) d_e\n\nf\tg", "same line\nsame line\nother", *odd_texts]
    x = quality.statistics(texts)
    assert x.shape == (len(texts), quality.STATISTICS) and np.isfinite(x).all()
    for row, t in zip(x, texts):
        want = brute_statistics(t)
        assert np.allclose(row, want, atol=1e-6), (t and t[:40], [(i, a, b) for i, (a, b) in enumerate(zip(row, want)) if not np.isclose(a, b, atol=1e-6)])


def test_inner_products_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, quality.STATISTICS))
    f = quality.fourier(x, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * quality.STATISTICS))
    assert abs(f @ f.T - kernel).mean() < 0.05


def test_normal_equations_are_sums_over_partitions(spark):
    rng = np.random.default_rng(1)
    x, y, half = rng.normal(size=(90, quality.STATISTICS)), rng.integers(0, 2, 90), rng.integers(0, 2, 90)
    rows = spark.createDataFrame([(a.tolist(), float(b), int(h)) for a, b, h in zip(x, y, half)], "x array<double>, y double, half int").repartition(5)
    mean, scale = x.mean(0), x.std(0)
    got = quality.normal_equations(rows, mean, scale)
    for h in (0, 1):
        f = quality.fourier(x[half == h], mean, scale)
        assert np.allclose(got[h][0], f.T @ f) and np.allclose(got[h][1], f.T @ y[half == h])
        penalty = np.diag([*[quality.RIDGE * max(1.0, len(f))] * (f.shape[1] - 1), 1e-9])
        assert np.allclose(quality.solve(*got[h]), np.linalg.lstsq(f.T @ f + penalty, f.T @ y[half == h], rcond=None)[0], atol=1e-6)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["alpha beta", "gamma gamma delta", "", "x " * 500]
    alone = np.concatenate([quality.statistics([t]) for t in texts])
    assert np.allclose(quality.statistics(texts), alone)


def test_isotonic_is_least_squares():
    """At each raw score: the largest, over starts, of the smallest, over ends, mean of the labels between them."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 60, 200):
        raw = rng.normal(size=n).round(1)
        y = (raw + rng.normal(size=n) > 0).astype(float)
        xs, ys = quality.isotonic(raw, y)
        values = np.unique(raw)
        best = [max(min(y[(raw >= a) & (raw <= b)].mean() for b in values[values >= v]) for a in values[values <= v]) for v in values]
        for v, want in zip(values, best):
            k = np.flatnonzero((xs[0::2] <= v) & (v <= xs[1::2]))[0]
            inside = (raw >= xs[2 * k]) & (raw <= xs[2 * k + 1])
            assert np.isclose(y[inside].mean(), want) and np.isclose(ys[2 * k], (y[inside].sum() + 0.5) / (inside.sum() + 1)) or ys[2 * k] > (y[inside].sum() + 0.5) / (inside.sum() + 1)
        assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all() and ((0 <= ys) & (ys <= 1)).all()


def test_quality_on_driver_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert len(got) == 1000 and ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (None, 0)]])
def test_quality_without_usable_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a text", 5), (2, None, 5), (2, "", 5), (None, "b", 5)], "doc_id long, text string, score int")
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {5}


def test_repeated_ids_are_one_training_row(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    docs = spark.range(100_000).selectExpr("id % 3 AS doc_id", "concat('text number ', id % 50, ' of many') AS text")
    rows = quality._training_rows(docs, labels).collect()
    assert sorted(r.y for r in rows) == [0.0, 1.0] and all(len(r.x) == quality.STATISTICS for r in rows)
    assert quality.train(docs, labels).keys() >= {"beta"}


def test_a_repeated_line_is_coded_each_time():
    model = {"key": "two", "langs": ["a", "b"], "trees": [language.count_grams(["the cat and the dog"], 2), language.count_grams(["die Katze und der Hund"], 2)], "order": 2}
    one, five = language.text_code_lengths(["the cat. "], model), language.text_code_lengths(["the cat. " * 5], model)
    assert (five > 4 * one).all() and one.argmin() == 0
