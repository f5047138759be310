import numpy as np

import corpus_pipeline
from gradeloom.llm import mixing


def water(budget, weights, limits):
    """Shares by weight up to limits, what is left again by weight."""
    share, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0]
    while open_ and budget > 1e-9:
        level = budget / sum(weights[i] for i in open_)
        full = [i for i in open_ if limits[i] - share[i] <= level * weights[i] + 1e-12]
        if not full:
            for i in open_:
                share[i] += level * weights[i]
            break
        for i in full:
            budget -= limits[i] - share[i]
            share[i] = limits[i]
            open_.remove(i)
    return share


def brute_budgets(tokens, weights, share, epochs):
    total = sum(tokens.values()) * share
    out = {}

    def walk(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            out[prefix] = budget
            return
        names = sorted({k[depth] for k in tokens if k[:depth] == prefix})
        w = [weights.get(mixing.LEVELS[depth], {}).get(n, 1.0) for n in names]
        limit = [epochs * sum(v for k, v in tokens.items() if k[: depth + 1] == (*prefix, n)) for n in names]
        for n, s in zip(names, water(budget, w, limit)):
            walk((*prefix, n), s)

    walk((), total)
    return out


def test_budgets_against_water_filling(spark):
    rng = np.random.default_rng(0)
    tokens = {(f"d{d}", lang, f"s{s}"): int(rng.integers(1, 5000)) for d in range(3) for lang in ("en", "de", "") for s in range(4) if rng.random() < 0.8}
    rows = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "leaf_domain string, leaf_lang string, leaf_source string, tokens long")
    weights = {"domain": {"d0": 5.0, "d1": 1.0}, "lang": {"en": 3.0, "": 0.0}, "source": {"s1": 2.5}}
    for share, epochs in ((0.3, 1), (0.9, 1), (1.5, 3), (5.0, 2)):
        got = {(r.leaf_domain, r.leaf_lang, r.leaf_source): r.budget for r in mixing.leaf_budgets(rows, weights, share, epochs).collect()}
        want = brute_budgets(tokens, weights, share, epochs)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1.001 for k in want)


def corpus(spark, n=400):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(rng.integers(1, 60)), ["en", "de", None][i % 3], None if i % 29 == 0 else f"src{i % 6 if i % 2 else 0}", 1) for i in range(n)]
    rows += [(7, rows[7][1], *rows[7][2:]), (None, "null id", "en", "src1", 1), (900, None, "en", "src2", 1), (901, "x " * 20_000, "en", "src3", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")


def test_mix_takes_each_leafs_budget_as_a_prefix(spark, tokenizer):
    docs = corpus(spark)
    got = mixing.mix(docs, tokenizer, 2, share=0.8, epochs=3).toPandas()
    tokens = mixing.count_tokens(docs, tokenizer, 2)
    budgets = {tuple(getattr(r, f"leaf_{k}") for k in mixing.LEVELS): r.budget for r in mixing.leaf_budgets(tokens, mixing.WEIGHTS, 0.8, 3).collect()}
    taken = got.groupby(["domain", "lang", "source"])["take"].sum().to_dict()
    assert taken == {k: v for k, v in budgets.items() if v > 0}
    assert ((got["take"] > 0) & (got["take"] <= got.tokens)).all()
    assert got[got["take"] < got.tokens].groupby(["domain", "lang", "source"]).size().max() <= 1
    again = mixing.mix(docs, tokenizer, 2, share=0.8, epochs=3).toPandas()
    key = ["doc_id", "domain", "lang", "source", "epoch", "take"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_mix_documents_keeps_columns(spark, tokenizer):
    docs = corpus(spark)
    kept = mixing.mix_documents(docs, tokenizer, 2, share=0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert mixing.mix_documents(docs.limit(0), tokenizer, 2).count() == 0
    assert mixing.mix_documents(docs, tokenizer, 2, {}, share=1.0).count() == docs.count()


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3] > counts[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(corpus_pipeline.run(spark, sf)) == key(pieces)


def plain_mixture(rows, tokens, turns, share):
    """Whole documents in the order of their turns, up to and with the one that uses a leaf's budget up."""
    leaf = {k: (r.leaf_domain, r.leaf_lang, r.leaf_source) for k, r in tokens.items()}
    total = {}
    for k, r in tokens.items():
        total[leaf[k]] = total.get(leaf[k], 0) + r.tokens
    budgets = brute_budgets(total, mixing.WEIGHTS, share, 1)
    kept = set()
    for name, budget in budgets.items():
        left = int(budget + 1e-6)
        for k in sorted((k for k in leaf if leaf[k] == name), key=lambda k: turns[k]):
            if left <= 0:
                break
            kept.add(k)
            left -= tokens[k].tokens
    return kept


def test_each_stage_against_a_plain_version(spark, tokenizer):
    """Every stage of the pipeline, on all of a small table, by plain Python on the rows that it was given."""
    import re
    import zlib

    from gradeloom.llm import pii, quality
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from test_pairs import brute

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    def run(k, before):
        out = corpus_pipeline.materialise(corpus_pipeline.STAGES[k][1](spark, before, sf), "plain")
        return out, {r.doc_id: r for r in out.collect()}

    model = quality.train(docs, labels.where(~quality.held_out()))
    scores = dict(zip(rows, quality.score_texts([r.text for r in rows.values()], model)))
    docs, got = run(0, docs)
    assert got == {i: r for i, r in rows.items() if scores[i] >= 0.7}
    rows = got

    least = brute(list(rows), [r.text for r in rows.values()])
    docs, got = run(1, docs)
    assert got == {i: r for i, r in rows.items() if least[i][1] == i}
    rows = got

    spans = {r.doc_id: r.spans for r in pii.span_digests(docs).collect()}
    docs, got = run(2, docs)
    for i, r in rows.items():
        out, at = [], 0
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans[i].split(",") if s)), key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2])):
            if a >= at:
                out += [(r.text or "")[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        clean = None if r.text is None else "".join(out) + r.text[at:]
        assert got[i].text == clean and (got[i].lang, got[i].source) == (r.lang, r.source)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", clean or "")
    rows = got

    counted = mixing.count_tokens(docs, tokenizer, 2).withColumn("turn", mixing.turn(F.lit(0)))
    tokens = {r.doc_id: r for r in counted.collect()}
    want = plain_mixture(rows, tokens, {i: r.turn for i, r in tokens.items()}, 0.9)
    docs, got = run(3, docs)
    assert got == {i: r for i, r in rows.items() if i in want}
    rows = got

    encode = Tokenizer.from_file(tokenizer).encode
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    for i, r in rows.items():
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tokens[i].tokens == len(ids)
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            own = np.array(ids[at : at + p.length], dtype="<u4")
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(own.tobytes())
            at += p.length
        assert at == len(ids)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 4096 and sorted(ends) == list(range(len(ends)))


def test_pipeline_survives_odd_rows(spark, odd_texts, tmp_path):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None) for i, t in enumerate(odd_texts)] + [(None, "null id row", "en", "src1", 3)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1), (6, 1), (2, 0), (16, 0)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r.doc_id for r in got.collect()} <= {r[0] for r in rows}


def test_every_operator_has_a_query():
    from gradeloom.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
