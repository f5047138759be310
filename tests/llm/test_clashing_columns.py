import pytest

CLASHING = ["start", "offset", "mark", "score", "a b", "length", "tokens", "shard_id", "page", "h1", "grp", "pos", "digest", "number", "row", "cell", "form", "n", "half", "x"]


def made(spark, rows=40):
    data = [(None if i % 9 == 0 else i // 2, None if i % 7 == 0 else f"Some words number {i % 11} and the rest. " * (i % 5), "en" if i % 3 else None, "web" if i % 4 else None, i, *["odd"] * len(CLASHING)) for i in range(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def run(name, docs, labels, tokenizer):
    from gradeloom.llm import infill, language, media, merkle, mixing, packing, quality, sharding, token_files

    return {
        "op1": lambda: token_files.token_digests(docs, tokenizer, 2),
        "op2": lambda: packing.pack_documents(docs, tokenizer, 2, 64),
        "op3": lambda: language.identify(docs),
        "op5": lambda: mixing.mix(docs, tokenizer, 2, share=0.8, epochs=3),
        "op7": lambda: media.text_digests(docs),
        "op10": lambda: quality.classify(docs, labels, 0.7),
        "op11": lambda: infill.infill_digests(docs),
        "op12": lambda: sharding.shard_digests(docs),
        "op13": lambda: merkle.proof_digests(docs),
    }[name]()


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op7", "op10", "op11", "op12", "op13"])
def test_results_do_not_depend_on_further_columns(spark, tokenizer, name):
    docs = made(spark)
    labels = spark.createDataFrame([(i, i % 2, "odd") for i in range(1, 12)], "doc_id long, quality int, score string")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    key = {"op2": ["sequence_id", "offset"], "op12": ["shard", "slot"]}.get(name, [])
    rows = lambda df: sorted(repr(tuple(r[c] for c in df.columns if c not in key)) for r in df.collect())
    assert rows(run(name, docs, labels, tokenizer)) == rows(run(name, plain, labels, tokenizer))
