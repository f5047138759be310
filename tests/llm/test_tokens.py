import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.llm import packing
from gradeloom.llm.packing import pack_documents, pack_histogram, placement
from gradeloom.llm.scratch import scratch_path
from gradeloom.llm.token_files import read_tokens, token_digests, write_tokens
from gradeloom.llm.wordbpe import Encoder


def plain(tokenizer, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_tokenizer(tokenizer, odd_texts):
    e = Encoder(tokenizer, cache_words=5)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(odd_texts)] == plain(tokenizer, odd_texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_on_any_text(texts):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    if not hasattr(test_encoder_on_any_text, "e"):
        test_encoder_on_any_text.e = Encoder(path)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in test_encoder_on_any_text.e.encode(texts)] == plain(path, texts)


def docs(spark, texts, ids=None):
    rows = list(zip(ids or range(10, 10 + len(texts)), texts, ["x"] * len(texts)))
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_token_files_round_trip(spark, tokenizer, odd_texts):
    got = token_digests(docs(spark, odd_texts), tokenizer, 2, shards=3).orderBy("doc_id").collect()
    run = 0
    for row, ids, k in zip(got, plain(tokenizer, odd_texts), range(len(odd_texts))):
        ids = ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (10 + k, run, len(ids), crc(ids))
        run += len(ids)


def test_files_are_sorted_coded_and_indexed(spark, tokenizer):
    texts = [f"word{i} and some more words {i % 7}" for i in range(500)]
    path = scratch_path(spark, "t")
    write_tokens(docs(spark, texts, list(range(500, 0, -1))), path, tokenizer, 2, shards=2, page_rows=50)
    import glob

    files = sorted(glob.glob(path.removeprefix("file://") + "/*.parquet"))
    for f in files:
        m = pq.ParquetFile(f).metadata
        by_name = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i) for i in range(m.num_columns)}
        assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings and "RLE_DICTIONARY" not in by_name["doc_id"].encodings
        assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings
        assert by_name["doc_id"].has_column_index and by_name["doc_id"].has_offset_index
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids)
    plan = read_tokens(spark, path).where("doc_id = 7").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,7)" in plan


def test_empty_table_null_and_repeated_ids(spark, tokenizer):
    assert token_digests(docs(spark, []), tokenizer, 2).count() == 0
    assert pack_documents(docs(spark, []), tokenizer, 2).count() == 0
    got = token_digests(docs(spark, ["b", "a", None], [1, 1, None]), tokenizer, 2, shards=2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1] and [r.start for r in got] == [0, 1, 3]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_histogram_packing_uses_every_piece_once(counts):
    patterns = pack_histogram(counts, 64)
    used = {}
    for pattern, n in patterns:
        assert n > 0 and sum(k * v for k, v in pattern.items()) <= 64
        for k, v in pattern.items():
            used[k] = used.get(k, 0) + v * n
    assert used == counts
    places = placement(patterns, 64)
    assert len(places["size"]) == sum(len(p) for p, _ in patterns)


def test_packing_is_whole_gapless_and_tight(spark, tokenizer, odd_texts):
    texts = [*odd_texts, *(f"some text number {i} " * (i % 40) for i in range(300))]
    got = pack_documents(docs(spark, texts), tokenizer, 2, 256).toPandas()
    want = [x + [2] for x in plain(tokenizer, texts)]
    for k, ids in enumerate(want):
        own = got[got.doc_id == 10 + k].sort_values("start")
        assert (own.doc_tokens == len(ids)).all()
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum().to_numpy()[:-1]])).all() and s.length.sum() <= 256
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.max() + 1))
    assert got.length.sum() / (256 * got.sequence_id.nunique()) > 0.97


def test_one_length_for_a_third_of_all_rows(spark, tokenizer):
    texts = ["same text here"] * 400 + [f"t {i}" * (i % 9) for i in range(400)]
    got = pack_documents(docs(spark, texts), tokenizer, 2, 64).toPandas()
    assert len(got) == got[["doc_id", "start"]].drop_duplicates().shape[0] >= 800


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_take_whole_texts(name, odd_texts):
    import public_tokenizers

    path = public_tokenizers.path(name)
    e = Encoder(path)
    assert not e.by_words
    texts = [t for t in odd_texts if t is None or len(t) < 1000]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == plain(path, texts)


def test_equal_rows_and_rows_without_id_are_spread_over_buckets(spark, tokenizer):
    docs = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same words' END AS text")
    pieces = packing.cut_pieces(docs, tokenizer, 2, 64).withColumn("__tie", F.monotonically_increasing_id())
    sizes = pieces.groupBy("length", packing.bucket(F.lit(-(-50_000 // packing.RANKED))).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * packing.RANKED
    got = pack_documents(docs, tokenizer, 2, 64)
    assert got.count() == 100_000 and got.select("sequence_id", "offset").distinct().count() == 100_000
