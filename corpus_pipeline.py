"""A corpus pipeline: quality, near duplicates, personal data, mixture, packing.

``run`` applies STAGES to ``documents``; each stage's result is written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``.

Defined cases: null and empty texts are scored, copied, mixed and packed like others (an empty text is the end id alone). Rows with a null doc_id
are no one's copies. Repeated rows count as the operators say: one of equal rows of a doc_id stays. Further columns are kept, whatever their names. Empty
tables give empty results; without usable labels every document has the same score, so all stay or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.mixing import mix_documents
from gradeloom.llm.ngram_join import keep_first
from gradeloom.llm.packing import pack_documents
from gradeloom.llm.pii import redact
from gradeloom.llm.quality import keep_good
from gradeloom.llm.queries import END_ID, _table, _tokenizer
from gradeloom.llm.scratch import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the target weights of domains, languages and sources."""
    return mix_documents(docs, _tokenizer(), END_ID, share=0.9)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return pack_documents(docs, _tokenizer(), END_ID, 4096)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: The first stage is a trained model, which SQL can't express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
