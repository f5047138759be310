"""The operators applied to their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


END_ID = 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), _tokenizer(), END_ID)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer(), END_ID, 4096)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _tokenizer(), END_ID, share=0.8, epochs=3)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import RULES, apply_rules

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return apply_rules(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_digests

    return text_digests(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import span_digests

    return span_digests(_table(spark, sf_dir, "documents"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), 0.7)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill_digests

    return infill_digests(_table(spark, sf_dir, "documents"), 42)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_digests

    return shard_digests(_table(spark, sf_dir, "documents"), 16)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import proof_digests

    return proof_digests(_table(spark, sf_dir, "documents"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    from .pii import base_digests

    return base_digests(_table(spark, sf_dir, "documents"))


#: Name to query, in the order of the operators' numbers.
QUERIES = [op1_token_files, op2_packing, op3_language, op4_ngram_join, op5_mixing, op6_url_rules, op7_tiff, op8_pii, op9_lattice, op10_quality, op11_infill, op12_sharding, op13_merkle]


def queries() -> dict:
    return {f.__name__: f for f in [*QUERIES, pii_base_spans]}


def oracle_sql() -> dict[str, str]:
    from . import infill, lattice, merkle, ngram_join, pii, url_rules

    found = {"pii_base_spans": pii.BASE_SQL, "op4_ngram_join": ngram_join.ORACLE_SQL, "op6_url_rules": url_rules.ORACLE_SQL, "op9_lattice": lattice.ORACLE_SQL}
    return found | {"op11_infill": infill.ORACLE_SQL, "op13_merkle": merkle.ORACLE_SQL}
