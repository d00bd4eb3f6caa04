"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html_extract, language_id, line_dedup, minhash, mixing, pii, quality_gam, quality_rules
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_deleted")
    return out.select("doc_id", "text", "n_deleted")


FOUR_WORDS = minhash.NearDup(words=4)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), FOUR_WORDS)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.clean_lines(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: A real run passes its own secret key.
PII_KEY = "spanlake demonstration key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


RANKS = "byte_bpe_multi_50k.tiktoken"


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), copy_cols=True)
    return out.select("doc_id", "source", "n_chars", "text", F.col("copy").cast("long").alias("copy"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_line_dedup, op3_minhash_near_dedup, op4_quality_classifier, op5_quality_rules, op6_pii, op7_embedding_near_dedup, op8_bpe, op9_mixing, op10_html_extraction)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": minhash.oracle(FOUR_WORDS), "op5_quality_rules": quality_rules.ORACLE, "op7_embedding_near_dedup": embedding_dedup.oracle(), "op9_mixing": mixing.copies_oracle("doc_id, source, n_chars, text, copy")}
