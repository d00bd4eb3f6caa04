"""The corpus pipeline: five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and
returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents; n_chars follows the text. None of the stages can be
given as SQL as a whole (a trained model decides which rows the others see), so ORACLE_SQL is
None and tests hold the result against a brute-force version.

Defined results of the stages: an empty table gives an empty table; a null or empty text is scored
like an empty one, has no lines, no duplicates and no tokens; a null id is a document of its own that
no other is compared with; a null source is a source of its own; repeated rows are one document of
which one stays; of ties the smallest id stays, and of rows that share it the smallest hash of the
text; very long texts are read whole; columns that a table has beside those of documents are left out
by the second stage, so their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import bpe, line_dedup, minhash, mixing, quality_gam
from spanlake.llm.common import Workspace, table
from spanlake.llm.queries import RANKS

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model rejects go; it learns from the labels outside the held-out fold."""
    return quality_gam.keep_good(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document that had words and has none left goes too."""
    n = "__deleted"
    out = line_dedup.dedup_lines(docs.select(*DOCUMENT), count_col=n)
    out = out.filter((F.col(n) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: the one with the smallest id."""
    return minhash.keep_one(docs.select(*DOCUMENT))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to equal shares by Poisson replication, copies are shuffled globally."""
    return mixing.mix_sources(docs.select(*DOCUMENT))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's number of tokens, its ids and the digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; a stage's inner tables and its input go when its result is written."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = len(Workspace.made)
        after = ws.write(stage(spark, docs, sf_dir), f"stage{k}")
        for inner in Workspace.made[before:]:
            inner.clear()
        if k:
            ws.drop(docs)
        docs = after
    return docs
