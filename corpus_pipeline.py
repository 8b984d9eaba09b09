"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. Every stage's module says what it does with nulls, empty and very long texts, ties, repeated rows
and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioquery.llm import decontamination, minhash_dedup, secret_scan, sentence_pieces, toxicity
from folioquery.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts."""
    return toxicity.without_toxic(docs, toxicity.model_for(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least doc_id."""
    return minhash_dedup.deduplicated(docs, 80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secret_scan.without_secrets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, the source bytes of each id, and a digest of what they decode to."""
    return sentence_pieces.encode(docs, outputs=("n_tokens", "ids", "starts", "ends", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("sentence_pieces", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
