"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, embedding_dedup, exact_dedup, importance_sampling, minhash_dedup, secret_scan, sentence_pieces, spelling_variants, substring_dedup, token_shards, toxicity, url_filter

MODULES = (embedding_dedup, toxicity, chat_format, decontamination, substring_dedup, sentence_pieces, secret_scan, token_shards, minhash_dedup, url_filter, spelling_variants, importance_sampling, exact_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
