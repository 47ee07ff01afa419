"""The queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import byte_bpe, collocations, conversations, licenses, masked_lm, mixing, ngram_join, quality, secrets, substring_dedup, token_counts, topk_search, warc
from lodestone.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated_archive(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_classes(table(spark, sf_dir, "documents"), every_link=False)[0].drop("n_links")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_topk_search": op5_topk_search,
    "op6_secrets": op6_secrets,
    "op7_masked_lm": op7_masked_lm,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_collocations": op11_collocations,
    "op12_licenses": op12_licenses,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": warc.ORACLE, "op3_mixing": mixing.ORACLE, "op5_topk_search": topk_search.ORACLE, "op8_ngram_join": ngram_join.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE, "op11_collocations": collocations.ORACLE, "op12_licenses": licenses.ORACLE, "op13_conversations": conversations.ORACLE}
