"""Weighted reciprocal rank fusion of two ranked lists, and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import HybridConfig
from lodestone.operators import lexical, vectors


def fuse(semantic: DataFrame, words: DataFrame, config: HybridConfig = HybridConfig(), top_k: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, fused_score, vector_rank, bm25_rank, rank) of two lists (query_id, chunk_id, rank). A chunk that
    a list has twice counts with its first rank; one shuffle of both lists, no outer join."""
    k = top_k or config.top_k
    if k < 1:
        raise ValueError("top_k must be at least 1")
    leg = lambda df, name, other: df.select("query_id", "chunk_id", F.col("rank").alias(name), F.lit(None).cast("int").alias(other))
    both = leg(semantic, "vector_rank", "bm25_rank").unionByName(leg(words, "bm25_rank", "vector_rank"))
    by = both.groupBy("query_id", "chunk_id").agg(F.min("vector_rank").alias("vector_rank"), F.min("bm25_rank").alias("bm25_rank"))
    part = lambda name, weight: F.coalesce(F.lit(weight) / (F.lit(float(config.rrf_k)) + F.col(name)), F.lit(0.0))
    score = lexical.rounded(part("vector_rank", config.vector_weight) + part("bm25_rank", config.lexical_weight), digits)
    return lexical.ranked(by.withColumn("score", score), "query_id", k).withColumnRenamed("score", "fused_score")


def retrieve(points: DataFrame, index: lexical.LexicalIndex, queries: DataFrame, config: HybridConfig = HybridConfig(), top_k: int | None = None, threshold: float | None = None, filters: dict[str, object] | None = None, digits: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Hybrid retrieval for queries (query_id, repository_id, text, vector): both legs in one plan. The threshold holds for
    the vector leg only. digits: to which the legs' scores, and the fused ones, are rounded before they are ranked."""
    semantic = vectors.search(points, queries, config.pool, threshold, filters, digits[0])
    words = lexical.search(index, queries, config.pool, filters, digits=digits[0])
    return fuse(semantic, words, config, top_k, digits[1])
