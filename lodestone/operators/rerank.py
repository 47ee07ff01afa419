"""Reranking of fused candidates by a pluggable scorer, with a policy for its failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import RerankConfig
from lodestone.functions import text


def overlap(question: Column, content: Column) -> Column:
    """The offline scorer: the share of the question's distinct code tokens that the content has."""
    q = F.array_distinct(text.code_tokens(question))
    shared = F.size(F.array_intersect(q, text.code_tokens(content))).cast("double")
    return F.struct(F.round(shared / F.greatest(F.size(q), F.lit(1)), 6).alias("score"), F.lit(True).alias("ok"))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = overlap, config: RerankConfig = RerankConfig(), final: int | None = None) -> DataFrame:
    """candidates (query_id, question, chunk_id, content, fused_score, rank, ...) in a new order: scorer gives
    struct(score, ok) of question and content. If any of a query's scores is not ok, all are its fused scores (fail_open),
    else reading the result raises an error. Ties keep their order, then go to the smaller chunk_id."""
    keep = config.final if final is None else final
    if keep < 1:
        raise ValueError("final must be at least 1")
    rows = candidates.where(F.col("rank") <= config.candidates).withColumn("given", scorer(F.col("question"), F.col("content")))
    query = Window.partitionBy("query_id")
    fine = F.min("given.ok").over(query)
    failed = F.col("fused_score") if config.fail_open else F.raise_error(F.lit("the reranker failed")).cast("double")
    rows = rows.withColumn("relevance_score", F.when(fine, F.col("given.score")).otherwise(failed)).withColumnRenamed("rank", "prior_rank")
    rank = F.row_number().over(query.orderBy(F.desc("relevance_score"), "prior_rank", "chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep).drop("given")
