"""The corpus pipeline: operators of lodestone.llm applied to `documents`, each stage to what the last one kept.

Rows are numbered when a stage begins, so rows with null or repeated ids, and rows that are equal in all columns, get
verdicts of their own. Stages that drop or change rows join their verdicts on that number. Columns
beyond those of `documents` are kept by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, mixing, ngram_join, quality, secrets
from lodestone.llm.common import table, written

KEY = "pipeline_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a number for each row. A table read from Parquet files as it is has them by file and place in the file, which
    no later read changes, and is not copied; others are written, as their numbers are those of one run of the tasks."""
    if not docs._jdf.queryExecution().analyzed().children().isEmpty() or not docs.inputFiles():
        return written(docs.withColumn(KEY, F.monotonically_increasing_id()), "pipeline-rows")
    at = docs.select(*docs.columns, F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    files = written(at.select("file_").distinct().coalesce(1).withColumn("file_no_", F.monotonically_increasing_id()), "pipeline-files")
    return at.join(F.broadcast(files), "file_").select(*docs.columns, (F.col("file_no_") * 2**40 + F.col("row_")).alias(KEY))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    rows = _keyed(docs)
    rejected = quality.quality_rules(rows, id=KEY).where(~F.col("kept")).select(F.col("doc_id").alias(KEY))
    return rows.join(rejected, KEY, "left_anti").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    rows = _keyed(docs)
    members = ngram_join.near_duplicate_classes(rows, id=KEY, every_link=False)[0]
    by = members.select(F.col("doc_id").alias(KEY), F.col("component_id").alias("component")).join(rows.select(KEY, "doc_id"), KEY)
    stays = by.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("x")).select(f"x.{KEY}")
    return rows.join(stays, KEY, "left_semi").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars that of the new text."""
    rows = _keyed(docs)
    clean = secrets.masked(rows, written(secrets.scan(rows, id=KEY).where("is_secret"), "pipeline-secrets"), id=KEY)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = _keyed(docs)
    copies = mixing.mix(rows, id=KEY, rank_by="doc_id").where("copies > 0").select(F.col("doc_id").alias(KEY), "copies")
    taken = rows.join(copies, KEY).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids): the byte-level BPE ids of each text, checked to decode to it, as uint32."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: Robust estimates, the forest and the recursion over merges are beyond one SQL statement; tests/llm/ checks the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-stage{k}")
    return docs
