"""Repository files and evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import IngestConfig
from lodestone.functions import paths, text


def read_tree(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """(repository_id, path, content binary, size_bytes) of all files below root; path relative to it. Spark's
    binary reader leaves out empty files; `trees.read_repositories` gives them too, where the file system is mounted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return files.select(F.lit(repository_id).alias("repository_id"), F.element_at(F.split("path", F.lit("\\Q" + base + "\\E"), 2), -1).alias("path"), "content", F.col("length").alias("size_bytes"))


def included(files: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """The files that are read, by path, language, size and absence of NUL bytes, decoded; with language and line_count."""
    rows = files.where(~paths.ignored_path(F.col("path"))).withColumn("language", paths.language(F.col("path"))).where("language IS NOT NULL")
    rows = rows.where((F.col("size_bytes") <= config.max_file_bytes) & (F.position(F.lit(b"\x00"), F.col("content")) == 0))
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.withColumn("content", decoded).withColumn("line_count", text.line_count(F.col("content"))).select("repository_id", "path", "language", "content", "size_bytes", "line_count")


def guarded(files: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """A summary row a repository; reading it raises an error for one with too many files or bytes."""
    rows = summary(files)
    over = (F.col("file_count") > config.max_files) | (F.col("total_size_bytes") > config.max_repository_bytes)
    return rows.withColumn("repository_id", F.when(over, F.raise_error(F.concat(F.lit("repository exceeds its limits: "), F.col("repository_id")))).otherwise(F.col("repository_id")))


def summary(files: DataFrame) -> DataFrame:
    return files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_size_bytes"), F.sort_array(F.collect_set("language")).alias("languages"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array; cases without symbols have an empty list."""
    schema = "case_id string, question string, expected_file_paths array<string>, expected_symbols array<string>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    return rows.withColumn("expected_symbols", F.coalesce("expected_symbols", F.array().cast("array<string>")))
