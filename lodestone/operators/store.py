"""Index tables: upsert, replacement by repository, deletion, status and inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.operators.vectors import criteria

LIMIT = 200


def points(embedded: DataFrame) -> DataFrame:
    """Embedded chunks with point_id and content_hash."""
    return embedded.withColumn("point_id", text.point_id(F.col("chunk_id"))).withColumn("content_hash", text.content_hash(F.col("content")))


def checked(rows: DataFrame) -> DataFrame:
    """Rows whose vectors all have one length; reading others raises an error."""
    size = rows.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if size.low != size.high or size.low == 0:
        raise ValueError("vectors must have one length, at least 1")
    return rows


def upsert(stored: DataFrame, new: DataFrame, key: str = "point_id", order: str = "version") -> DataFrame:
    """stored and new rows by key, the one with the highest order winning."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return stored.unionByName(new).withColumn("n", last).where("n = 1").drop("n")


def replace_repository(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored without the repositories that `new` has rows of, and new."""
    return stored.join(new.select("repository_id").distinct(), "repository_id", "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def write_repository(rows: DataFrame, path: str, repository_id: str | None = None) -> None:
    """Replaces the partitions of the repositories that rows have, and no others, in a table of Parquet files. With a
    repository_id its partition goes first, so that rows without any leave none behind."""
    if repository_id is not None:
        drop_repository(rows.sparkSession, path, repository_id)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(path)


# Characters that stand as % and their code in the names of partition folders.
ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^") | frozenset(map(chr, range(1, 32)))


def partition_name(repository_id: str) -> str:
    """The folder name of a repository's partition, as the writer of partitioned tables makes it; no id names another folder."""
    if not repository_id or "\0" in repository_id:
        raise ValueError("a repository needs an id")
    return "repository_id=" + "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in repository_id)


def drop_repository(spark: SparkSession, path: str, repository_id: str) -> bool:
    """Deletes a repository's partition of a stored table, through Spark's file systems; whether there was one."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(table, spark._jvm.org.apache.hadoop.fs.Path(None, None, partition_name(repository_id)))
    if not place.getParent().equals(table):
        raise ValueError(f"not a partition of {path}: {repository_id!r}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete_repository(stored: DataFrame, repository_id: str) -> DataFrame:
    return stored.where(F.col("repository_id") != repository_id)


def status(stored: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repository_id, indexed_chunk_count) of the repositories named, 0 for those without rows."""
    counts = stored.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))
    return repositories.join(counts, "repository_id", "left").select("repository_id", F.coalesce("n", F.lit(0).cast("long")).alias("indexed_chunk_count"))


def list_chunks(stored: DataFrame, repository_id: str, filters: dict[str, object] | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Chunks of a repository by file, line and id: of the first `limit` by point id, or all with limit None."""
    rows = stored.where((F.col("repository_id") == repository_id) & criteria(filters, stored.columns))
    if limit is not None:
        rows = rows.orderBy("point_id").limit(max(limit, 0))
    return rows.orderBy("file_path", "start_line", "chunk_id")


def list_files(stored: DataFrame, repository_id: str, limit: int | None = LIMIT) -> DataFrame:
    """(file_path, language, chunk_count); with a limit, of the chunks that list_chunks gives."""
    return list_chunks(stored, repository_id, None, limit).groupBy("file_path", "language").agg(F.count(F.lit(1)).alias("chunk_count")).orderBy("file_path", "language")


def get_file(stored: DataFrame, repository_id: str, path: str) -> DataFrame:
    spark: SparkSession = stored.sparkSession
    normal = spark.range(1).select(paths.indexed_path(F.lit(path)).alias("p")).first().p
    if normal is None:
        raise ValueError(f"not a path within a repository: {path!r}")
    return list_chunks(stored, repository_id, {"file_path": normal})


def get_symbol(stored: DataFrame, repository_id: str, name: str) -> DataFrame:
    return list_chunks(stored, repository_id, {"symbol_name": name})
