"""The registry of repositories and the decision what to index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# States, and how far each stage is.
PROGRESS = {"queued": 0, "ingesting": 15, "indexing": 45, "completed": 100}


def signatures(files: DataFrame) -> DataFrame:
    """(repository_id, content_signature): a digest of each repository's paths and contents, in order of path. Contents go
    in as digests of their own, so that only these are sorted."""
    return _folded(files.select("repository_id", "path", F.sha2("content", 256).alias("content")), b"\x1f")


def exact_signatures(files: DataFrame) -> DataFrame:
    """As signatures, over the contents themselves, each path and content followed by a zero character."""
    return _folded(files.select("repository_id", "path", F.col("content").cast("string").alias("content")), b"\0")


#: Lengths of the prefixes, in hexadecimal digits, by which digests meet: sixteen million ranges, 4,096, and one.
PREFIXES = (6, 3, 0)


def merkle_signatures(files: DataFrame) -> DataFrame:
    """(repository_id, content_signature): the root of a tree of digests over each repository's files. A leaf is a digest of a
    path and a content, with how many files have it; leaves meet by ranges of their digests, sorted, and ranges by wider
    ones. So the signature depends on the files alone, however they are partitioned, tasks hold one range each, and no
    repository is one task's before its 4,096 last digests. Rows without a path or content take no part; a repository of
    such alone has the signature of no files. Order of paths doesn't matter; equal rows count each."""
    leaf = F.sha2(F.concat(F.sha2("path", 256), F.sha2(F.col("content").cast("string"), 256)), 256)
    rows = files.select("repository_id", leaf.alias("digest")).groupBy("repository_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col("digest").isNotNull(), F.concat_ws(":", "digest", "n"))
    rows = rows.select("repository_id", F.coalesce("digest", F.lit("")).alias("place"), entry.alias("entry"))
    for k in PREFIXES:
        by = rows.groupBy("repository_id", F.substring("place", 1, k).alias("place")).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        # a range of no leaves adds nothing to the next
        entry = F.when(F.size("entries") > 0, F.concat_ws(":", "place", F.sha2(F.array_join("entries", ","), 256)))
        rows = by.select("repository_id", "place", entry.alias("entry"))
    root = F.coalesce(F.substring("entry", 2, 64), F.sha2(F.lit(""), 256))
    return rows.select("repository_id", root.alias("content_signature"))


def _folded(rows: DataFrame, end: bytes) -> DataFrame:
    """SHA-256 of each repository's paths and contents, each followed by `end`, fed row by row in order of path: a
    repository is one task's, as the digest is of one sequence, but never one row or one group in memory."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"repository_id": pa.array([at], pa.string()), "content_signature": pa.array([digest.hexdigest()])})

        for b in batches:
            for i in range(b.num_rows):
                repository, path, content = (b.column(k)[i].as_py() for k in range(3))
                if digest is None or repository != at:
                    if digest is not None:
                        yield done()
                    at, digest = repository, hashlib.sha256()
                if path is not None and content is not None:
                    for x in (path, content):
                        digest.update(x.encode())
                        digest.update(end)
        if digest is not None:
            yield done()

    # by a hash of its own: rows that a join already dealt by repository would not be shuffled again, and a join that turns out
    # small when it runs reads them undealt
    rows = rows.repartition(F.xxhash64("repository_id")).sortWithinPartitions("repository_id", "path", "content")
    kind = rows.schema["repository_id"].dataType.simpleString()
    out = rows.withColumn("repository_id", F.col("repository_id").cast("string")).mapInArrow(fold, "repository_id string, content_signature string")
    return out.withColumn("repository_id", F.col("repository_id").cast(kind))


def changed(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The signatures of `new` that `stored` has not: what must be indexed."""
    return new.join(stored, ["repository_id", "content_signature"], "left_anti")


def latest(records: DataFrame, key: str = "repository_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last record of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return records.withColumn("n", n).where("n = 1").drop("n")


def listed(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.lower("repository_name"), "repository_id")
