"""What the operators share: the folder all executors see, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word patterns below: space and 0x09 to 0x0D, nothing else.
SPACES = " \t\n\x0b\x0c\r"
#: Java pattern for one run of that white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, the folder that driver and executors share.

    Only where the setting is absent in local mode (tests) a temporary folder of this machine stands in; a cluster
    without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each finished job are dropped."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it from there. The shuffle files of the
    job that wrote it are dropped when it ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `written` returned and that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot where it holds more than this part of all rows; so there are fewer than HOT of them.
HOT = 1000


def hot_join(rows: DataFrame, by: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with `by`, a written table of one row for each key with its number of rows in the column
    `count`. Hot keys, at most HOT, are broadcast, so that none of them gathers in one task; the rest is joined as usual."""
    total = by.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    few = F.broadcast(by.where(hot))
    rest = rows.join(F.broadcast(by.where(hot).select(*keys)), keys, "left_anti").join(by.where(~hot), keys, how)
    return rows.join(few, keys).select(*rest.columns).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, schema: str, batch: Callable[[pa.RecordBatch], Iterator[dict] | dict]) -> DataFrame:
    """df.mapInArrow with a function from one record batch to one dict of columns, or to several."""

    def run(batches):
        for b in batches:
            out = batch(b)
            for columns in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    # a first word stands before the first run of white space, or the text starts with an empty part
    parts = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("long")
