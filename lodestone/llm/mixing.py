"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's documents get floor(target / size of the source) whole copies for certain. What is left of the target
is filled by one more copy of some, a fixed size in words: documents are ranked by [u / (1 - u)] / o, u a uniform number from
the document's id, lowest first. o are a document's odds of inclusion: those of the part that is left of the source, times the
root of the document's size over the source's mean size, so longer documents are likelier to be taken.

A source may hold most rows, so ranks are never taken over a whole source: words are summed in BINS bins of the
rank, and only the bin in which the target falls is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import word_count, written

#: Bins of the rank within each source.
BINS = 4096
#: Times that documents fitting into what is left of a target are taken in rank order.
FILLS = 2
#: Sources whose targets are broadcast at most; more are joined by a shuffle.
BROADCAST = 50_000


def uniform(id: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the MD5 of the decimal id."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target, mean) of rows (source, size). Sources by code point, null last, get the weights in
    turn and share the sum of all sizes; a target stops at `most` times its source's size and the excess is shared
    again by weight. In order of most * size / weight the capped sources come first, so one pass of sums finds them."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    by = by.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    by = by.select(
        "*",
        F.sum("source_size").over(all_rows).cast("double").alias("total"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    by = by.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    by = by.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(all_rows)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    return by.select("source", "source_size", target.alias("target"), (F.col("source_size") / F.greatest("n", F.lit(1))).alias("mean"))


def _with_source(rows: DataFrame, by: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """rows with what `by` has for their source s; broadcast where there are few sources, so that none gathers in a task."""
    return rows.join(F.broadcast(by) if few else by, F.col("source").eqNullSafe(F.col("s")), how).drop("s")


def _fill(rows: DataFrame, few: bool, name: str) -> DataFrame:
    """Takes documents no larger than what is left of their source's target, in rank order, while they fit."""
    rows = rows.withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    open_ = (~F.col("taken_more")) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
    bins = rows.where(open_).groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    cut = bins.withColumn("upto", upto).groupBy(F.col("source").alias("s")).agg(
        F.min(F.when(F.col("upto") > F.col("left"), F.col("bin"))).alias("cut"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("before"),
    )
    rows = _with_source(rows, cut, few)
    inside = F.coalesce(open_ & (F.col("bin") == F.col("cut")), F.lit(False))
    within = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id"))
    exact = rows.where(inside).withColumn("new", F.col("before") + within <= F.col("left"))
    whole = rows.where(~inside).withColumn("new", open_ & F.col("before").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))))
    rows = written(exact.unionByName(whole).drop("bin", "cut", "before"), name)
    used = rows.where("new").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("used"))
    rows = _with_source(rows, used, few)
    return rows.withColumn("left", F.col("left") - F.coalesce(F.col("used"), F.lit(0))).withColumn("taken_more", F.col("taken_more") | F.col("new")).drop("used", "new")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, rank_by: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row: taken = size times the copies the mix takes, at most
    `most`. What is taken comes from sizes and the id alone (or the column rank_by in its place), so reruns agree; rows
    with the same id and source rank alike, and ties in rank go to the smaller id.

    A null or empty text has size 0 and takes nothing; very long texts are counted whole; a null source is a source of its
    own, last in order; a null id ranks as the word null. An empty table gives an empty one; other columns are ignored.
    After FILLS fills, the document whose size is nearest to the rest of its source's target is taken if that lessens the
    difference.
    """
    sizes = written(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), F.col(rank_by or id).alias("rank_by"), word_count(F.col(text)).alias("size")), "mix-sizes")
    targets = written(source_targets(sizes, weights, most).withColumnRenamed("source", "s"), "mix-targets")
    few = targets.count() <= BROADCAST
    rows = _with_source(sizes, targets, few, "inner")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("copies")).otherwise(0.0)
    u = uniform(F.col("rank_by"))
    odds = F.col("p") / (1 - F.col("p")) * F.sqrt(F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0))
    # x / (1 + x) of the ranked x = [u / (1 - u)] / odds: the same order, in [0, 1)
    rank = F.col("u") / (F.col("u") + (1 - F.col("u")) * F.col("odds"))
    rows = rows.withColumn("copies", copies).withColumn("p", p).withColumn("u", u).withColumn("odds", odds)
    rows = rows.withColumn("rank", F.least(rank, F.lit(1 - 2.0**-40))).drop("u", "odds", "p", "mean", "rank_by")
    rows = rows.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("taken_more", F.col("copies") >= most)
    for k in range(FILLS):
        rows = _fill(rows, few, f"mix-fill{k}")
    off = F.abs(F.col("size") - F.col("left"))
    nearest = rows.where(~F.col("taken_more") & (F.col("size") > 0) & (off < F.col("left"))).groupBy(F.col("source").alias("s")).agg(F.min(F.struct(off.alias("off"), "rank", "doc_id")).alias("best"))
    rows = _with_source(rows, nearest, few)
    last = F.coalesce((~F.col("taken_more")) & (off == F.col("best.off")) & (F.col("rank") == F.col("best.rank")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")), F.lit(False))
    copies = F.col("copies") + ((F.col("taken_more") & (F.col("copies") < most)) | last).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE / greatest(count(*) FILTER (WHERE size > 0), 1)::DOUBLE AS mean, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sizes GROUP BY source),
sums AS (
  SELECT *, (source_size * 3)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total,
    coalesce(sum((source_size * 3)::DOUBLE) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM by_source),
levels AS (SELECT *, (total - before) / rest AS level, cap <= (total - before) / rest * weight AS capped FROM sums),
targets AS (
  SELECT source, source_size, mean, CASE WHEN capped THEN cap ELSE weight * (SELECT arg_min(level, (cap / weight, source IS NULL, source)) FROM levels WHERE NOT capped) END AS target
  FROM levels),
u AS (
  SELECT doc_id, s.source, size, source_size, target, mean,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size - copies ELSE 0 END AS p, target - copies * source_size AS left0 FROM u),
o AS (SELECT *, p / (1 - p) * sqrt(CASE WHEN mean > 0 THEN size / mean ELSE 0 END) AS odds FROM p),
r AS (SELECT *, least(u / (u + (1 - u) * odds), 1 - 1.0::DOUBLE / 1099511627776::DOUBLE) AS rank FROM o),
f1 AS (
  SELECT *, copies < 3 AND size > 0 AND size <= left0 AND sum(CASE WHEN copies < 3 AND size > 0 AND size <= left0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id) <= left0 AS more1 FROM r),
l1 AS (SELECT *, left0 - coalesce(sum(size) FILTER (WHERE more1) OVER (PARTITION BY source), 0) AS left1 FROM f1),
f2 AS (
  SELECT *, copies < 3 AND NOT more1 AND size > 0 AND size <= left1 AND sum(CASE WHEN copies < 3 AND NOT more1 AND size > 0 AND size <= left1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id) <= left1 AS more2 FROM l1),
l2 AS (SELECT *, left1 - coalesce(sum(size) FILTER (WHERE more2) OVER (PARTITION BY source), 0) AS left2 FROM f2),
best AS (
  SELECT source, min((abs(size - left2), rank, doc_id)) AS best FROM l2
  WHERE copies < 3 AND NOT more1 AND NOT more2 AND size > 0 AND abs(size - left2) < left2 GROUP BY source)
SELECT doc_id, size, source_size, target, size * c AS taken, c AS copies
FROM (SELECT l2.*, copies + (more1 OR more2 OR coalesce(copies < 3 AND (abs(size - left2), rank, doc_id) = best, false))::BIGINT AS c
  FROM l2 LEFT JOIN best b ON l2.source IS NOT DISTINCT FROM b.source)
"""
