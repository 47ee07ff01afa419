"""Exact vector search by an inverted file: stored cells of similar points, pruned by bounds on their angles.

Points are dealt into cells about centres, a bounded sample of the points of large repositories (small ones are one cell).
A cell keeps its mean direction and the least and greatest cosine of its points with it, so a query's angle with the
direction bounds its cosine with every point. A query is answered in its nearest cells first, as many as hold k points; then only
cells whose bound reaches the k-th score found are read. What is left out cannot be in the answer, so the result equals
`vectors.search`, ties included. Cells are cut into blocks of bounded size: no cell, of copies say, is one key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import vectors
from lodestone.operators.lexical import ranked
from lodestone.sources.tables import stored

#: Points a cell has about, centres at most (what is broadcast), points of a block.
CELL, CENTRES, BLOCK = 500, 2048, 4096
#: Numbers in the vectors of a group of blocks, about.
GROUP_VALUES = 1 << 20


@dataclass(frozen=True)
class InvertedFile:
    """points(repository_id, cell, block, chunk_id, vector, norm, ...), sorted by cell within files, and cells(repository_id, cell,
    centre, low, high, zeros, n, blocks): low and high are the points' least and greatest cosine with the centre."""

    points: DataFrame
    cells: DataFrame


def _centres(points: DataFrame, cell: int, centres: int) -> dict[str, np.ndarray]:
    """Unit vectors of a sample of each large repository's points, `centres` in all at most."""
    sizes = points.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))
    # of N points at most N / size rows are expected, and the limit holds whatever the hashes are
    total = sizes.agg(F.sum("n")).first()[0] or 0
    size = max(cell, -(-total // centres) * 2)
    large = sizes.where(F.col("n") >= 2 * size).select("repository_id")
    drawn = F.pmod(F.xxhash64("repository_id", "chunk_id"), F.lit(size)) == 0
    rows = points.where(drawn).where("norm > 0").join(large, "repository_id", "left_semi").select("repository_id", "vector", F.xxhash64("chunk_id").alias("h"))
    found: dict[str, list[np.ndarray]] = {}
    for r in rows.orderBy("h").limit(centres).collect():
        v = np.asarray(r.vector, np.float64)
        found.setdefault(r.repository_id, []).append(v / np.linalg.norm(v))
    return {k: np.stack(v) for k, v in found.items()}


def build(points: DataFrame, cell: int = CELL, centres: int = CENTRES, block: int = BLOCK) -> InvertedFile:
    """The inverted file of points (of vectors.prepared). Rows without a vector are in no cell; zero vectors score 0."""
    points = points.where("vector IS NOT NULL")
    near = _centres(points, cell, centres)
    names = points.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            repositories, cells = b.column(b.schema.get_field_index("repository_id")).to_pylist(), np.zeros(b.num_rows, np.int32)
            column = b.column(b.schema.get_field_index("vector"))
            for name in set(repositories) & set(near):
                at = np.asarray([i for i, r in enumerate(repositories) if r == name])
                rows = np.stack([np.asarray(column[int(i)].values, np.float64) for i in at])
                cells[at] = np.argmax(rows @ near[name].T, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], names=[*b.schema.names, "cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    with_cell = stored(points.mapInArrow(deal, kinds + ", cell int"), "ivf-dealt")
    # mean directions: sums of unit vectors, dimension by dimension
    unit = F.transform("vector", lambda x: x.cast("double") / F.col("norm"))
    sums = with_cell.where("norm > 0").select("repository_id", "cell", F.posexplode(unit).alias("i", "x")).groupBy("repository_id", "cell", "i").agg(F.sum("x").alias("x"))
    means = sums.groupBy("repository_id", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"))
    means = means.select("repository_id", "cell", F.transform("xs", lambda s: s["x"]).alias("centre"))
    means = stored(means.withColumn("centre_norm", vectors.norm(F.col("centre"))), "ivf-centres")
    both = with_cell.join(means, ["repository_id", "cell"], "left")
    length = F.col("norm") * F.col("centre_norm")
    cosine = F.when(length > 0, vectors.dot(F.col("vector"), F.col("centre")) / length)
    seen = both.groupBy("repository_id", "cell").agg(F.min(cosine).alias("low"), F.max(cosine).alias("high"), F.sum(F.when(F.col("norm") > 0, 0).otherwise(1)).alias("zeros"), F.count(F.lit(1)).alias("n"))
    cells = stored(seen.join(means, ["repository_id", "cell"], "left").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "ivf-cells")
    blocks = with_cell.join(cells.select("repository_id", "cell", "blocks"), ["repository_id", "cell"])
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    laid = blocks.repartitionByRange("repository_id", "cell", "block").sortWithinPartitions("repository_id", "cell", "block")
    return InvertedFile(stored(laid.select(*names, "cell", "block"), "ivf-points"), cells)


def bound(cosine: Column) -> Column:
    """The greatest cosine that a point of a cell can have with a query whose cosine with the cell's centre is given."""
    angle = lambda c: F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
    inner, outer, own = angle(F.col("high")), angle(F.col("low")), angle(cosine)
    return F.cos(F.greatest(F.lit(0.0), own - outer, inner - own))


def candidates(index: InvertedFile, queries: DataFrame, limit: int, digits: int | None = None) -> DataFrame:
    """(query columns, cell, blocks, n, best, first): the cells of each query's repository with their bound, `first` for the
    nearest that hold `limit` points."""
    q = queries.select("query_id", "repository_id", F.col("vector").alias("query_vector"), vectors.norm(F.col("vector")).alias("query_norm"))
    both = q.join(index.cells, "repository_id")
    length = F.col("query_norm") * F.col("centre_norm")
    cosine = F.when(length > 0, vectors.dot(F.col("query_vector"), F.col("centre")) / length)
    # rounding, of scores too, may lift a score over its bound
    slack = (0.0 if digits is None else 10.0**-digits) + 1e-7
    best = F.when(F.col("query_norm") == 0, 0.0).when(cosine.isNull(), F.when(F.col("zeros") > 0, 0.0).otherwise(1.0)).otherwise(F.greatest(bound(cosine), F.when(F.col("zeros") > 0, 0.0).otherwise(-1.0)))
    rows = both.select("query_id", "repository_id", "query_vector", "query_norm", "cell", "blocks", "n", (best + slack).alias("best"), F.coalesce(cosine, F.lit(0.0)).alias("near"))
    before = Window.partitionBy("query_id").orderBy(F.desc("near"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) < limit).drop("near")


def _scored(index: InvertedFile, queries: DataFrame, asked: DataFrame, limit: int, threshold: float | None, filters: dict[str, object] | None, digits: int | None) -> DataFrame:
    """(query_id, repository_id, chunk_id, score): the best points of the cells that asked (query_id, repository_id, cell, blocks,
    floor) names, `limit` at most for each query and group of blocks. A query's vector goes to a group of blocks once."""
    dim = F.greatest(F.max(F.size("vector")), F.lit(1))
    parts = index.points.groupBy("repository_id").agg(F.ceil(F.count(F.lit(1)) * dim / GROUP_VALUES).cast("int").alias("n_groups"))
    tall = queries.groupBy("repository_id").agg(F.ceil(F.count(F.lit(1)) * dim / vectors.QUERY_VALUES).cast("int").alias("q_groups"))
    grid = parts.join(tall, "repository_id")
    group = F.pmod(F.xxhash64("cell", "block"), F.col("n_groups")).cast("int")
    q_group = F.pmod(F.xxhash64("query_id"), F.col("q_groups")).cast("int")
    p = index.points.where(vectors.criteria(filters, index.points.columns)).join(grid, "repository_id").select("repository_id", group.alias("n_group"), F.explode(F.sequence(F.lit(0), F.col("q_groups") - 1)).alias("q_group"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "chunk_id", "vector", "norm", F.array("cell").alias("cells"), F.lit(None).cast("double").alias("floor"), F.lit(False).alias("asks"))
    pairs = asked.join(grid, "repository_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.groupBy("query_id", "repository_id", q_group.alias("q_group"), group.alias("n_group")).agg(F.collect_set("cell").alias("cells"), F.max("floor").alias("floor"))
    own = queries.select("query_id", "repository_id", "vector", vectors.norm(F.col("vector")).alias("norm"))
    q = pairs.join(own, ["query_id", "repository_id"]).withColumn("chunk_id", F.lit(None).cast(index.points.schema["chunk_id"].dataType)).withColumn("asks", F.lit(True)).select(*p.columns)

    def find(cell: pa.Table) -> pa.Table:
        asks, points = cell.filter(cell["asks"]), cell.filter(pc.invert(cell["asks"]))
        points = points.take(pc.sort_indices(points["chunk_id"], null_placement="at_start"))
        of = pc.list_flatten(points["cells"]).to_numpy()
        wants, wanted = pc.list_parent_indices(asks["cells"]).to_numpy(), pc.list_flatten(asks["cells"]).to_numpy()
        known = asks["floor"].to_numpy().astype(np.float64)
        best = None
        for c in np.unique(of):
            some, at = np.unique(wants[wanted == c]), np.flatnonzero(of == c)
            if not len(some):
                continue
            query, point, score = vectors.nearest(vectors._Vectors(asks.take(some)), vectors._Vectors(points.take(at)), limit, threshold, digits, known[some])
            here = (some[query], at[point], score.is_null().to_numpy(zero_copy_only=False), score.to_numpy(zero_copy_only=False).astype(np.float64))
            query, point, null, score = here if best is None else (np.concatenate(x) for x in zip(best, here, strict=True))
            order = np.lexsort((point, np.where(np.isnan(score), -np.inf, -score), ~np.isnan(score), null, query))
            rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            order = order[rank < limit]
            best = query[order], point[order], null[order], score[order]
        query, point, null, score = best or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0))
        columns = [asks["query_id"].take(query), asks["repository_id"].take(query), points["chunk_id"].take(point), pa.array(score, pa.float64(), mask=null, from_pandas=False)]
        return pa.table(columns, names=["query_id", "repository_id", "chunk_id", "score"])

    kinds = {"query_id": queries, "repository_id": index.points, "chunk_id": index.points}
    schema = ", ".join(f"{k} {v.schema[k].dataType.simpleString()}" for k, v in kinds.items()) + ", score double"
    return p.unionByName(q).groupBy("repository_id", "n_group", "q_group").applyInArrow(find, schema)


def search(index: InvertedFile, queries: DataFrame, limit: int, threshold: float | None = None, filters: dict[str, object] | None = None, digits: int | None = None) -> DataFrame:
    """As vectors.search, over an inverted file."""
    found, _ = searched(index, queries, limit, threshold, filters, digits)
    return found


def searched(index: InvertedFile, queries: DataFrame, limit: int, threshold: float | None = None, filters: dict[str, object] | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The result of `search`, and (query_id, points_read, points): how many points each query was compared with, of how many."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    asked = stored(candidates(index, queries, limit, digits).drop("query_vector", "query_norm"), "ivf-asked")
    none = F.lit(None).cast("double").alias("floor")
    first = stored(ranked(_scored(index, queries, asked.where("first").select("*", none), limit, threshold, filters, digits), "query_id", limit), "ivf-first")
    # the k-th score found so far; with fewer than k nothing is left out
    floor = first.where(F.col("rank") == limit).select("query_id", F.col("score").alias("floor"))
    rest = asked.where("NOT first").join(floor, "query_id", "left").where("floor IS NULL OR best >= floor")
    if threshold is not None:
        rest = rest.where(F.col("best") >= threshold)
    rest = stored(rest, "ivf-rest")
    more = _scored(index, queries, rest, limit, threshold, filters, digits)
    read = asked.where("first").select("query_id", "n").unionByName(rest.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("points_read"))
    work = asked.groupBy("query_id").agg(F.sum("n").alias("points")).join(read, "query_id").select("query_id", "points_read", "points")
    return ranked(first.drop("rank").unionByName(more), "query_id", limit), work
