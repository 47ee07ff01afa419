"""Exact cosine search for batches of queries, within each query's repository.

Points and queries of a repository are dealt into a grid of cells, a group of points and a group of queries each, of bounded
size. A cell is one task's: products of matrices in single precision tell which pairs may be among a query's best, and only
these are scored, term by term as `dot` does. Every point is compared with every query of its repository.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import payload
from lodestone.operators.lexical import cell_of, half_up, ranked


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prepared(points: DataFrame) -> DataFrame:
    """points (repository_id, chunk_id, vector, ...) with their norm, to be kept with the table."""
    return points.withColumn("norm", norm(F.col("vector")))


def criteria(filters: dict[str, object] | None, columns: list[str]) -> Column:
    """Whether a point meets all filters on its columns, or on keys of its metadata."""
    if "repository_id" in (filters or {}):
        raise ValueError("a filter cannot replace the query's repository")
    return payload.meets(filters, columns, [c for c in columns if c != payload.NAME])


def search(points: DataFrame, queries: DataFrame, limit: int, threshold: float | None = None, filters: dict[str, object] | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, repository_id, chunk_id, score, rank): cosine similarity of queries (query_id, repository_id, vector) to
    the points (of `prepared`) of their repository, at least `threshold` if given; ties to the smaller chunk_id. A zero
    vector's similarity is 0. digits: scores are rounded to so many before anything else. Only each task's best rows of a query are shuffled."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = points.where(criteria(filters, points.columns)).select("repository_id", "chunk_id", "vector", "norm")
    asked = queries.select("query_id", "repository_id", "vector", norm(F.col("vector")).alias("norm"))
    return ranked(_best(rows, asked, limit, threshold, digits), "query_id", limit)


#: Numbers in the vectors of a cell's queries, at most, and of its points, about at least; pairs of a cell, about at most.
QUERY_VALUES, POINT_VALUES, PAIRS = 1 << 21, 1 << 17, 1 << 29
#: Queries and points of one product of matrices, pairs that are scored at once.
ROWS, COLUMNS, SCORED = 1024, 4096, 16384


def _best(rows: DataFrame, asked: DataFrame, limit: int, threshold: float | None, digits: int | None) -> DataFrame:
    """(query_id, repository_id, chunk_id, score): the best rows of each query in each cell of the grid, `limit` at most."""
    some = rows.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"))
    grid = some.join(asked.groupBy("repository_id").agg(F.count(F.lit(1)).alias("q")), "repository_id")
    dim = F.greatest("dim", F.lit(1))
    tall = grid.withColumn("q_groups", F.ceil(F.col("q") * dim / QUERY_VALUES).cast("int"))
    # points are repeated for each group of queries and queries for each group of points: neither is much more than the other
    even = F.least(F.col("n") * dim / POINT_VALUES, F.col("n") * F.col("q_groups") / F.col("q"))
    wide = F.ceil(F.greatest(even, F.col("n") * F.col("q") / F.col("q_groups") / PAIRS)).cast("int")
    grid = tall.select("repository_id", "q_groups", wide.alias("n_groups"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda id, c: F.pmod(F.xxhash64(id), F.col(c)).cast("int")
    p = rows.join(grid, "repository_id").select("repository_id", part("chunk_id", "n_groups").alias("n_group"), every("q_groups").alias("q_group"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "chunk_id", "vector", "norm", F.lit(False).alias("asks"))
    q = asked.join(grid, "repository_id").select("repository_id", every("n_groups").alias("n_group"), part("query_id", "q_groups").alias("q_group"), "query_id", F.lit(None).cast(rows.schema["chunk_id"].dataType).alias("chunk_id"), "vector", "norm", F.lit(True).alias("asks"))

    def find(cell: pa.Table) -> pa.Table:
        queries, points = cell.filter(cell["asks"]), cell.filter(pc.invert(cell["asks"]))
        points = points.take(pc.sort_indices(points["chunk_id"], null_placement="at_start"))
        query, point, score = nearest(_Vectors(queries), _Vectors(points), limit, threshold, digits)
        columns = [queries["query_id"].take(query), queries["repository_id"].take(query), points["chunk_id"].take(point), score]
        return pa.table(columns, names=["query_id", "repository_id", "chunk_id", "score"])

    kinds = {"query_id": asked, "repository_id": rows, "chunk_id": rows}
    schema = ", ".join(f"{k} {v.schema[k].dataType.simpleString()}" for k, v in kinds.items()) + ", score double"
    cell = cell_of("repository_id", "n_group", "q_group")
    return p.unionByName(q).withColumn("cell", cell).groupBy("cell").applyInArrow(find, schema)


class _Vectors:
    """Vectors of a cell and their norms; a vector without a norm has a null component, or is null."""

    def __init__(self, rows: pa.Table):
        lists = rows["vector"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))
        self.n, self.norm = rows.num_rows, rows["norm"].to_numpy().astype(np.float64)
        self.known = rows["norm"].is_valid().to_numpy().astype(bool)
        self.size = np.where(self.known, pc.fill_null(pc.list_value_length(lists), -1).to_numpy(), -1)
        self.lists = lists

    def matrix(self, at: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors numbered `at` as they are, zeros if their norm is 0, and in single precision with norm 1: not a number
        where that precision can't tell."""
        whole = np.zeros((len(at), max(dim, 1)))
        some = self.size[at] == dim
        if dim and some.any():
            whole[some] = pc.list_flatten(self.lists.take(pa.array(at[some]))).to_numpy(zero_copy_only=False).reshape(-1, dim)
        norm = self.norm[at]
        whole[norm == 0] = 0
        with np.errstate(all="ignore"):
            unit = (whole / np.where(norm == 0, 1, norm)[:, None]).astype(np.float32)
        unit[~np.isfinite(norm) | ((norm != 0) & (norm < 1e-100))] = np.nan
        return whole, unit


def nearest(queries: _Vectors, points: _Vectors, limit: int, threshold: float | None, digits: int | None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(query, point, score) of each query's best points, `limit` at most; ties to the first point. As in Spark no score is
    the least, and not a number the greatest; a threshold drops rows without a score. known: for each query a score below which
    no point counts, not a number for none."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # queries of one length, and of norm 0, finite or not
    kind = np.where(queries.known, 3 * queries.size + np.where(queries.norm == 0, 0, np.where(np.isfinite(queries.norm), 1, 2)), -1)
    for k in np.unique(kind):
        asks, dim = np.flatnonzero(kind == k), k // 3
        # a zero vector, on either side, scores 0 whatever the other's length is; other lengths that differ give no score
        zero = (np.isfinite(points.norm), points.norm == 0, np.zeros(points.n, bool))[k % 3]
        fits = points.known & ((points.size == dim) | zero) if k >= 0 else np.zeros(points.n, bool)
        at, lost = np.flatnonzero(fits), np.flatnonzero(~fits)[:limit]
        if len(at):
            p, p_unit = points.matrix(at, dim)
            q, q_unit = queries.matrix(asks, dim)
            for i in range(0, len(asks), ROWS):
                few = slice(i, i + ROWS)
                a, b, s = _block(q[few], q_unit[few], queries.norm[asks[few]], p, p_unit, points.norm[at], limit, threshold, digits, None if known is None else known[asks[few]])
                out.append((asks[few][a], at[b], s))
        if threshold is None and len(lost) and len(at) < limit:
            out.append((np.repeat(asks, len(lost)), np.tile(lost, len(asks)), np.full(len(asks) * len(lost), None)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.float64())
    score = pa.concat_arrays([pa.nulls(len(s), pa.float64()) if s.dtype == object else pa.array(s, from_pandas=False) for _, _, s in out])
    return np.concatenate([a for a, _, _ in out]), np.concatenate([b for _, b, _ in out]), score


def _block(q, q_unit, q_norm, p, p_unit, p_norm, limit: int, threshold: float | None, digits: int | None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest, for vectors of one length and a block of queries."""
    # how far a product in single precision, and rounding, may move a score
    slack = (q.shape[1] + 16) * 2.0**-23 + (0.0 if digits is None else 10.0**-digits)
    floor = np.full(len(q), -np.inf if threshold is None else threshold - slack, np.float32)
    if known is not None:
        floor = np.maximum(floor, np.nan_to_num(known - slack, nan=-np.inf).astype(np.float32))
    query, point, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at, step = 0, max(256, 4 * limit)
    while at < len(p):
        # steps grow, as the first ones only find out how near the best are
        end = min(at + min(step, COLUMNS), len(p))
        with np.errstate(all="ignore"):
            near = q_unit @ p_unit[at:end].T
        a, b = np.nonzero(~(near < floor[:, None]))
        if len(a):
            b = b + at
            s = np.concatenate([_scores(q, q_norm, p, p_norm, a[i : i + SCORED], b[i : i + SCORED], digits) for i in range(0, len(a), SCORED)])
            if threshold is not None:
                kept = ~(s < threshold)
                a, b, s = a[kept], b[kept], s[kept]
            query, point, score = np.concatenate([query, a]), np.concatenate([point, b]), np.concatenate([score, s])
            order = np.lexsort((point, np.where(np.isnan(score), -np.inf, -score), ~np.isnan(score), query))
            query = query[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            order, query = order[rank < limit], query[rank < limit]
            point, score = point[order], score[order]
            last = rank[rank < limit] == limit - 1
            floor[query[last]] = np.nan_to_num(score[last] - slack, nan=np.inf)
        at, step = end, 2 * step
    return query, point, score


def _scores(q, q_norm, p, p_norm, a: np.ndarray, b: np.ndarray, digits: int | None) -> np.ndarray:
    """Cosines of the pairs (a, b), added up from the first component on as in `dot`, and rounded as in Spark."""
    with np.errstate(all="ignore"):
        length = p_norm[b] * q_norm[a]
        s = np.where(length == 0, 0.0, np.cumsum(p[b] * q[a], axis=1)[:, -1] / length) + 0.0
    return half_up(s, digits)
