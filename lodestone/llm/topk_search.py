"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt by space: each belongs to the cell of its nearest pivot, of which there are at most PIVOTS, chosen
farthest first from a bounded sample. A cell's rows, and the queries among them, are dealt into blocks of bounded size,
and a task builds the cover tree of each block. A node's centre is one of its points; its children's centres are
found farthest first, beginning with its own, until they cover half its radius or are CHILDREN. So trees are nested (a
centre is a centre at all levels below), and the children of a node are at least as far apart as the radius that they
cover; a level's radius shrinks by a factor of two, or by less where CHILDREN centres cannot cover that.

Two trees are walked together: a pair of nodes is dropped if no inner product between them can reach the worst k-th
score of the queries below the query node, which the centres and covering radii bound: q.c <= Q.C + |Q| r + |C| s + r s.
The same bound, one level up, decides which blocks meet: query blocks are first searched in their own cells, and then
only in cells that may hold a score as high as the worst k-th one found there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, written

#: Points of one tree.
CANDIDATES, QUERIES = 16384, 2048
#: Most pivots, rows that a cell is to have where these suffice, and rows of the sample for each pivot.
PIVOTS, CELL, SAMPLE = 256, 4096, 16
LEAF, QUERY_LEAF, CHILDREN = 192, 48, 24


class CoverTree:
    """points, ids in the tree's order; of each node: centre, radius, first and end point, first child and end child."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        nodes = [[0, 0.0, 0, len(ids), 0, 0]]
        nodes[0][1] = self._far(points, 0).max(initial=0.0)
        k = 0
        while k < len(nodes):
            centre, radius, a, b, _, _ = nodes[k]
            if b - a > leaf and radius > 0:
                rows = order[a:b].copy()
                own, centres = self._children(points[rows], int(np.flatnonzero(rows == centre)[0]), radius, leaf)
                by = np.argsort(own, kind="stable")
                order[a:b] = rows[by]
                ends = a + np.cumsum(np.bincount(own, minlength=len(centres)))
                nodes[k][4:] = [len(nodes), len(nodes) + len(centres)]
                start = a
                for c, end in zip(centres, ends, strict=True):
                    inside = order[start:end]
                    nodes.append([rows[c], self._far(points[inside], points[rows[c]]).max(), start, int(end), 0, 0])
                    start = int(end)
            k += 1
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.points = ids[order], points[order]
        self.centre = place[[x[0] for x in nodes]]
        self.radius = np.array([x[1] for x in nodes])
        self.first, self.end, self.child, self.child_end = np.array([x[2:] for x in nodes], np.int64).T
        self.norm = np.sqrt((self.points[self.centre] ** 2).sum(axis=1))

    @staticmethod
    def _far(points: np.ndarray, centre) -> np.ndarray:
        d = points - (points[centre] if np.isscalar(centre) else centre)
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _net(self, x: np.ndarray, centre: int, radius: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        centres, near, own = [centre], self._far(x, centre), np.zeros(len(x), np.int64)
        while len(centres) < most and near.max() > radius / 2:
            c = int(near.argmax())
            d = self._far(x, c)
            own[d < near] = len(centres)
            near = np.minimum(near, d)
            centres.append(c)
        return centres, near, own

    def _children(self, x: np.ndarray, centre: int, radius: float, leaf: int) -> tuple[np.ndarray, list[int]]:
        """Farthest-first centres until they cover half the radius, and the nearest centre of each point. Where CHILDREN
        of them hardly shrink the radius, only as many as leaves of about half of `leaf` take: small leaves save nothing there."""
        centres, near, own = self._net(x, centre, radius, CHILDREN)
        few = max(2, len(x) // (leaf // 2))
        if len(centres) > few and near.max() > 0.75 * radius:
            centres, near, own = self._net(x, centre, radius, few)
        if len(centres) == 1:  # the centre covers all within half the radius: split off the farthest nevertheless
            c = int(near.argmax())
            own[self._far(x, c) < near] = 1
            centres.append(c)
        return own, centres


def dual_tree(q: CoverTree, c: CoverTree, k: int, floors: dict[int, float] | None = None) -> list[list[tuple[int, int]]]:
    """For each of q's points, in q's order, its k best (score, id) among c's points with another id; floors: scores
    by query id below which none is wanted."""
    best: list[list[tuple[int, int]]] = [[] for _ in q.ids]
    worst = np.array([(floors or {}).get(int(i), -np.inf) for i in q.ids])
    largest = max(np.abs(q.points).max(initial=0), np.abs(c.points).max(initial=0))
    exact = largest * largest * q.points.shape[1] < 2.0**53
    slack = 1e-9 * (largest * largest * q.points.shape[1] + 1)

    def bounds(qs: np.ndarray, cs: np.ndarray) -> np.ndarray:
        r, s = q.radius[qs][:, None], c.radius[cs][None]
        return q.points[q.centre[qs]] @ c.points[c.centre[cs]].T + q.norm[qs][:, None] * s + c.norm[cs][None] * r + r * s + slack

    def meet(a: int, at: np.ndarray) -> None:
        """All points of query node a with candidates `at`."""
        i, j, ids = q.first[a], q.end[a], c.ids[at]
        x, y = q.points[i:j], c.points[at]
        scores = x @ y.T if exact else (x.astype(object) @ y.T.astype(object))
        good = (scores >= worst[i:j][:, None]) & (q.ids[i:j][:, None] != ids[None])
        for row in np.flatnonzero(good.any(axis=1)):
            hit = np.flatnonzero(good[row])
            if len(hit) > 4 * k and exact:  # only the k best of them can stay, with all that tie with the last
                low = np.partition(scores[row, hit], -k)[-k]
                hit = hit[scores[row, hit] >= low]
                if len(hit) > 4 * k:
                    hit = hit[np.lexsort((ids[hit], -scores[row, hit]))[:k]]
            found = best[i + row] + [(int(scores[row, h]), int(ids[h])) for h in hit]
            best[i + row] = found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            if len(found) == k:
                worst[i + row] = max(worst[i + row], found[-1][0])

    is_leaf = c.child == c.child_end
    over_leaf = np.array([is_leaf[m:n].any() for m, n in zip(c.child, c.child_end, strict=True)])
    stack = [(0, 0, np.inf)]
    while stack:
        a, b, bound = stack.pop()
        low = worst[q.first[a] : q.end[a]].min()
        if bound < low:
            continue
        leaf_q = q.child[a] == q.child_end[a]
        if leaf_q and is_leaf[b]:
            meet(a, np.arange(c.first[b], c.end[b]))
            continue
        split_q = not leaf_q and (is_leaf[b] or over_leaf[b] or q.radius[a] >= c.radius[b])
        qs = np.arange(q.child[a], q.child_end[a]) if split_q else np.array([a])
        cs = np.array([b]) if split_q else np.arange(c.child[b], c.child_end[b])
        limit = bounds(qs, cs)
        if leaf_q:  # all leaves that stay, in one product
            leaves = is_leaf[cs] & (limit[0] >= low)
            if leaves.any():
                start, many = c.first[cs[leaves]], (c.end - c.first)[cs[leaves]]
                meet(a, np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum()))
            cs, limit = cs[~is_leaf[cs]], limit[:, ~is_leaf[cs]]
        for flat in np.argsort(limit, axis=None):
            u, v = divmod(int(flat), len(cs))
            stack.append((qs[u], cs[v], limit[u, v]))
    return best


def quantized(vector: Column) -> Column:
    """floor(256 * x) of each component as double; null for vectors that take no part."""
    fine = F.size(vector) > 0
    fine &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def _pivots(rows: DataFrame, n: int, cell: int) -> dict[int, np.ndarray]:
    """By length of vectors: pivots for n rows (id, v, dim), farthest first among a sample by hash of about SAMPLE rows each."""
    most = min(PIVOTS, n // cell)
    if not most:
        return {}
    sample = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(n)) < SAMPLE * most).orderBy("id", "v").collect()
    pivots = {}
    for dim in {r.dim for r in sample}:
        x = np.array([r.v for r in sample if r.dim == dim])
        chosen, near = [0], CoverTree._far(x, 0)
        while len(chosen) < most * len(x) // len(sample) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, CoverTree._far(x, chosen[-1]))
        pivots[dim] = x[chosen]
    return pivots


def _in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows (id, v, dim) with their cell, that of the nearest pivot, and how far that is; lengths without pivots have
    one cell, around the origin."""
    given = rows.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b["dim"].to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = b["v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                p = given.value.get(int(dim), np.zeros((1, dim)))
                cell[at] = ((p**2).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
                far[at] = CoverTree._far(x, p[cell[at]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=["id", "v", "dim", "cell", "far"])

    return rows.select("id", "v", "dim").mapInArrow(deal, "id long, v array<double>, dim int, cell int, far double")


def _trees(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(dim, cell, block, tree): the cover tree of each block of rows (id, v, dim, cell, block)."""

    def build(t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks()
        points = v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        tree = pickle.dumps(CoverTree(t["id"].to_numpy(), points, leaf), protocol=5)
        return pa.table({"dim": t["dim"][:1], "cell": t["cell"][:1], "block": t["block"][:1], "tree": pa.array([tree], pa.binary())})

    return rows.select("id", "v", "dim", "cell", "block").groupBy("dim", "cell", "block").applyInArrow(build, "dim int, cell int, block long, tree binary")


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each pair (query_tree, floors, tree), every query's k best with no less than its floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, floors, c in zip(b.column(0), b.column(1), b.column(2), strict=True):
                q = pickle.loads(a.as_py())
                low = {x["id"]: x["floor"] for x in floors.as_py() or ()}
                found = [(int(i), score, other) for i, best in zip(q.ids, dual_tree(q, pickle.loads(c.as_py()), k, low), strict=True) for score, other in best]
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "score", "vec_id"])

    return pairs.select("query_tree", "floors", "tree").mapInArrow(search, "query_id long, score long, vec_id long").select("query_id", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of rows (query_id, vec_id, score)."""
    # a query in rows of several vectors may meet a row more than once
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def may_meet(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Of query blocks (dim, cell, block, radius, worst) those cells (dim, cell, centre, norm, radius, ...) other than their
    own that may hold a score of `worst` (null: any): (dim, cell, block, candidate_cell, blocks)."""
    own = cells.select("dim", "cell", F.col("centre").alias("q_centre"), F.col("norm").alias("q_norm"))
    other = cells.select("dim", F.col("cell").alias("candidate_cell"), "centre", "norm", F.col("radius").alias("r"), "blocks")
    pairs = blocks.join(own, ["dim", "cell"]).join(other, "dim").where("cell <> candidate_cell")
    dot = F.aggregate(F.zip_with("q_centre", "centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    bound = dot + F.expr("q_norm * r + norm * radius + radius * r + 1e-9D * (q_norm + radius) * (norm + r) + 1")
    return pairs.where(F.col("worst").isNull() | (bound >= F.col("worst"))).select("dim", "cell", "block", "candidate_cell", "blocks")


def top_k(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for rows whose id is divisible by `every`.

    Components become floor(256 x); scores are integer inner products, ties go to the smaller id. Null vectors,
    empty ones, and those with null or non-finite components take no part, nor do null ids; vectors of different
    lengths are not compared; rows repeated with id and vector count once, rows with a query's id are its own. An empty
    table gives an empty one; other columns are ignored. Scores beyond 64 bits raise an error. `cell` is the number of
    rows that a cell is to have while there are fewer than PIVOTS; it has no bearing on results.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), quantized(F.col(vector)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").distinct()
    rows = written(rows.withColumn("dim", F.size("v")), "topk-rows")
    pivots = _pivots(rows, rows.count(), cell)
    dealt = written(_in_cells(rows, pivots).withColumn("asks", F.pmod("id", F.lit(every)) == 0), "topk-cells")
    dropped(rows)
    asked = F.col("asks")
    counts = dealt.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"), F.count(F.when(asked, 1)).alias("n_queries"))
    known = [(dim, i, p.tolist()) for dim, own in pivots.items() for i, p in enumerate(own)]
    centres = rows.sparkSession.createDataFrame(known, "dim int, cell int, centre array<double>")
    cells = counts.join(centres, ["dim", "cell"], "left").withColumn("centre", F.expr("coalesce(centre, array_repeat(0D, dim))"))
    blocks = lambda n, most: F.ceil(F.col(n) / most).alias("blocks")
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")
    cells = written(cells.select("dim", "cell", "centre", norm, F.expr("radius * (1 + 1e-9D)").alias("radius"), blocks("n", CANDIDATES), blocks("n_queries", QUERIES).alias("query_blocks")), "topk-centres")

    def blocked(part: DataFrame, by: str) -> DataFrame:
        return part.join(cells.select("dim", "cell", by), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), by)).drop(by)

    candidates = written(_trees(blocked(dealt, "blocks")), "topk-trees")
    queries = written(blocked(dealt.where(asked), "query_blocks").drop("asks"), "topk-queries")
    trees = written(_trees(queries, QUERY_LEAF).withColumnRenamed("tree", "query_tree"), "topk-query-trees")

    def met(pairs: DataFrame) -> DataFrame:
        """Pairs (dim, candidate_cell, blocks, query_tree, floors) with the tree of every block of that cell."""
        each = pairs.select("dim", F.col("candidate_cell").alias("cell"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "query_tree", "floors")
        return each.join(candidates, ["dim", "cell", "block"])

    at_home = trees.join(cells.select("dim", "cell", F.col("cell").alias("candidate_cell"), "blocks"), ["dim", "cell"])
    first = written(_best(_search(met(at_home.withColumn("floors", F.expr("CAST(NULL AS array<struct<id: bigint, floor: double>>)"))), k), k), "topk-home")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    # null where a query of the block has fewer than k so far
    least = F.when(F.count(F.lit(1)) == F.count("floor"), F.min("floor")).alias("worst")
    kept = F.collect_list(F.when(F.col("floor").isNotNull(), F.struct("id", "floor"))).alias("floors")
    by = queries.select("dim", "cell", "block", "id", "far").join(floors, "id", "left").groupBy("dim", "cell", "block")
    known = written(by.agg(F.expr("max(far) * (1 + 1e-9D)").alias("radius"), least, kept), "topk-floors")
    away = may_meet(known, cells).join(known.select("dim", "cell", "block", "floors"), ["dim", "cell", "block"]).join(trees, ["dim", "cell", "block"])
    return _best(_search(met(away), k).unionByName(first.drop("rank")), k)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v) GROUP BY 1, 2)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
