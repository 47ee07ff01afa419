"""Cells, cover trees and pruning of the top-k search; op5's SQL and further brute force are in test_llm.py."""

import numpy as np

from lodestone.llm import topk_search


def _clustered(n, clusters, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    centres *= 4 / np.sqrt((centres**2).sum(axis=1))[:, None]
    return np.round(centres[r.integers(0, clusters, n)] + r.normal(size=(n, dim)) * 0.03, 3)


def test_cover_tree_is_nested_covering_and_separated():
    x = np.floor(_clustered(3000, 30, 8, 4) * 256)
    t = topk_search.CoverTree(np.arange(3000), x)
    assert sorted(t.ids) == list(range(3000)) and (t.points == x[t.ids]).all()
    for k in range(len(t.radius)):
        inside = t.points[t.first[k] : t.end[k]]
        assert t.first[k] <= t.centre[k] < t.end[k]
        assert np.sqrt(((inside - t.points[t.centre[k]]) ** 2).sum(axis=1)).max() <= t.radius[k] + 1e-9
        own = range(t.child[k], t.child_end[k])
        if own:
            assert t.centre[k] in t.centre[own.start : own.stop]
            assert (t.first[own.start], t.end[own.stop - 1]) == (t.first[k], t.end[k])
            c = t.points[t.centre[own.start : own.stop]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) + np.where(np.eye(len(c)), np.inf, 0)
            assert apart.min() >= t.radius[own.start : own.stop].max() - 1e-9


def test_many_cells_agree_with_brute_force_and_are_pruned(spark, monkeypatch):
    x = _clustered(4000, 25, 8, 6)
    x[100], x[101], x[150] = x[103], x[103], x[103]  # ties
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    pairs, whole = [], topk_search.may_meet

    def counted(blocks, cells):
        left = whole(blocks, cells)
        pairs.extend([left.count(), blocks.count() * (cells.count() - 1)])
        return left

    monkeypatch.setattr(topk_search, "may_meet", counted)
    got = topk_search.top_k(df, cell=100).collect()
    assert pairs[1] > 500 and pairs[0] < 0.35 * pairs[1], pairs  # of the pairs of blocks most never meet
    print("pairs searched, of", pairs)
    q = np.floor(x * 256)
    scores = (q[::50] @ q.T).astype(int)
    for i in range(0, 4000, 50):
        want = sorted((-scores[i // 50, j], j) for j in range(4000) if j != i)[:5]
        mine = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == i)
        assert [(-s, v) for _, s, v in mine] == want


def test_walk_saves_products_on_clusters():
    x = np.floor(_clustered(6000, 40, 8, 9) * 256)
    c, q = topk_search.CoverTree(np.arange(6000), x), topk_search.CoverTree(np.arange(0, 6000, 50), x[::50], topk_search.QUERY_LEAF)

    class Counted(np.ndarray):
        seen = 0

        def __matmul__(self, other):
            Counted.seen += self.shape[0] * other.shape[1]
            return np.asarray(self) @ np.asarray(other)

    c.points, q.points = c.points.view(Counted), q.points.view(Counted)
    topk_search.dual_tree(q, c, 5)
    # 0.55 of all products, with those that bounds take; three queries a cluster share leaves with other clusters'
    assert Counted.seen < 0.6 * 120 * 6000, Counted.seen
