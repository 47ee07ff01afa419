"""The table of links holds every pair of similar different texts, found by the trees."""

import random
from itertools import combinations

import numpy as np

from lodestone.llm import ngram_join


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_every_link_is_returned(spark):
    r = random.Random(3)
    rows = []
    for _ in range(6):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(r.choice([3, 5, 9])):
            copy = list(base)
            copy[r.randrange(len(copy))] = f"x{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members, links = ngram_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = links.collect()
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want)
    degree = {i: sum(i in p for p in want) for i in sets}
    assert {r.doc_id: r.n_links for r in members.collect()} == degree


def here(cells, points, need, of, least=False):
    """_tree_pairs in this process, where a test can change the tree."""
    rows = cells.join(points.select("key", "point"), "key").toPandas().sort_values("cell", kind="stable")
    out = []
    for cell, own in rows.groupby("cell", sort=False):
        columns = {c: own[c].to_numpy() for c in ("key", "n", "component", "upper", "own_block", "same")}
        found, open_ = ngram_join.Cell(columns, list(map(bytes, own["point"])), 0, len(own)).pairs(need, of, least)
        out += found + ([(cell, None)] if open_ else [])
    return cells.sparkSession.createDataFrame([(int(a), None if b is None else int(b)) for a, b in out], "a long, b long").distinct()


def test_without_searches_of_trees_every_link_is_lost(spark, monkeypatch):
    """Cells of two to many members: what CountTree.search finds is all there is."""
    r, rows = random.Random(11), []
    for n in (2, 3, 5, 17, 40):
        base = [f"b{r.randint(0, 10**6)}" for _ in range(100)]
        rows += [(len(rows) + i, " ".join(base[:50] + [f"x{n}-{i}"] + base[50:])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "_tree_pairs", here)
    want = sum(n * (n - 1) // 2 for n in (2, 3, 5, 17, 40))
    assert ngram_join.near_duplicate_classes(docs)[1].count() == want
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(ngram_join.CountTree, "search", lambda self, queries, sizes, need, of: (none, none))
    for every_link in (True, False):
        members, links = ngram_join.near_duplicate_classes(docs, every_link=every_link)
        assert links.count() == 0 and {m.component_id for m in members.collect()} == {i for i, _ in rows}


def test_trees_give_what_all_pairs_give():
    r = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 33, 300):
        points = np.minimum(r.poisson(1.0, (n, 64)) + r.integers(0, 2, (1, 64)), 255).astype(np.uint8)
        points[n // 2 :] = points[: n - n // 2]
        points[n // 2 :, :5] += 1
        sizes = points.sum(axis=1, dtype=np.int64)
        most = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64)
        want = ngram_join.enough(most, sizes[:, None] + sizes[None])
        got = np.zeros((n, n), bool)
        for i, found in ngram_join.searches(points, sizes, np.arange(n), np.arange(n), 80, 100):
            got[i, found] = True
        assert (got == want).all()


def test_nothing_but_the_trees_finds_pairs(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k if k != 40 else -i}" for k in range(90))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.near_duplicate_classes(docs)[1].count() == 10
    monkeypatch.setattr(ngram_join, "_tree_pairs", lambda cells, points, need, of, least=False: spark.createDataFrame([], "a long, b long"))
    members, links = ngram_join.near_duplicate_classes(docs)
    assert ngram_join.near_duplicate_classes(docs, every_link=False)[1].count() == 0
    assert links.count() == 0 and {r.component_id for r in members.collect()} == {i for i, _ in rows}


def test_blocks_and_bands_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "TOGETHER", 20)
    r = random.Random(5)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(60):  # a passage that all share, and families that are similar beyond it
        if i % 6 == 0:
            base = [f"b{r.randint(0, 10**6)}" for _ in range(r.choice([12, 60, 200]))]
        copy = passage + base + [f"c{i}"] * (i % 3)
        rows.append((i, " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, links = ngram_join.near_duplicate_classes(docs)
    first = {frozenset(sets[i]): i for i in sorted(sets, reverse=True)}
    assert {(x.a, x.b) for x in links.collect()} == {tuple(sorted((first[frozenset(sets[a])], first[frozenset(sets[b])]))) for a, b in want}


def test_components_of_large_families(spark, monkeypatch):
    """Rounds, blocks and searches that find more than FEW others give the components of all links: families whose members
    are similar to some others only, members a word longer each time, and a passage that all share."""
    monkeypatch.setattr(ngram_join, "BLOCK", 9)
    r = random.Random(7)
    passage, rows = [f"p{i}" for i in range(30)], []
    for f in range(4):
        base = [f"b{r.randint(0, 10**6)}" for _ in range(150)]
        for i in range(28):
            copy = base[: len(base) - 2 * (i % 3)] + [f"e{f}-{k}" for k in range(2 * i if f == 0 else 0)]
            for _ in range(r.choice([1, 3, 6])):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(passage + copy)))
    r.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    members, _ = ngram_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), every_link=False)
    assert {m.doc_id: m.component_id for m in members.collect()} == {i: top(i) for i in sets}
