"""N-gram Jaccard self-join by R-trees over count vectors, and its near-duplicate classes.

A document is the set of its distinct shingles' hashes. Hashes fall into groups; a set's counts by group are its point.
The overlap of two sets is at most the sum over groups of the smaller count, and with a tree node's box at most the sum
of the smaller of count and box corner; a pair is verified on the whole sets only if that bound reaches what the
similarity needs.

1. Sets that are equal are one class.
2. Points are dealt into cells, within which alone similar ones can lie: similar sets share one of their least hashes (the
   prefix that the similarity cannot do without; of the smaller set a prefix half as long is enough), and have sizes of the
   same or the next band. Large cells are dealt again by pairs of blocks.
3. R-trees are packed in each cell, and find the pairs that the bound lets pass; these and no others are verified.
4. Links are verified pairs, and components those of the links.

Nothing but the trees finds pairs. For the table of all links they give every pair; a family of m near copies of different
texts has up to m * m / 2. For components alone there are three rounds, each after the links of the last have been joined:
cells of the least hash only, a row a class; all cells in which components still meet; and again those of them where a
class found more than FEW others, of which it was paired with the least alone. In a cell the members of its largest
component are not paired with each other, but searched by the rest. So a family costs a few pairs a class, and no link
between components is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, dropped, hot_join, written
from lodestone.llm.graph import components
from lodestone.llm.wordhash import LOWER, U, Words, chunks, inside, joined, mix, sequences

SHINGLE = 5
#: Similarity as a ratio of whole numbers: 80 / 100.
NEED, OF = 80, 100
#: Groups of a point: two an element up to a point of 256, one for four elements of sets so large that this is more;
#: powers of two, so that a point can be folded to fewer groups.
FEWEST, USUAL, MOST = 16, 256, 1 << 16
#: Members of a cell's block, and rows of cells with the same least class that are kept together.
BLOCK, TOGETHER = 1500, 20_000
#: Points of a leaf in small trees and in others; a tree is small with so many points, and its queries go down together.
LEAF, WIDE_LEAF, FAN, SMALL = 4, 16, 8, 64
#: Counts that a step down a tree compares at once.
COUNTS = 1 << 18
#: For components: classes found by one search that are all paired with it at once.
FEW = 8


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, and where each text's begin (and the last ends)."""
    g = sequences(w, k)
    ok = inside(w, k)
    text, h = w.text[: len(g)][ok], g[ok]
    size = np.diff(w.bounds)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):  # the whole sequence as one
        whole = [functools.reduce(joined, w.hash[a : a + n, None], np.array([n], U))[0] for a, n in zip(w.bounds[short], size[short], strict=True)]
        text, h = np.concatenate([text, short]), np.concatenate([h, np.array(whole, U)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    text, h = text[new], h[new]
    return h, np.searchsorted(text, np.arange(w.n_texts + 1))


def _groups(n: int) -> int:
    want = max(min(2 * n, USUAL), n // 4, FEWEST)
    return min(1 << (want - 1).bit_length(), MOST)


def counts(h: np.ndarray) -> bytes:
    """The point of a set: its counts by group, two in a byte where they fit, else in one or four bytes each."""
    groups = _groups(len(h))
    n = np.bincount(((h >> U(20)) & U(groups - 1)).astype(np.int64), minlength=groups)
    most = n.max(initial=0)
    return (n[0::2] | n[1::2] << 4).astype(np.uint8).tobytes() if most < 16 else n.astype(np.uint8 if most < 256 else np.uint32).tobytes()


def point(data: bytes, n: int) -> np.ndarray:
    """The counts of a set of n elements."""
    groups = _groups(n)
    if len(data) == 4 * groups:
        return np.frombuffer(data, np.uint32)
    x = np.frombuffer(data, np.uint8)
    return x if len(data) == groups else np.stack([x & 15, x >> 4], axis=1).ravel()


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    """A point over fewer groups."""
    return v if len(v) == groups else v.reshape(-1, groups).sum(axis=0, dtype=np.int64)


def enough(shared, sizes, need: int = NEED, of: int = OF):
    """Whether of * shared >= need * (size of the union), sizes being the sum of both sizes."""
    return (of + need) * shared >= need * sizes


class CountTree:
    """An R-tree of points, packed by sorting (sort-tile-recursive over size and two coarse coordinates)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        half = points.shape[1] // 2
        self.leaf = LEAF if len(sizes) <= SMALL else WIDE_LEAF
        slab = max(1, int(np.ceil(np.sqrt(len(sizes) / self.leaf)))) * self.leaf
        by_size = np.argsort(sizes, kind="stable")
        left = points[:, :half].sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((left[by_size], np.arange(len(sizes)) // slab))
        self.order = by_size[self.order]
        self.points, self.sizes = points[self.order], sizes[self.order]
        corner, least = self.points, self.sizes
        self.levels = []
        width = self.leaf
        while True:
            starts = np.arange(0, len(corner), width)
            corner, least = np.maximum.reduceat(corner, starts, axis=0), np.minimum.reduceat(least, starts)
            self.levels.append((corner, least))
            if len(corner) <= FAN:
                break
            width = FAN

    def search(self, queries: np.ndarray, sizes: np.ndarray | int, need: int, of: int) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
        """All (query, point), as numbers given to the tree, whose bound is enough, in order of queries. The queries go down together: a step
        tests what is left of them against nodes of one level, and the children of those whose bound is enough are next. Of a single query, no row of several, the points alone."""
        if queries.ndim == 1:
            return self.search(queries[None], np.asarray([sizes]), need, of)[1]
        top = len(self.levels[-1][0])
        query, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            ok = _bounds(queries, query, corner, node, sizes, least, need, of)
            width = FAN if depth else self.leaf
            query, node = np.repeat(query[ok], width), (node[ok][:, None] * width + np.arange(width)).ravel()
            there = node < len(self.levels[depth - 1][0] if depth else self.points)
            query, node = query[there], node[there]
        ok = _bounds(queries, query, self.points, node, sizes, self.sizes, need, of)
        return query[ok], self.order[node[ok]]


def _bounds(queries: np.ndarray, query: np.ndarray, corners: np.ndarray, node: np.ndarray, sizes: np.ndarray, least: np.ndarray, need: int, of: int) -> np.ndarray:
    """Which of the pairs (query, node) may be similar, worked out for a bounded number of counts at once."""
    step = max(1, COUNTS // max(corners.shape[1], 1))
    ok = np.empty(len(query), bool)
    for i in range(0, len(query), step):
        q, n = query[i : i + step], node[i : i + step]
        most = np.minimum(corners[n], queries[0] if len(queries) == 1 else queries[q]).sum(axis=1, dtype=np.int64)
        ok[i : i + step] = enough(most, sizes[q] + least[n], need, of)
    return ok


def searches(points: np.ndarray, sizes: np.ndarray, at: np.ndarray, ask: np.ndarray, need: int, of: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the points numbered `ask` those of the points numbered `at` whose bound is enough, found by a tree."""
    if not len(at) or not len(ask):
        return
    tree = CountTree(points[at], sizes[at])
    for some in np.array_split(ask, -(-len(ask) // SMALL) if len(at) <= SMALL else len(ask)):
        query, found = tree.search(points[some], sizes[some], need, of)
        ends = np.searchsorted(query, np.arange(len(some) + 1))
        yield from ((int(i), at[found[a:b]]) for i, a, b in zip(some, ends[:-1], ends[1:], strict=True))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, kind))


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, whatever their order."""
    n = np.array([len(h)], U)
    return tuple(int((mix(h ^ U(seed)).sum(dtype=U) ^ mix(n + U(seed)))[0].view(np.int64)) for seed in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D))


def sketches(rows: DataFrame, shingle: int, need: int, of: int) -> DataFrame:
    """(doc_id, k1, k2, n, prefix array<long>, point binary) of rows (doc_id, text): k1 and k2 are a hash of the whole set."""
    def sketch(b: pa.RecordBatch):
        for at, w in chunks(b.column(1), LOWER):
            h, bounds = shingle_sets(w, shingle)
            sizes = np.diff(bounds)
            prefixes, points, keys = [], [], []
            for a, n in zip(bounds[:-1], sizes, strict=True):
                own = h[a : a + n]
                n = int(n)
                prefixes.append(own[: n - -(-n * need // of) + 1].view(np.int64))
                points.append(counts(own) if n else b"")
                keys.append(set_key(own) if n else (None, None))
            yield {
                "doc_id": b.column(0).slice(at, w.n_texts), "k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()),
                "n": pa.array(sizes, pa.int64()), "prefix": _lists(prefixes, pa.int64()), "point": pa.array(points, pa.binary()),
            }

    return arrow_map(rows, "doc_id long, k1 long, k2 long, n long, prefix array<long>, point binary", sketch)


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, need: int, of: int, name: str) -> DataFrame:
    """Of the pairs (a, b) of keys those that are similar, by their whole sets: (a, b, shared, n_a, n_b). Only the
    texts of the classes in question are read into sets; a set moves once to its pairs and once to its partner."""
    pairs = written(pairs, f"{name}-pairs")
    asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    texts = rows.join(classes.join(asked, "key").select("key", "k1", "k2", F.col("first").alias("doc_id")), "doc_id").select("key", "k1", "k2", "text")

    def to_sets(b: pa.RecordBatch):
        for at, w in chunks(b.column(3), LOWER):
            h, bounds = shingle_sets(w, shingle)
            own = [h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            key, k1, k2 = (b.column(i).slice(at, w.n_texts).to_pylist() for i in range(3))
            # a row that shares its id with the class' first document but not its set is another class'
            same = [i for i, o in enumerate(own) if len(o) and set_key(o) == (k1[i], k2[i])]
            yield {"key": pa.array([key[i] for i in same], pa.int64()), "h": pa.array([own[i].tobytes() for i in same], pa.binary())}

    sets = written(arrow_map(texts, "key long, h binary", to_sets).dropDuplicates(["key"]), f"{name}-sets")
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("h").alias("h_b")), "b").join(sets.select(F.col("key").alias("a"), F.col("h").alias("h_a")), "a")

    def verify(b: pa.RecordBatch) -> dict:
        out = []
        for x, y, p, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
            at = np.searchsorted(p, q)  # both are in order
            shared = int((p[np.minimum(at, len(p) - 1)] == q).sum())
            if enough(shared, len(p) + len(q), need, of):
                out.append((x, y, shared, len(p), len(q)))
        return {k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "shared", "n_a", "n_b"), zip(*out, strict=True) if out else [()] * 5, strict=True)}

    links = written(arrow_map(both.select("a", "b", "h_a", "h_b"), "a long, b long, shared long, n_a long, n_b long", verify), f"{name}-links")
    dropped(sets)
    dropped(pairs)
    return links


def _cells(members: DataFrame) -> DataFrame:
    """members (s, key, n, component, smaller) of buckets with several components, dealt into cells: those of a size band with
    those of the next, and large ones again by pairs of blocks. upper: only to be paired with members that are not; these
    are the larger sets, and those whose hash s is not in the prefix that the smaller set of a pair needs."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(OF / NEED))).cast("int")
    sides = F.array(F.struct(band.alias("band"), (~F.col("smaller")).alias("upper")), F.struct((band - 1).alias("band"), F.lit(True).alias("upper")))
    dealt = members.select("s", "key", "n", "component", F.explode(sides).alias("x")).select("s", "key", "n", "component", "x.band", "x.upper")
    size = dealt.groupBy("s", "band").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(~F.col("upper"), 1)).alias("own"), F.min("component").alias("low"), F.max("component").alias("high"))
    size = size.where("m > 1 AND own > 0 AND low < high").select("s", "band", "low", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    # near copies meet in many cells with the same least class: these stay together, so that a task reports a
    # pair once, but in as many parts as their rows ask for
    parts = size.groupBy("low").agg(F.ceil(F.sum(F.col("m") * F.col("blocks")) / TOGETHER).alias("parts"))
    size = written(size.join(parts, "low"), "ngram-cell-sizes")
    dealt = hot_join(dealt, size, ["s", "band"], "m")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("s", "band", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.withColumn("cell", cell).withColumn("part", F.xxhash64("low", F.pmod("cell", F.col("parts"))))
    return dealt.select("part", "cell", "key", "n", "component", "upper", F.col("block").alias("own_block"), (F.col("block") == F.col("other")).alias("same"))


def _first_cells(classes: DataFrame) -> DataFrame:
    """Cells of the classes that share their least hash: each is in one, and the least class of each such bucket in all of
    the bucket's."""
    one = classes.select(F.element_at("prefix", 1).alias("s"), "key", "n")
    size = one.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "n")).alias("lead")).where("m > 1")
    size = written(size.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "ngram-first-sizes")
    dealt = hot_join(one, size, ["s"], "m").where("key <> lead.key").select("s", "key", "n", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    leads = size.select("s", "lead.key", "lead.n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cell = F.xxhash64("s", "block")
    return dealt.unionByName(leads).select(cell.alias("part"), cell.alias("cell"), "key", "n", F.col("key").alias("component"), F.lit(False).alias("upper"), F.lit(0).alias("own_block"), F.lit(True).alias("same"))


class Cell:
    """The members of a cell, in arrays."""

    def __init__(self, columns: dict[str, np.ndarray], raw: list[bytes], a: int, b: int):
        self.key, self.n, self.component, self.upper, self.block = (columns[c][a:b] for c in ("key", "n", "component", "upper", "own_block"))
        self.same = bool(columns["same"][a])
        self.raw = raw[a:b]

    def pairs(self, need: int, of: int, least: bool) -> tuple[list[tuple[int, int]], bool]:
        """The pairs of different components whose bound is enough, and whether some were left out. With `least`, a
        member that finds more than FEW is paired with the least of them alone."""
        key, component, upper = self.key, self.component, self.upper
        names, count = np.unique(component, return_counts=True)
        if len(names) == 1:
            return [], False
        raw = [point(x, int(k)) for x, k in zip(self.raw, self.n, strict=True)]
        groups = min(map(len, raw))
        points = np.array([folded(x, groups) for x in raw])
        points = points.astype(np.uint8 if points.max() < 256 else np.uint32)
        largest = component == names[count.argmax()] if count.max() > 1 else np.zeros(len(key), bool)
        rest, large = np.flatnonzero(~largest), np.flatnonzero(largest)
        out, open_ = [], False
        for i, found in searches(points, self.n, rest, rest[~upper[rest]], need, of):
            if len(found) < 2:  # itself
                continue
            found = found[(component[found] != component[i]) & (self.same | (self.block[found] != self.block[i]))]
            if least and len(found) > FEW:
                open_ = True
                sides = (found[upper[found]], found[~upper[found] & (key[found] < key[i])])
                found = [x[key[x].argmin()] for x in sides if len(x)]
            else:
                found = found[upper[found] | (key[found] > key[i])]
            out += [(i, j) for j in found]
        for i, found in searches(points, self.n, large, rest, need, of):
            found = found[(self.same | (self.block[found] != self.block[i])) & ~(upper[i] & upper[found])]
            if least and len(found) > FEW:
                open_ = True
                found = found[[key[found].argmin()]]
            out += [(i, j) for j in found]
        return [(min(int(key[i]), int(key[j])), max(int(key[i]), int(key[j]))) for i, j in out if key[i] != key[j]], open_


def _tree_pairs(cells: DataFrame, points: DataFrame, need: int, of: int, least: bool = False) -> DataFrame:
    """The pairs (a, b) of different components in a cell whose bound is enough, found by the cell's R-trees. With `least`
    some may be left out; then a row (cell, null) names each cell that has more."""
    rows = cells.join(points.select("key", "point"), "key").select("part", "cell", "key", "n", "component", "upper", "own_block", "same", "point")
    rows = rows.repartition("part").drop("part").sortWithinPartitions("cell")

    def search(batches):
        held, seen = None, set()

        def new(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            """Each pair once, as far as the task remembers: near copies meet in many cells."""
            if len(seen) > 300_000:
                seen.clear()
            out = []
            columns = {c: t[c].to_numpy() if t[c].type != pa.bool_() else np.array(t[c].to_pylist(), bool) for c in t.column_names if c != "point"}
            raw = t["point"].to_pylist()
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                found, open_ = Cell(columns, raw, a, b).pairs(need, of, least)
                out += [p for p in found if p not in seen and not seen.add(p)]
                if open_:
                    out.append((int(columns["cell"][a]), None))
            return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            if not t.num_rows:
                continue
            cell = t["cell"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
            yield new(t.slice(0, int(starts[-1])), starts)
            held = t.slice(int(starts[-1])).combine_chunks()
        if held is not None:
            yield new(held, np.array([0, held.num_rows]))

    return rows.mapInArrow(search, "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, need: int = NEED, of: int = OF, every_link: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables. Members (doc_id, n_shingles, component_id, n_links): one row per row of docs, component_id being the
    smallest id reachable by links, n_links how many other classes the row's class links with. Links (a, b, shared, n_a,
    n_b): every verified pair of classes, by the classes' smallest ids. Without every_link, for callers that need components
    only, links are those that join the components, and n_links counts these.

    Words are runs `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a set is the distinct sequences of `shingle` words, with
    fewer words the whole sequence. Two rows link if of * intersection >= need * union. Null, empty and blank texts
    have no set and link with nothing; nor do rows without an id, whose component is null. Very long texts are read whole. Rows
    that share an id are judged one by one. An empty table gives empty ones; other columns are ignored. Shingles are
    compared as 64-bit hashes, whole sets of them as 128-bit ones.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = written(sketches(rows, shingle, need, of), "ngram-sketches")
    all_rows = written(whole.select("doc_id", "k1", "k2", "n"), "ngram-rows")
    linked = whole.where("k1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("point").alias("point"), F.any_value("prefix").alias("prefix"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "ngram-classes")
    dropped(whole)

    hashes = classes.select(F.posexplode("prefix").alias("at", "s"), "key", "n")
    # of two similar sets the smaller, of n, shares at least 2 * need * n / (need + of)
    hashes = hashes.select("s", "key", "n", F.expr(f"at <= n - ({2 * need} * n + {need + of - 1}) div {need + of}").alias("smaller"))
    buckets = hashes.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.count_if("smaller").alias("own")).where("m > 1 AND own > 0").select("s", "m")
    buckets = written(buckets, "ngram-buckets")
    shared = hot_join(hashes, buckets, ["s"], "m").select("s", "key", "n", "smaller")
    points = classes.select("key", "point")
    edges = lambda links: links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if every_link:
        members = written(shared.withColumn("component", F.col("key")), "ngram-members")
        cells = written(_cells(members), "ngram-cells")
        links = _verified(_tree_pairs(cells, points, need, of), rows, classes, shingle, need, of, "ngram")
        dropped(members)
    else:
        first = _tree_pairs(_first_cells(classes), points, need, of, least=True).where("b IS NOT NULL")
        links = _verified(first, rows, classes, shingle, need, of, "ngram-first")
        joined_by = lambda table, found: table.join(found, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key")).drop("node")
        members = written(joined_by(shared, components(edges(links), "ngram-first-components")), "ngram-members")
        cells = written(_cells(members), "ngram-cells")
        dropped(members)
        tried = written(_tree_pairs(cells, points, need, of, least=True), "ngram-least")
        links = links.unionByName(_verified(tried.where("b IS NOT NULL"), rows, classes, shingle, need, of, "ngram-least"))
        still = tried.where("b IS NULL").select(F.col("a").alias("cell"))
        rest = joined_by(cells.join(still, "cell", "left_semi").drop("component"), components(edges(links), "ngram-least-components"))
        more = _tree_pairs(rest, points, need, of).join(tried, ["a", "b"], "left_anti")
        links = links.unionByName(_verified(more, rows, classes, shingle, need, of, "ngram-open"))
    dropped(buckets)
    dropped(cells)

    found = components(edges(links), "ngram-components")
    ends = links.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("n_links"))
    first = classes.select("key", "k1", "k2", "first")
    by = first.join(found, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key")).join(ends, F.col("key") == F.col("end"), "left")
    smallest = by.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = by.join(smallest, "component").select("k1", "k2", "component_id", "n_links")
    out = all_rows.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles")).join(ids, ["k1", "k2"], "left")
    has = F.col("doc_id").isNotNull()
    members = out.select("doc_id", "n_shingles", F.when(has, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(has, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    side = lambda x: first.select(F.col("key").alias(x), F.col("first").alias(f"first_{x}"))
    links = links.join(side("a"), "a").join(side("b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"), "shared", F.when(F.col("first_a") <= F.col("first_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("first_a") <= F.col("first_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    return members, links


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(words[p : p + 4], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
"""
