"""Phrase collocations by depth-limited count tries.

1. Each task turns its documents into count tries (a shard is some 500,000 words; a task may make several): a node for
   every phrase of 1 to `max_words` words within a piece, with its count. A trie is serialised in pre-order, its words in
   byte order, in blocks of bounded size.
2. Blocks are dealt by prefix range. Borders come from a bounded sample of the blocks' first phrases and set the balance
   only; a range may begin at any depth, so that a frequent first word is split. A block across a border is cut there, and
   the nodes on a border's own path (its left parts) are also sent to the ranges behind it.
3. A range's blocks arrive sorted by first phrase and are k-way merged: what lies before the next block's first phrase is
   final. Walks down the merged trie give the counts of left parts.
4. The nodes that occur often enough form the pruned trie, a table. Suffix links (a phrase without its first words, a node of
   it again) give right parts. They are a join; targets with very many links are broadcast, at most HOT of them.

Rows: a null text has no words, a null lang counts as `und`, as do equal documents each time they occur. No words, or no
rows, give no phrases. Texts of any length are taken whole. Extra columns are ignored. Phrases of equal score and count are
ranked by their bytes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import hot_join, written

#: A-Z in lower case, piece ends as \n, tabs as blanks.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Words of a block are joined by \n; depth is a byte a node, word two, counts four or eight.
BLOCKS = "lang string, first array<binary>, last array<binary>, n long, words binary, depth binary, word binary, counts binary"
NODES = "lang string, words array<string>, a long, lefts array<long>"


@dataclass(frozen=True)
class Sizes:
    """Bounds of memory. They set cost and balance, never a result."""

    #: Words of a shard's trie, nodes of a block, nodes held before they are merged, nodes of a range, ranges at most.
    shard: int = 500_000
    block: int = 4_096
    pending: int = 300_000
    range: int = 500_000
    ranges: int = 8_192
    #: Bytes of text that are split at once, and of a word in a border.
    text: int = 2_000_000
    border: int = 64


def _words(texts: list[bytes]) -> pa.Array:
    """The words of texts in order, with \\n between pieces."""
    blob = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    words = pc.split_pattern(pa.array([blob], pa.large_binary()), b" ").flatten()
    return words.filter(pc.not_equal(pc.binary_length(words), 0))


def _counted(columns: list[np.ndarray], counts: np.ndarray | None, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns (values below size) in order, with the sums of their counts (None: 1 each)."""
    n = len(columns[0])
    if n == 0:
        return columns, np.zeros(0, np.int64)
    if size ** len(columns) < 2**63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * size + c
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        return _unpacked(key, counts, len(columns), size)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.r_[at, n]) if counts is None else np.add.reduceat(counts[order], at)


def _unpacked(key: np.ndarray, counts: np.ndarray | None, columns: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """As _counted, of sorted rows that are packed into one number each."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[at, len(key)]) if counts is None else np.add.reduceat(counts, at)
    rest, out = key[at], []
    for _ in range(columns):
        rest, c = np.divmod(rest, size)
        out.append(c.astype(np.int32 if size < 2**31 else np.int64))
    return out[::-1], counts


class _Trie:
    """Sorted paths (columns of word numbers from 1, 0 behind their end) over words in byte order, with counts."""

    def __init__(self, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray):
        self.words, self.columns, self.counts = words, columns, counts
        self.depth = sum((c > 0).astype(np.int32) for c in columns) if len(counts) else np.zeros(0, np.int32)

    @staticmethod
    def of(words: pa.ChunkedArray, max_words: int) -> _Trie:
        """The count trie of words with \\n between pieces."""
        encoded = words.unify_dictionaries().combine_chunks()
        encoded = encoded.chunk(0) if isinstance(encoded, pa.ChunkedArray) else encoded
        known = encoded.dictionary
        order = pc.sort_indices(known).to_numpy()
        number = np.empty(len(known) + 1, np.int64)
        number[order] = np.arange(1, len(known) + 1)
        ids = number[encoded.indices.to_numpy(zero_copy_only=False)]
        end = pc.index(known, pa.scalar(b"\n", known.type)).as_py()
        if end >= 0:
            ids[ids == number[end]] = 0
        # breaks after the last word, so that windows never leave the array
        ids = np.r_[ids, np.zeros(max_words, np.int64)]
        n, size, whole, parts = len(ids) - max_words, len(known) + 1, True, []
        for d in range(max_words):
            whole = whole & (ids[d : d + n] > 0)
            parts.append(np.flatnonzero(whole))
        words = known.take(pa.array(order)).cast(pa.large_binary())
        if size**max_words < 2**63:
            keys = np.empty(sum(map(len, parts)), np.int64)
            low = 0
            for d, at in enumerate(parts):
                key = ids[at]
                for k in range(1, max_words):
                    key *= size
                    if k <= d:
                        key += ids[at + k]
                keys[low : low + len(at)] = key
                low += len(at)
            keys.sort()
            return _Trie(words, *_unpacked(keys, None, max_words, size))
        columns = [np.concatenate([ids[at + k] if k <= d else np.zeros(len(at), np.int64) for d, at in enumerate(parts)]) for k in range(max_words)]
        return _Trie(words, *_counted(columns, None, size))

    @staticmethod
    def merged(tries: list[_Trie]) -> _Trie:
        encoded = pa.concat_arrays([t.words for t in tries]).dictionary_encode()
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(1, len(order) + 1)
        number, starts = number[encoded.indices.to_numpy()], np.cumsum([0, *(len(t.words) for t in tries)])
        # a path's word numbers, moved behind those of the tries before, index all tries' words; 0 stays 0
        number = np.r_[0, number]
        columns = [np.concatenate([number[np.where(t.columns[k] > 0, t.columns[k] + at, 0)] for t, at in zip(tries, starts, strict=False)]) for k in range(len(tries[0].columns))]
        return _Trie(encoded.dictionary.take(pa.array(order)), *_counted(columns, np.concatenate([t.counts for t in tries]), len(order) + 1))

    def part(self, low: int, high: int) -> _Trie:
        return _Trie(self.words, [c[low:high] for c in self.columns], self.counts[low:high])

    def path(self, i: int) -> list[bytes]:
        return [self.words[int(c[i]) - 1].as_py() for c in self.columns if c[i]]

    def before(self, path: list[bytes]) -> int:
        """How many paths are smaller than path."""
        low, high = 0, len(self.counts)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.path(middle) < path else (low, middle)
        return low

    def block(self, lang: str) -> dict:
        """The nodes in pre-order: depth, word and count of each, behind the first one's left parts with count 0."""
        lead = int(self.depth[0]) - 1
        depth = np.r_[np.arange(1, lead + 1), self.depth].astype(np.uint8)
        own = np.r_[[c[0] for c in self.columns[:lead]], np.stack(self.columns, 1)[np.arange(len(self.counts)), self.depth - 1]].astype(np.int64)
        used, word = np.unique(own, return_inverse=True)
        counts = np.r_[np.zeros(lead, np.int64), self.counts]
        words = self.words.take(pa.array(used - 1))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b"\n")[0].as_py()
        small = np.int32 if counts.max() < 2**31 else np.int64
        return {"lang": lang, "first": self.path(0), "last": self.path(len(self.counts) - 1), "n": len(self.counts), "words": joined, "depth": depth.tobytes(), "word": word.astype(np.uint16).tobytes(), "counts": counts.astype(small).tobytes()}

    @staticmethod
    def read(row: dict, max_words: int) -> _Trie:
        depth = np.frombuffer(row["depth"], np.uint8).astype(np.int64)
        word = np.frombuffer(row["word"], np.uint16).astype(np.int64) + 1
        counts = np.frombuffer(row["counts"], np.int32 if len(row["counts"]) == 4 * len(depth) else np.int64).astype(np.int64)
        columns = []
        for k in range(1, max_words + 1):
            at = np.maximum.accumulate(np.where(depth == k, np.arange(len(depth)), -1))
            columns.append(np.where(depth >= k, word[np.maximum(at, 0)], 0))
        real = counts > 0
        words = pc.split_pattern(pa.array([row["words"]], pa.large_binary()), b"\n").flatten()
        return _Trie(words, [c[real] for c in columns], counts[real])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


_BLOCK = [("lang", pa.string()), ("first", pa.list_(pa.binary())), ("last", pa.list_(pa.binary())), ("n", pa.int64()), ("words", pa.binary()), ("depth", pa.binary()), ("word", pa.binary()), ("counts", pa.binary())]
_NODE = [("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64()), ("lefts", pa.list_(pa.int64()))]


def shard_tries(docs: DataFrame, max_words: int, sizes: Sizes) -> DataFrame:
    """The serialised tries of docs (BLOCKS)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        words: dict[str, int] = {}
        texts: dict[str, list[bytes]] = {}
        long: dict[str, int] = {}

        def split(lang: str) -> None:
            found = _words(texts.pop(lang))
            long.pop(lang)
            held.setdefault(lang, []).append(found.dictionary_encode())
            held[lang].append(pa.array([b"\n"], pa.large_binary()).dictionary_encode())
            words[lang] = words.get(lang, 0) + len(found)

        def flushed(lang: str) -> Iterator[pa.RecordBatch]:
            trie = _Trie.of(pa.chunked_array(held.pop(lang)), max_words)
            words.pop(lang)
            pa.default_memory_pool().release_unused()
            for low in range(0, len(trie.counts), sizes.block):
                yield _batch([trie.part(low, low + sizes.block).block(lang)], pa.schema(_BLOCK))

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                if text.is_valid:
                    lang, data = lang.as_py() or "", text.as_buffer().to_pybytes()
                    texts.setdefault(lang, []).append(data)
                    long[lang] = long.get(lang, 0) + len(data)
                    # sums over languages are bounded, not each one's share
                    for x in list(texts) if sum(long.values()) >= 4 * sizes.text else [lang] if long[lang] >= sizes.text else []:
                        split(x)
                    if sum(words.values()) >= sizes.shard:
                        for x in list(held):
                            yield from flushed(x)
        for lang in list(texts):
            split(lang)
        for lang in list(held):
            yield from flushed(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where("text IS NOT NULL").mapInArrow(build, BLOCKS)


def _borders(blocks: DataFrame, sizes: Sizes) -> list[tuple[str, list[bytes]]]:
    """Where ranges begin but the first: (lang, phrase), ascending. A sample of 16 block beginnings a range, words cut."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = min(max(-(-total // sizes.range), 1), sizes.ranges)
    if ranges == 1:
        return []
    cut = F.transform("first", lambda w: F.substring(w, 1, sizes.border))
    sample = blocks.select(F.encode("lang", "utf-8").alias("lang"), cut.alias("first"), F.xxhash64("lang", "first", "last", "n").alias("h")).orderBy("h").limit(16 * ranges).collect()
    firsts = sorted((bytes(r.lang), [bytes(w) for w in r["first"]]) for r in sample)
    picked = [firsts[len(firsts) * k // ranges] for k in range(1, ranges)]
    return [x for k, x in enumerate(picked) if k == 0 or x != picked[k - 1]]


def dealt(blocks: DataFrame, borders: list[tuple[bytes, list[bytes]]], max_words: int) -> DataFrame:
    """blocks with the range_id they belong to, cut at borders; left parts of a border also in the ranges behind it."""
    schema = pa.schema([*_BLOCK, ("range_id", pa.int64())])
    # left parts of borders in order, with the ranges that need them
    needed: dict[tuple[bytes, tuple[bytes, ...]], list[int]] = {}
    for k, (lang, path) in enumerate(borders):
        for d in range(1, len(path)):
            needed.setdefault((lang, tuple(path[:d])), []).append(k + 1)
    parts = sorted(needed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lang = row["lang"].encode()
            low, high = bisect.bisect_right(borders, (lang, row["first"])), bisect.bisect_right(borders, (lang, row["last"]))
            wanted = parts[bisect.bisect_left(parts, (lang, tuple(row["first"]))) : bisect.bisect_right(parts, (lang, tuple(row["last"])))]
            if low == high and not wanted:
                yield _batch([row | {"range_id": low}], schema)
                continue
            trie = _Trie.read(row, max_words)
            at = [0, *(trie.before(borders[k][1]) if borders[k][0] == lang else 0 for k in range(low, high)), len(trie.counts)]
            for k in range(len(at) - 1):
                if at[k] < at[k + 1]:
                    yield _batch([trie.part(at[k], at[k + 1]).block(row["lang"]) | {"range_id": low + k}], schema)
            for _, path in wanted:
                i = trie.before(list(path))
                if i < len(trie.counts) and trie.path(i) == list(path):
                    home = bisect.bisect_right(borders, (lang, list(path)))
                    one = trie.part(i, i + 1).block(row["lang"])
                    for k in needed[(lang, path)]:
                        if k != home:
                            yield _batch([one | {"range_id": k}], schema)

    return blocks.mapInArrow(deal, BLOCKS + ", range_id long")


def merged(blocks: DataFrame, borders: list[tuple[bytes, list[bytes]]], max_words: int, min_count: int, sizes: Sizes) -> DataFrame:
    """The pruned trie (NODES) of blocks dealt into ranges: phrases with their count a and those of their left parts, of 1
    word and more. Rows without words hold a language's number of words in a range."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Trie] = []
        at: tuple[int, str] | None = None
        stack, total, floor = [0] * max_words, 0, None

        def final(trie: _Trie) -> Iterator[pa.RecordBatch]:
            nonlocal total
            if not len(trie.counts):
                return
            lefts = []
            for k in range(1, max_words):
                place = np.maximum.accumulate(np.where(trie.depth == k, np.arange(len(trie.depth)), -1))
                lefts.append(np.where(place >= 0, trie.counts[np.maximum(place, 0)], stack[k - 1]))
            own = trie.before(floor) if floor else 0
            total += int(trie.counts[own:][trie.depth[own:] == 1].sum())
            found = own + np.flatnonzero(trie.counts[own:] >= min_count)
            for low in range(0, len(found), 65_536):
                yield nodes(trie, lefts, found[low : low + 65_536])
            for k in range(1, max_words):
                stack[k - 1] = int(lefts[k - 1][-1])

        def nodes(trie: _Trie, lefts: list[np.ndarray], i: np.ndarray) -> pa.RecordBatch:
            ids, depth = np.stack([c[i] for c in trie.columns], 1), trie.depth[i]
            words = trie.words.take(pa.array(ids[ids > 0] - 1)).cast(pa.binary()).view(pa.string())
            left = np.stack([x[i] for x in lefts], 1)[np.arange(1, max_words) < depth[:, None]]
            columns = [pa.array([at[1]] * len(i), pa.string()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(depth)], pa.int32()), words)]
            columns += [pa.array(trie.counts[i]), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(depth - 1)], pa.int32()), pa.array(left))]
            return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_NODE))

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if at is not None:
                if held:
                    yield from final(_Trie.merged(held))
                yield _batch([{"lang": at[1], "words": [], "a": total, "lefts": []}], pa.schema(_NODE))
            held = []

        for row in _rows(batches):
            if at != (row["range_id"], row["lang"]):
                yield from done()
                at = (row["range_id"], row["lang"])
                stack, total = [0] * max_words, 0
                floor = next((p for lang, p in borders[at[0] - 1 : at[0]] if at[0] and lang == at[1].encode()), None)
            elif sum(len(t.counts) for t in held[1:]) >= max(sizes.pending, len(held[0].counts)):
                # so much is new that merging again costs a node its logarithm
                whole = _Trie.merged(held)
                sure = whole.before(row["first"])
                yield from final(whole.part(0, sure))
                held = [whole.part(sure, len(whole.counts))]
            held.append(_Trie.read(row, max_words))
        yield from done()

    cut = blocks.repartition(len(borders) + 1, "range_id").sortWithinPartitions("range_id", "lang", "first")
    return cut.mapInArrow(merge, NODES)


def phrase_trie(docs: DataFrame, max_words: int = 3, min_count: int = 10, sizes: Sizes = Sizes()) -> DataFrame:
    """The pruned count trie of docs (lang, text), a written table (NODES)."""
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases must have 2 words or more, and occur once at least")
    blocks = written(shard_tries(docs, max_words, sizes), "collocation-tries")
    borders = _borders(blocks, sizes)
    return written(merged(dealt(blocks, borders, max_words), borders, max_words, min_count, sizes), "collocation-nodes")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_percent: int = 50, top: int | None = 2000, sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases of 2 to max_words words that occur min_count times or more: the cut
    with the lowest score floor(10^6 * a * a / (l * r)), l and r the counts of both parts, n the language's words. Phrases
    inside a longer one with at least inside_percent of their count are dropped. The `top` first by score, a and phrase of
    each language, or all with top None."""
    nodes = phrase_trie(docs, max_words, min_count, sizes)
    sums = nodes.where("size(words) = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    found = nodes.where("size(words) > 1")
    # suffix links: cutting after k words leaves the phrase without them, a node of the trie that occurs as often at least
    k = F.posexplode("lefts").alias("k", "l")
    links = found.select("lang", "words", "a", k).withColumn("suffix", F.expr("slice(words, k + 2, size(words))"))
    ends = nodes.where("size(words) > 0").select("lang", F.col("words").alias("suffix"), F.col("a").alias("r"))
    linked = links.groupBy("lang", "suffix").agg(F.count(F.lit(1)).alias("asked")).join(ends, ["lang", "suffix"])
    linked = written(linked, "collocation-suffixes")
    cuts = hot_join(links, linked, ["lang", "suffix"], "asked")
    whole = "cast(a AS decimal(15, 0)) * cast(a AS decimal(15, 0)) * 1000000"
    cuts = cuts.withColumn("score", F.expr(f"({whole}) div (cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0)))"))
    best = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = best.select("lang", "words", "a", "cut.l", "cut.r", "cut.score")
    # phrases within longer ones, each with the largest count of those
    within = "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))"
    inner = found.where("size(words) > 2").select("lang", F.explode(F.expr(within)).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "words"], "left").where(f"longer IS NULL OR 100 * longer < {int(inside_percent)} * a")
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    if top is None:
        return kept.join(sums, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), spots AS (
  SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM pieces
), windows AS (
  SELECT lang, w1, lead(w1, 1) OVER next AS w2, lead(w1, 2) OVER next AS w3 FROM spots WINDOW next AS (PARTITION BY piece ORDER BY i)
), f1 AS (
  SELECT lang, w1, count(*) AS a FROM windows GROUP BY ALL
), f2 AS (
  SELECT lang, w1, w2, count(*) AS a FROM windows WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, w1, w2, w3, count(*) AS a FROM windows WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, 1 AS k, p.a, x.a AS l, y.a AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, 1, p.a, x.a, y.a
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, 2, p.a, x.a, y.a
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3
), best AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, a FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f3
  ) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
