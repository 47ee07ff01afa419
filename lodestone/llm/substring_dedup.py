"""Repeated passages found by phrase automata, and the removal of their later occurrences.

1. Phrases. A word's letter is one byte of its hash, and PHRASE letters are a phrase. Of every WINDOW consecutive words
   the phrase with the least hash is the anchor, so equal windows in two documents have an anchor in common. Anchors that
   occur in two documents or more are confirmed.
2. Automata. Confirmed phrases are dealt into shards of about PHRASES, those first seen in one document together. Each
   shard compiles an Aho-Corasick automaton and streams its documents through it: all that have an anchor among the
   shard's phrases, in parts of about SHARD_BYTES, each with its copy of the phrases. Only the automaton tells where
   phrases occur. Consecutive windows with one anchor at such a place are a run.
3. Runs. Equal runs in a larger document go as a whole. Runs that no smaller document has are cut into blocks of up to
   BLOCK windows, by their distance from the anchor; equal blocks go alike, and only the windows of the rest are looked up one
   by one.

So copies cost a row a run, and windows are only listed for different texts. Runs and windows are compared by 128-bit
hashes of their words. Groups are only ever minima with partial sums before the shuffle, and keys with a thousandth of
all rows or more are joined by broadcast, so a passage in a third of all documents does not gather in one task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, hot_join, written
from lodestone.llm.wordhash import U, Words, chunks, inside, mix, sequences, sliding

WINDOW, PHRASE = 50, 8
#: Phrases of a shard, and bytes of text of a part of it, about.
PHRASES, SHARD_BYTES = 50_000, 32 << 20
#: Windows of a block.
BLOCK = 8
TOP = U(0xFFFFFFFFFFFFFFFF)


def _letters(w: Words) -> np.ndarray:
    return (w.hash & U(255)).astype(np.uint8)


def _codes(letters: np.ndarray) -> np.ndarray:
    """The phrase from each word on: its letters in the bytes of a number, the first the lowest."""
    n = len(letters) - PHRASE + 1
    return np.ndarray((n,), "<u8", np.ascontiguousarray(letters), 0, (1,)) if n > 0 else np.zeros(0, U)


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases from each word on, their hashes, and of each window the least hash and whether it is in one text."""
    code = _codes(_letters(w)).astype(U)
    rank = mix(code ^ U(0x5851F42D4C957F2D))
    ok = inside(w, window)
    return code, rank, sliding(rank, window - PHRASE + 1), ok


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of each text: (text, code)."""
    code, rank, least, ok = _windows(w, window)
    reach = window - PHRASE + 1
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, U)
    # a phrase is an anchor if it is the greatest of the least of the windows over it
    edge = np.zeros(reach - 1, U)
    covered = sliding(np.concatenate([edge > 0, ok, edge > 0]), reach, np.maximum)
    anchor = covered & (sliding(np.concatenate([edge, np.where(ok, least, U(0)), edge]), reach, np.maximum) == rank)
    both = np.unique(np.rec.fromarrays([w.text[: len(code)][anchor], code[anchor]], names="t,c"))
    return both.t, both.c


class Automaton:
    """An Aho-Corasick automaton of phrases over letters."""

    def __init__(self, codes: np.ndarray):
        import ahocorasick

        self._found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        data = codes.astype("<u8").tobytes().decode("latin-1")
        for i in range(0, len(data), PHRASE):
            self._found.add_word(data[i : i + PHRASE], 1)
        self._found.make_automaton()

    def __call__(self, w: Words) -> np.ndarray:
        """Whether a phrase begins at each word and ends in the same text."""
        at = np.zeros(max(len(w.hash) - PHRASE + 1, 0), bool)
        if len(at) and len(self._found):
            ends = [end for end, _ in self._found.iter(_letters(w).tobytes().decode("latin-1"))]
            at[np.array(ends, np.int64) - (PHRASE - 1)] = True
        return at & inside(w, PHRASE)


def runs_of(w: Words, marked: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor that stands where `marked`: first window, number of windows, two hashes."""
    _, rank, least, ok = _windows(w, window)
    none = np.zeros(0, np.int64)
    if not len(ok):
        return none, none, none, none
    reach = window - PHRASE + 1
    hit = ok & (sliding(np.where(marked, rank, TOP), reach) == least) & sliding(marked, reach, np.maximum)
    at = np.flatnonzero(hit)
    if not len(at):
        return none, none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (w.text[at[1:]] != w.text[at[:-1]])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    place = mix((np.arange(len(at)) - np.repeat(begin, n)).astype(U) + U(1))
    sums = [np.add.reduceat(mix(sequences(w, window, w.hashes(lane))[at] ^ place), begin).view(np.int64) for lane in (0, 1)]
    return at[begin], n, *sums


def confirmed_phrases(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """For rows (doc_id, text): the anchors of each document (code, doc_id, size in bytes), and the confirmed ones (code,
    first document, n)."""

    def anchors(b: pa.RecordBatch):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for at, w in chunks(b.column(1)):
            text, code = _anchors(w, window)
            size = np.bincount(w.text, w.end - w.start + 1, minlength=w.n_texts).astype(np.int64)
            yield {"code": pa.array(code.view(np.int64), pa.int64()), "doc_id": pa.array(ids[at + text], pa.int64()), "size": pa.array(size[text], pa.int64())}

    found = written(arrow_map(rows.where("doc_id IS NOT NULL").select("doc_id", "text"), "code long, doc_id long, size long", anchors), "substring-anchors")
    by = found.groupBy("code").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    return found, written(by.where("first < last").select("code", "first", "n"), "substring-phrases")


def shards(rows: DataFrame, window: int, phrases_of_shard: int, shard_bytes: int) -> DataFrame:
    """(shard, part, kind, code, doc_id, key, text): the phrases (kind 0) and documents (kind 1) of each part of a shard."""
    found, phrases = confirmed_phrases(rows, window)
    n = max(1, -(-phrases.count() // phrases_of_shard))
    phrases = phrases.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(n)).cast("int"))
    routed = hot_join(found, phrases, ["code"], "n").groupBy("doc_id", "shard").agg(F.max("size").alias("size"))
    routed = written(routed, "substring-routed")
    parts = routed.groupBy("shard").agg(F.ceil(F.sum("size") / shard_bytes).cast("int").alias("parts"))
    parts = written(parts, "substring-parts")  # one row a shard
    given = phrases.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "code", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("text"))
    routed = routed.join(parts, "shard").select("doc_id", "shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    texts = rows.join(routed, "doc_id").select("shard", "part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("code"), "doc_id", "key", "text")
    return given.unionByName(texts).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")


def located_runs(dealt: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, start, n, h1, h2): the runs at places where the shard's automaton finds a phrase, for rows of `shards`."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, automaton = None, [], None
        for b in batches:
            shard, part, kind = (b.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if i == j:
                    continue
                if (shard[i], part[i]) != now:
                    now, codes, automaton = (shard[i], part[i]), [], None
                if kind[i] == 0:
                    codes.append(b.column(3).slice(i, j - i).to_numpy().view(U))
                    continue
                if automaton is None:
                    automaton = Automaton(np.concatenate(codes) if codes else np.zeros(0, U))
                ids, keys = (b.column(k).slice(i, j - i).to_numpy() for k in (4, 5))
                for at, w in chunks(b.column(6).slice(i, j - i)):
                    start, n, h1, h2 = runs_of(w, automaton(w), window)
                    text = w.text[start] if len(start) else start
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[at + text], pa.int64()), "key": pa.array(keys[at + text], pa.int64()),
                        "start": pa.array(start - w.bounds[text], pa.int32()), "n": pa.array(n, pa.int32()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()),
                    })

    return dealt.mapInArrow(stream, "doc_id long, key long, start int, n int, h1 long, h2 long")


def _blocks(runs: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, start, n, h1, h2, w1, w2) of the blocks of runs (doc_id, key, start, n): two hashes of the block, and
    arrays of two hashes of each of its windows."""
    by = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # at most a document's
    reach = window - PHRASE + 1

    def hashes(b: pa.RecordBatch):
        ids, keys = b.column(0), b.column(1)
        for at, w in chunks(b.column(2)):
            own = b.column(3).slice(at, w.n_texts)
            flat = own.flatten()
            start, n = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            text = np.repeat(np.arange(w.n_texts), [len(x) for x in own])
            if not len(text):
                continue
            _, rank, least, _ = _windows(w, window)
            first = w.bounds[text] + start
            anchor = first + (rank[first[:, None] + np.arange(reach)] == least[first][:, None]).argmax(axis=1)
            which = np.repeat(np.arange(len(start)), n)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            place = first[which] + inner
            block = (anchor[which] - place) // BLOCK
            new = np.ones(len(which), bool)
            new[1:] = (which[1:] != which[:-1]) | (block[1:] != block[:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(which)))
            salt = mix((np.arange(len(which)) - np.repeat(begin, size)).astype(U) + U(1))
            lanes = [sequences(w, window, w.hashes(lane))[place] for lane in (0, 1)]
            h1, h2 = (np.add.reduceat(mix(x ^ salt), begin).view(np.int64) for x in lanes)
            ends = pa.array(np.append(begin, len(which)), pa.int32())
            of = pa.array(text[which[begin]])
            yield {
                "doc_id": ids.slice(at, w.n_texts).take(of), "key": keys.slice(at, w.n_texts).take(of),
                "start": pa.array((start[which] + inner)[begin], pa.int32()), "n": pa.array(size, pa.int32()), "h1": pa.array(h1), "h2": pa.array(h2),
                **{f"w{k + 1}": pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))) for k, x in enumerate(lanes)},
            }

    texts = rows.join(by, ["doc_id", "key"]).select("doc_id", "key", "text", "runs")
    return arrow_map(texts, "doc_id long, key long, start int, n int, h1 long, h2 long, w1 array<long>, w2 array<long>", hashes)


def _firsts(found: DataFrame, name: str) -> DataFrame:
    """found with `first`: the smallest document that has the same hashes, itself where it is the only one."""
    keys = ["h1", "h2"]
    again = written(found.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"), f"{name}-firsts")
    return hot_join(found, again, keys, "times", "left").withColumn("first", F.coalesce("first", "doc_id"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, phrases_of_shard: int = PHRASES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed array<struct<start, n>>) for every row of docs.

    Words are runs `[^\\x20\\x09-\\x0D]+` of the whole text, unchanged. A word is removed if a window of `window` words
    over it has a word sequence that also starts in a document with a smaller id; windows are judged on the input.
    removed: places at which such windows start, as runs of n. kept_sha256: of the kept words joined by one blank.

    A null text has no words; texts shorter than a window lose nothing; very long texts are worked on whole. A null id is
    not smaller than any, and nothing is smaller than it: such rows stay whole. Rows that share an id are the same document:
    none is smaller, each is judged with its own text. An empty table gives an empty one; other columns are ignored.
    phrases_of_shard and shard_bytes set the size of tasks, never a result.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    runs = written(located_runs(shards(rows, window, phrases_of_shard, shard_bytes), window), "substring-runs")
    judged = written(_firsts(runs, "substring-runs").select("doc_id", "key", "start", "n", "first"), "substring-judged")
    place = ["doc_id", "key", "start", "n"]
    blocks = _firsts(written(_blocks(judged.where("doc_id = first"), rows, window), "substring-blocks"), "substring-blocks")
    each = F.posexplode(F.arrays_zip("w1", "w2")).alias("k", "w")
    windows = blocks.where("doc_id = first").select("doc_id", "key", "start", each)
    windows = written(windows.select("doc_id", "key", (F.col("start") + F.col("k")).alias("start"), F.lit(1).alias("n"), F.col("w.w1").alias("h1"), F.col("w.w2").alias("h2")), "substring-windows")
    levels = [judged, blocks, _firsts(windows, "substring-windows")]
    gone = functools.reduce(DataFrame.unionByName, [x.where("doc_id > first").select(*place) for x in levels])
    removed = gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("removed"))
    removed = written(removed, "substring-removed").withColumnsRenamed({"doc_id": "d", "key": "k"})
    both = rows.join(removed, (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "removed")

    def cut(b: pa.RecordBatch) -> dict:
        n_words, n_removed, digests = [], [], []
        for t, gone in zip(b.column(1), b.column(2), strict=True):
            words = t.as_py().encode().split()
            n_words.append(len(words))
            keep = None
            if gone.is_valid:
                start, n = (gone.values.field(k).to_numpy() for k in (0, 1))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, np.minimum(start + n + (window - 1), len(words)), -1)
                keep = np.cumsum(edge[:-1]) == 0
            n_removed.append(0 if keep is None else int((~keep).sum()))
            digests.append(hashlib.sha256(b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep)])).hexdigest())
        return {"doc_id": b.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "removed": b.column(2)}

    return arrow_map(both, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: int, n: int>>", cut)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, p, md5_number(array_to_string(words[p : p + 49], ' ')) AS h FROM g),
first AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
hit AS (SELECT doc_id, list(p) AS ps FROM h JOIN first USING (h) WHERE doc_id > first GROUP BY doc_id),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50))))) AS gone FROM hit),
kept AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i))) END, ' ') AS kept
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM kept
"""
