"""Token counts by a map-side two-tier lookup.

A text is split at blanks and line ends; what is not known yet of the parts is split into pre-tokens by the
tokenizer's own rules. Pre-tokens are looked up in a broadcast hash table of frequent ones and their token counts (32,768 at most,
made once a worker), then in a cache of the Python worker, which runs the merges for what it has not met before. No pre-token
of the texts is shuffled, only the sums of a bounded sample. A worker also remembers the parts it has counted.

Counting part by part is exact for tokenizers that drop white space before matching, such as
word_bpe_49k.json: no match crosses a blank, and no normalisation joins characters across one.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map

#: Parts and pre-tokens longer than this are worked out each time and never kept.
LONGEST_KEPT = 64
#: Texts, about, whose pre-tokens the frequent ones are taken from, and how many are kept. They set the speed, never a result.
SAMPLE, KEPT = 2_000, 32_768
_tokenizers: dict = {}
_caches: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _split(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def _special(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


def pretokens(path: str, parts: list[str]) -> tuple[np.ndarray, list[str]]:
    """The pre-tokens of all parts in turn, and the number of the part that each is of."""
    t = _tokenizer(path)
    normal = [t.normalizer.normalize_str(p) for p in parts] if t.normalizer else parts
    starts = np.cumsum([0, *[len(p) + 1 for p in normal]])
    found = t.pre_tokenizer.pre_tokenize_str(" ".join(normal))
    return np.searchsorted(starts, np.array([at for _, (at, _) in found], np.int64), "right") - 1, [p for p, _ in found]


def checked(path: str) -> None:
    """Raises an error for a tokenizer that does not drop white space: its counts are not those of blank-separated parts."""
    t = _tokenizer(path)
    parts = ["a", "Bc", "12", ".", "d'e", "\u00e9", "x-y", "z"]

    def ids(text: str) -> list[int]:
        return t.encode(text, add_special_tokens=False).ids

    if any(ids(gap.join(parts)) != [i for p in parts for i in ids(p)] for gap in (" ", "\n", "  ", " \n ")):
        raise ValueError("the tokenizer keeps white space; texts cannot be counted part by part")


def frequent_pretokens(docs: DataFrame, path: str, text: str, sample: int = SAMPLE, kept: int = KEPT) -> dict[str, int]:
    """The most frequent pre-tokens of about `sample` texts, chosen by hash, with their token counts. One job: tasks count the
    pre-tokens of their share of the sample, the sums are those of the sample, and the driver receives `kept` rows at most."""
    rows = docs.select(F.col(text).cast("string").alias("text"))
    every = max(1, rows.count() // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(pretokens(path, _split(t))[1])
        top = [(w, n) for w, n in seen.most_common(kept) if n > 1 and len(w) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    drawn = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0))
    sums = drawn.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    model = _tokenizer(path).model
    return {r.word: len(model.tokenize(r.word)) for r in sums.orderBy(F.desc("n"), "word").limit(kept).collect()}


class Counts:
    """Token counts of parts in a Python worker: the frequent table first, then what the worker has met."""

    def __init__(self, path: str, frequent: dict[str, int], cache: int):
        self.path, self.cache, self.model, self.frequent = path, cache, _tokenizer(path).model, frequent
        self.special = _special(path)
        #: Token counts of parts and of pre-tokens.
        self.parts, self.met = _caches.setdefault(path, ({"": 0}, {}))

    def _of_pretokens(self, words: list[str]) -> np.ndarray:
        n = [self.frequent.get(w, -1) for w in words]
        for i, k in enumerate(n):
            if k < 0:
                w = words[i]
                k = self.met.get(w)
                if k is None:
                    k = len(self.model.tokenize(w))
                    if len(w) <= LONGEST_KEPT:
                        self.met[w] = k
                n[i] = k
        return np.array(n, np.int64)

    def add(self, parts: set[str]) -> dict[str, int]:
        """Makes `parts` known; returns those among them that are too long to keep."""
        if len(self.parts) > self.cache:
            self.parts.clear()
            self.parts[""] = 0
        if len(self.met) > self.cache:
            self.met.clear()
        new = [p for p in parts if p not in self.parts]
        whole = [p for p in new if any(s in p for s in self.special)]
        plain = [p for p in new if p not in set(whole)] if whole else new
        of, words = pretokens(self.path, plain)
        n = np.bincount(of, self._of_pretokens(words), minlength=len(plain)).astype(int).tolist() if words else [0] * len(plain)
        got = dict(zip(plain, n, strict=True))
        got.update((p, len(_tokenizer(self.path).encode(p, add_special_tokens=False))) for p in whole)
        self.parts.update((p, k) for p, k in got.items() if len(p) <= LONGEST_KEPT)
        return {p: k for p, k in got.items() if len(p) > LONGEST_KEPT}


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 2048, cache: int = 400_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs, whole texts.

    path: a tokenizers .json that drops white space. Special strings inside texts are handled as the library
    does by default. A null text counts as empty: 0 bytes, 0 tokens. Rows with null or repeated ids stay, each
    with its own counts; an empty table gives an empty one; other columns are ignored.
    cache: parts, and pre-tokens, that a Python worker keeps before it starts anew. Very long texts are counted whole.
    """
    checked(path)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, path, text))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def count(b: pa.RecordBatch) -> dict:
        counts = Counts(path, frequent.value, cache)
        n_tokens = []
        texts = b.column(1).to_pylist()
        for at in range(0, len(texts), 256):
            split = [_split(t) if t else [] for t in texts[at : at + 256]]
            long = counts.add({p for ps in split for p in ps})
            known = counts.parts
            n_tokens += [sum([known[p] if p in known else long[p] for p in ps] if long else map(known.__getitem__, ps)) for ps in split]
        return {
            "doc_id": b.column(0),
            "n_bytes": pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_()),
        }

    return arrow_map(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", count)
