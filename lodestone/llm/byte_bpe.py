"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database a Python worker.

encode: rows (word, position, token) start as single bytes. Each step of a recursive query joins neighbouring
rows with the merge table and contracts every word's leftmost pair of the lowest rank, until no word has a pair
left. Rows carry the token and position of their right neighbour, so no step depends on the order of rows.
decode: token rows join the vocabulary; an aggregate ordered by position puts the bytes together. Every document's ids
are decoded so, and what is returned as decoded is what comes out.

Words (matches of the pre-tokenizer pattern) recur, so a worker keeps the results of those it has encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map

#: Longest word that a step may contract by one pair only; beyond it all occurrences of a pair go at once where safe.
LONG = 512
#: Rows that the recursion of a long word may hold before its state is carried into a new query.
HELD = 2_000_000
#: Characters of joined ids that one part of a text has in decoding.
DECODED = 1_000_000

_ENCODE = """
WITH RECURSIVE s(it, w, p, t, np, nt) AS (
  SELECT 0::INT, w, p, t, np, nt FROM start
  UNION ALL (
  WITH best AS MATERIALIZED (
    SELECT w, min(m.rank::BIGINT << 32 | p) AS key, arg_min(np, m.rank::BIGINT << 32 | p) AS gone
    FROM s JOIN merges m ON m.l = s.t AND m.r = s.nt GROUP BY w),
  pair AS (
    SELECT best.w, key & 4294967295 AS place, (key >> 32)::INT AS rank, gone, r.np AS rnp, r.nt AS rnt
    FROM best JOIN s r ON r.w = best.w AND r.p = best.gone)
  SELECT it + 1, s.w, p,
    CASE WHEN p = place THEN rank ELSE t END,
    CASE WHEN p = place THEN rnp ELSE np END,
    CASE WHEN p = place THEN rnt WHEN np = place THEN rank ELSE nt END
  FROM s JOIN pair ON s.w = pair.w WHERE p <> gone))
SELECT w, p, t FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) USING (w, it)
"""

#: One word: all occurrences of the lowest pair at once (alternate ones in a run of overlaps) if no pair with the
#: new token ranks lower than it, else the leftmost; stops after `steps` steps.
_ENCODE_LONG = """
WITH RECURSIVE s(it, p, t) AS (
  SELECT 0::INT, p, t FROM start_long
  UNION ALL (
  WITH n AS MATERIALIZED (SELECT it, p, t, lead(t) OVER (ORDER BY p) AS nt, lag(p) OVER (ORDER BY p) AS pp, row_number() OVER (ORDER BY p) AS k FROM s),
  hits AS MATERIALIZED (SELECT p, k, m.rank FROM n JOIN merges m ON m.l = n.t AND m.r = n.nt),
  low AS (SELECT p, k, rank, row_number() OVER (ORDER BY k) AS i FROM hits WHERE rank = (SELECT min(rank) FROM hits)),
  runs AS (SELECT p, rank, i, row_number() OVER (PARTITION BY k - i ORDER BY k) AS j FROM low),
  taken AS MATERIALIZED (SELECT p, rank FROM runs LEFT JOIN unsafe USING (rank) WHERE CASE WHEN unsafe.rank IS NULL THEN j % 2 = 1 ELSE i = 1 END)
  SELECT it + 1, n.p, coalesce(a.rank, n.t)
  FROM n LEFT JOIN taken a ON a.p = n.p LEFT JOIN taken b ON b.p = n.pp
  WHERE b.p IS NULL AND it < $steps AND (SELECT count(*) FROM taken) > 0))
SELECT p, t FROM s WHERE it = (SELECT max(it) FROM s)
"""

#: The same for texts whose decimal ids are joined by commas: their ids become rows, which the vocabulary joins.
_DECODE_TEXTS = """
SELECT w, count(*)::BIGINT AS n, string_agg(chars, '' ORDER BY p) AS text
FROM (SELECT w, unnest(ids) AS t, generate_subscripts(ids, 1) AS p FROM (SELECT w, string_split(ids, ',')::INT[] AS ids FROM encoded WHERE ids <> ''))
JOIN vocabulary ON id = t GROUP BY w
"""

#: Of token rows of each word: the decimal ids, and the bytes they decode to, each byte as the character of its number.
_DECODE = """
SELECT w, count(*)::INT AS n, string_agg(t::VARCHAR, ',' ORDER BY p) AS ids, string_agg(chars, '' ORDER BY p) AS text
FROM ids JOIN vocabulary ON id = t GROUP BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a token in base64, a blank, its rank, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class DuckBpe:
    """The merge table and vocabulary of one ranks file in a DuckDB of this process."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = ranks = load_ranks(path)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, rank = (np.array(x, np.int32) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int32),) * 3
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._put("merges", l=l, r=r, rank=rank)
        unsafe = np.union1d(l[l > rank], r[r > rank]).astype(np.int32)
        self._put("unsafe", rank=unsafe)
        chars = [t.decode("latin-1") for t in ranks]
        con.register("given", pa.table({"id": pa.array(ranks.values(), pa.int32()), "chars": pa.array(chars, pa.string())}))
        con.execute("CREATE TABLE vocabulary AS FROM given")
        con.unregister("given")

    def _put(self, name: str, **columns) -> None:
        self.con.register("given", pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()}))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.con.unregister("given")

    def _ids(self, words: list[bytes]) -> list[tuple]:
        """Fills the table ids with (w, p, t): the tokens of each word, contracted. A word that is a token is that token."""
        ranks = self.ranks
        whole = [i for i, w in enumerate(words) if w in ranks]
        short = [i for i, w in enumerate(words) if w and w not in ranks and len(w) <= LONG]
        long = [(i, self._encode_long(w)) for i, w in enumerate(words) if w not in ranks and len(w) > LONG]
        n = np.array([len(words[i]) for i in short], np.int64)
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        t = self.byte[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        last = np.zeros(total, bool)
        last[end - 1] = True
        p = np.arange(total) - np.repeat(end - n, n)
        w = np.repeat(np.array(short, np.int64), n)
        self._put("start", w=w, p=p, t=t, np=pa.array(p + 1, pa.int32(), mask=last), nt=pa.array(np.roll(t, -1), pa.int32(), mask=last))
        self.con.execute(f"CREATE OR REPLACE TABLE ids AS {_ENCODE}")
        rest = [(i, 0, ranks[words[i]]) for i in whole] + [(i, k, x) for i, ids in long for k, x in enumerate(ids)]
        if rest:
            w, p, t = zip(*rest, strict=True)
            self._put("rest", w=w, p=p, t=t)
            self.con.execute("INSERT INTO ids FROM rest")

    def round_trip(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """For each word its decimal ids joined by commas, and the bytes that these ids decode to."""
        out = [("", b"")] * len(words)
        if any(words):
            self._ids(words)
            got = self.con.sql(_DECODE).to_arrow_table()
            for w, ids, text in zip(got["w"].to_pylist(), got["ids"].to_pylist(), got["text"].to_pylist(), strict=True):
                out[w] = (ids, text.encode("latin-1"))
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        return [[int(x) for x in ids.split(",")] if ids else [] for ids, _ in self.round_trip(words)]

    def _encode_long(self, word: bytes) -> list[int]:
        t = self.byte[np.frombuffer(word, np.uint8)]
        while True:
            self._put("start_long", p=np.arange(len(t)), t=t)
            got = self.con.execute(_ENCODE_LONG, {"steps": max(1, HELD // len(t))}).fetchnumpy()
            new = got["t"][np.argsort(got["p"])].astype(np.int32)
            if len(new) == len(t):
                return new.tolist()
            t = new

    def decode_texts(self, joined: list[str]) -> tuple[list[int], list[bytes]]:
        """For texts' decimal ids, joined by commas: how many there are, and the bytes that they decode to. Long texts are
        decoded in parts, so that the memory of a query is bounded."""
        n, out = [0] * len(joined), [[] for _ in joined]
        held, size = [], 0

        def run() -> None:
            self.con.register("encoded", pa.table({"w": pa.array(range(len(held)), pa.int64()), "ids": pa.array([x for _, x in held], pa.string())}))
            got = self.con.sql(_DECODE_TEXTS).to_arrow_table()
            self.con.unregister("encoded")
            for w, k, text in sorted(zip(got["w"].to_pylist(), got["n"].to_pylist(), got["text"].to_pylist(), strict=True)):
                n[held[w][0]] += k
                out[held[w][0]].append(text.encode("latin-1"))
            held.clear()

        for i, x in enumerate(joined):
            at = 0
            while at < len(x):
                end = x.find(",", at + DECODED)
                end = len(x) if end < 0 else end
                held.append((i, x[at:end]))
                size, at = size + end - at, end + 1
                if size >= 2 * DECODED:
                    run()
                    size = 0
        if held:
            run()
        return n, [b"".join(parts) for parts in out]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids. An id that the vocabulary lacks raises KeyError."""
        out = [b""] * len(ids)
        n = [len(x) for x in ids]
        total = sum(n)
        if total:
            flat = np.fromiter((i for x in ids for i in x), np.int64, total)
            starts = np.cumsum(n) - n
            self._put("ids", w=np.repeat(np.arange(len(ids)), n), p=np.arange(total) - np.repeat(starts, n), t=flat)
            got = self.con.sql(_DECODE).to_arrow_table()
            if sum(got["n"].to_pylist()) != total:
                raise KeyError("an id is not in the vocabulary")
            for w, text in zip(got["w"].to_pylist(), got["text"].to_pylist(), strict=True):
                out[w] = text.encode("latin-1")
        return out


_duck: dict[str, DuckBpe] = {}
_kept: dict[str, dict] = {}


def _bpe(path: str) -> DuckBpe:
    if path not in _duck:
        _duck[path] = DuckBpe(path)
    return _duck[path]


class _Pieces:
    """Texts in pieces that the pattern never matches across, with the encoded pieces of this worker."""

    #: A blank between white space (or at a text's end behind it) belongs to a run that one match may take as a whole.
    _within_run = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, pattern: str, cache: int):
        import regex

        self.bpe, self.cache = _bpe(path), cache
        # ids of pieces met lately, and of those met before them: when the first are too many they become the second
        self.kept: list[dict[str, str]] = _kept.setdefault(path + pattern, [{}, {}])
        self.find = regex.compile(pattern).findall

    def split(self, text: str) -> list[str]:
        if "\0" in text or self._within_run.search(text):
            return self.find(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, pieces: Iterable[str]) -> dict[str, str]:
        """Makes kept[0] hold the decimal ids of each piece, joined by commas; returns those of pieces too long to keep.
        Every new word's ids are decoded again: kept ids are those that decode to the piece."""
        kept = self.kept
        if len(kept[0]) > self.cache:
            kept[1], kept[0] = kept[0], {}
        lately, before = kept
        new = []
        for p in pieces:
            if p not in lately:
                ids = before.get(p)
                if ids is None:
                    new.append(p)
                else:
                    lately[p] = ids
        place = {}
        words = []
        for p in new:
            ws = self.find(p)
            words.append(ws)
            for w in ws:
                if w not in lately:
                    place.setdefault(w, len(place))
        raw = [w.encode() for w in place]
        done = self.bpe.round_trip(raw)
        if [x[1] for x in done] != raw:
            raise ValueError("ids do not decode to the word they encode")
        got = {w: x[0] for w, x in zip(place, done, strict=True)}
        long = {}
        for p, ws in zip(new, words, strict=True):
            ids = got[ws[0]] if len(ws) == 1 and ws[0] in got else ",".join([got[w] if w in got else lately[w] for w in ws])
            if len(p) <= 64:
                lately[p] = ids
            else:
                long[p] = ids
        return long


def encode_documents(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", cache: int = 600_000, digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again, in the tasks that read the rows: nothing is shuffled.

    Returns (doc_id, n_tokens, token_ids binary: little-endian uint32, decoded binary), or with digests the
    contract's (doc_id, n_tokens, ids_sha256, decoded_sha256). As tiktoken without special tokens: each match of
    pattern separately. A null or empty text has 0 tokens; very long texts and words are encoded whole; rows with null or repeated ids stay; an empty table
    gives an empty one; other columns are ignored. cache: a worker keeps at most about twice so many
    pieces.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encode(b: pa.RecordBatch):
        pieces = _Pieces(path, pattern, cache)
        ids, texts = b.column(0), b.column(1).to_pylist()
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < 1_000_000):
                size += len(texts[end])
                end += 1
            split = [pieces.split(t) for t in texts[at:end]]
            long = pieces.encode({p for ps in split for p in ps})
            kept = pieces.kept[0]
            joined = [",".join([x for x in ([kept[p] if p in kept else long[p] for p in ps] if long else map(kept.__getitem__, ps)) if x]) for ps in split]
            n, data = pieces.bpe.decode_texts(joined)
            if digests:
                a, d = [hashlib.sha256(x.encode()).hexdigest() for x in joined], [hashlib.sha256(x).hexdigest() for x in data]
            else:
                a, d = [np.array(x.split(",") if x else [], "<u4").tobytes() for x in joined], data
            kind = pa.string() if digests else pa.binary()
            names = ("ids_sha256", "decoded_sha256") if digests else ("token_ids", "decoded")
            yield {"doc_id": ids.slice(at, end - at), "n_tokens": pa.array(n, pa.int64()), names[0]: pa.array(a, kind), names[1]: pa.array(d, kind)}
            at = end

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "token_ids binary, decoded binary")
    return arrow_map(rows, schema, encode)


def decode_documents(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(doc_id, decoded binary) of rows with token ids as little-endian uint32; null ids decode to nothing."""
    rows = encoded.select(F.col(id).alias("doc_id"), F.col(ids).alias("ids"))

    def decode(b: pa.RecordBatch) -> dict:
        lists = [np.frombuffer(x or b"", "<u4").tolist() for x in b.column(1).to_pylist()]
        return {"doc_id": b.column(0), "decoded": pa.array(_bpe(path).decode(lists), pa.binary())}

    return arrow_map(rows, "doc_id long, decoded binary", decode)
