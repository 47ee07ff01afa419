"""BM25 over postings tables, for batches of queries.

A chunk's terms are counted where the chunk is, so an index moves no postings. A search moves those of the queries' terms, into
a grid of cells of bounded size, a group of chunks and a group of queries of a repository each. A cell is one task's: it adds up
the contributions of its terms and gives each query's best chunks, so pairs of queries and chunks are no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lodestone.config import LexicalConfig
from lodestone.functions import payload, text
from lodestone.sources.tables import spread, stored

#: Columns that a lexical filter can name; any other name is a key of the chunks' metadata, if they have such a column.
FILTERS = ("file_path", "language", "symbol_name", "chunk_type", "part", "parts")


@dataclass(frozen=True)
class LexicalIndex:
    """postings(repository_id, term, chunk_id, tf), lengths(repository_id, chunk_id, dl and the FILTERS), terms(repository_id,
    term, df), repositories(repository_id, n, avgdl). Statistics are of whole repositories, whatever a query filters."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    repositories: DataFrame


#: text.TOKEN over the bytes of a text in lower case, none of whose words has several components.
PLAIN = re.compile(rb"[a-z_][a-z0-9_]*|[0-9]+")


def counted(chunks: DataFrame) -> DataFrame:
    """(repository_id, chunk_id, the FILTERS and metadata that chunks have, terms, tfs, dl): a chunk's distinct terms, how
    often each occurs, and the number of its tokens. Only texts with words of several components are split by text.code_tokens."""
    content = text.searchable_text(F.col("file_path"), F.col("symbol_name"), F.col("content"))
    kept = chunks.select("repository_id", "chunk_id", *[c for c in (*FILTERS, payload.NAME) if c in chunks.columns])
    split = F.when(text.has_parts(content), text.code_tokens(content))
    rows = chunks.select(*kept.columns, split.alias("tokens"), F.when(~text.has_parts(content), content.cast("binary")).alias("plain"))
    schema = StructType([*kept.schema, StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(LongType())), StructField("dl", IntegerType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tfs, sizes, lengths = [], [], [], []
            for tokens, plain in zip(b.column("tokens"), b.column("plain")):
                x = [t.encode() for t in tokens.as_py()] if tokens.is_valid else PLAIN.findall((plain.as_py() or b"").lower())
                found = Counter(x)
                terms.extend(found.keys())
                tfs.extend(found.values())
                sizes.append(len(found))
                lengths.append(len(x))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            out = b.drop_columns(["tokens", "plain"]).append_column("terms", pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())))
            out = out.append_column("tfs", pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())))
            yield out.append_column("dl", pa.array(lengths, pa.int32()))

    return rows.mapInArrow(count, schema)


def posted(rows: DataFrame) -> DataFrame:
    """(repository_id, chunk_id, term, tf) of `counted` rows; rows of one repository_id and chunk_id are counted together."""
    ids = ["repository_id", "chunk_id"]
    again = stored(rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"again_{c}") for c in ids]), "lexical-again")
    same = F.col("repository_id").eqNullSafe(F.col("again_repository_id")) & F.col("chunk_id").eqNullSafe(F.col("again_chunk_id"))

    def each(part: DataFrame) -> DataFrame:
        return part.select(*ids, F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(*ids, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))

    several = each(rows.join(again, same, "left_semi")).groupBy(*ids, "term").agg(F.sum("tf").alias("tf"))
    return each(rows.join(again, same, "left_anti")).unionByName(several)


def build_index(chunks: DataFrame) -> LexicalIndex:
    """The index of chunks; their contents are split into tokens, and these counted, once, in a stored table."""
    rows = stored(counted(spread(chunks)), "lexical-counts")
    lengths = rows.drop("terms", "tfs")
    postings = posted(rows).select("repository_id", "term", "chunk_id", "tf")
    terms = postings.groupBy("repository_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return LexicalIndex(postings, lengths, terms, statistics(lengths))


def statistics(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def matches(filters: dict[str, object], columns: list[str]) -> Column:
    return payload.meets(filters, columns, [c for c in FILTERS if c in columns])


def search(index: LexicalIndex, queries: DataFrame, limit: int, filters: dict[str, object] | None = None, config: LexicalConfig = LexicalConfig(), digits: int | None = None) -> DataFrame:
    """(query_id, repository_id, chunk_id, score, rank) for queries (query_id, repository_id, text): the limit best chunks
    with a score above 0 of each query's repository, ties to the smaller chunk_id. A query's repeated tokens count once.
    Only postings of the queries' terms are counted and moved. digits: scores are rounded to so many before they are ranked."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    terms = queries.select("query_id", "repository_id", F.explode(F.array_distinct(text.code_tokens(F.col("text")))).alias("term"))
    terms = stored(terms, "lexical-questions")
    key = ["repository_id", "term"]
    numbers = stored(terms.select(*key).distinct().withColumn("term_no", F.monotonically_increasing_id()), "lexical-terms")
    found = stored(index.postings.join(numbers, key).select("repository_id", "chunk_id", "term_no", "tf"), "lexical-found")
    df = found.groupBy("term_no").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(numbers.join(df, "term_no"), key).join(index.repositories, "repository_id")
    asked = stored(asked.select("repository_id", "query_id", "term_no", "df", idf.alias("idf")), "lexical-asked")
    lengths = index.lengths.where(matches(filters, index.lengths.columns)) if filters else index.lengths
    average = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    norm = config.k1 * (1 - config.b + config.b * F.col("dl") / average)
    lengths = lengths.join(index.repositories, "repository_id").where("chunk_id IS NOT NULL").select("repository_id", "chunk_id", norm.alias("norm"))
    return ranked(_best(found, lengths, asked, limit, config.k1 + 1, digits), "query_id", limit)


#: Postings, terms of queries and contributions of a cell of the grid, about at most.
POSTINGS, QUESTIONS, HITS = 1 << 17, 1 << 16, 1 << 25
#: Contributions and pairs of queries and chunks that are held at once.
HELD = 1 << 21


def _best(found: DataFrame, lengths: DataFrame, asked: DataFrame, limit: int, top: float, digits: int | None) -> DataFrame:
    """(query_id, repository_id, chunk_id, score): the best chunks of each query in each cell of the grid, `limit` at most."""
    work = asked.groupBy("repository_id").agg(F.count(F.lit(1)).alias("q"), F.sum("df").alias("hits"))
    some = asked.select("repository_id", "term_no", "df").distinct().groupBy("repository_id").agg(F.sum("df").alias("n"))
    tall = work.join(some, "repository_id").withColumn("q_groups", F.ceil(F.col("q") / QUESTIONS).cast("int"))
    wide = F.ceil(F.greatest(F.col("n") / POSTINGS, F.col("hits") / F.col("q_groups") / HITS)).cast("int")
    grid = tall.select("repository_id", "q_groups", wide.alias("n_groups"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda id, c: F.pmod(F.xxhash64(id), F.col(c)).cast("int")
    query, chunk = asked.schema["query_id"].dataType, found.schema["chunk_id"].dataType
    # x is a posting's count, a chunk's norm or a term's weight
    ofs = ["repository_id", "n_group", "q_group"]
    p = found.where("chunk_id IS NOT NULL").join(grid, "repository_id").select("repository_id", part("chunk_id", "n_groups").alias("n_group"), every("q_groups").alias("q_group"), F.lit(0).alias("kind"), "chunk_id", F.lit(None).cast(query).alias("query_id"), "term_no", F.col("tf").cast("double").alias("x"))
    c = lengths.join(grid, "repository_id").select("repository_id", part("chunk_id", "n_groups").alias("n_group"), every("q_groups").alias("q_group"), F.lit(1).alias("kind"), "chunk_id", F.lit(None).cast(query).alias("query_id"), F.lit(None).cast("long").alias("term_no"), F.col("norm").alias("x"))
    q = asked.join(grid, "repository_id").select("repository_id", every("n_groups").alias("n_group"), part("query_id", "q_groups").alias("q_group"), F.lit(2).alias("kind"), F.lit(None).cast(chunk).alias("chunk_id"), "query_id", "term_no", F.col("idf").alias("x"))

    held = HELD

    def find(cell: pa.Table) -> pa.Table:
        rows = [cell.filter(pc.equal(cell["kind"], k)) for k in range(3)]
        return _cell(*rows, limit, top, digits, held)

    kinds = {"query_id": query, "repository_id": asked.schema["repository_id"].dataType, "chunk_id": chunk}
    schema = ", ".join(f"{k} {v.simpleString()}" for k, v in kinds.items()) + ", score double"
    return p.unionByName(c).unionByName(q).withColumn("cell", cell_of(*ofs)).groupBy("cell").applyInArrow(find, schema)


def cell_of(repository_id: str, *groups: str) -> Column:
    """One key for a cell of a grid: rows that a join has dealt by repository are dealt anew, not a repository to a task."""
    return F.concat_ws(":", *groups, repository_id)


def _codes(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of the columns in order, null first, and each column's numbers of them."""
    values = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(values.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[values.indices.to_numpy()]
    return values.dictionary.take(pa.array(order)), np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _cell(postings: pa.Table, chunks: pa.Table, asked: pa.Table, limit: int, top: float, digits: int | None, held: int) -> pa.Table:
    """The best chunks of each query of a cell. A pair's contributions are added up in the order of its terms' numbers."""
    chunk_ids, (of, chunk) = _codes(postings["chunk_id"], chunks["chunk_id"])
    query_ids, (query,) = _codes(asked["query_id"])
    term, idf = asked["term_no"].to_numpy(), asked["x"].to_numpy()
    order = np.lexsort((query, term))
    term, idf, query = term[order], idf[order], query[order]
    # a chunk has one row, as a rule; of several each takes all postings
    order = np.argsort(chunk, kind="stable")
    chunk, norm = chunk[order], chunks["x"].to_numpy()[order]
    rows = lambda sorted, x: (np.searchsorted(sorted, x), np.searchsorted(sorted, x, "right"))
    no, tf = postings["term_no"].to_numpy(), postings["x"].to_numpy()
    order = np.lexsort((no, of))
    of, no, tf = of[order], no[order], tf[order]
    posting, at = _expanded(*rows(chunk, of))
    of, no = of[posting], no[posting]
    weight = tf[posting] * top / (tf[posting] + norm[at])
    begin, end = rows(term, no)
    hits = np.concatenate([[0], np.cumsum(end - begin)])
    slack = 1e-9 + (0.0 if digits is None else 10.0**-digits)
    floor = np.full(len(query_ids), -np.inf)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    width = max(held // max(len(query_ids), 1), 1)
    i = 0
    while i < len(of):
        # whole chunks, whose contributions and pairs are few enough
        first = of[i]
        j = min(np.searchsorted(of, first + width), np.searchsorted(hits, hits[i] + held, "right") - 1)
        if j < len(of):
            j = np.searchsorted(of, of[j])
        if j <= i:
            j = np.searchsorted(of, first, "right")
        n = of[j - 1] - first + 1
        posting, entry = _expanded(begin[i:j], end[i:j])
        score = np.bincount(query[entry] * n + (of[i:j][posting] - first), idf[entry] * weight[i:j][posting], len(query_ids) * n).reshape(-1, n)
        if n > limit:
            floor = np.maximum(floor, np.partition(score, n - limit, axis=1)[:, n - limit] * (1 - 1e-12) - slack)
        a, b = np.nonzero((score > 0) & (score >= floor[:, None]))
        found = half_up(score[a, b], digits)
        a, b, found = (np.concatenate([x, y])[np.concatenate([best[2], found]) > 0] for x, y in zip(best, (a, b + first, found)))
        order = np.lexsort((b, -found, a))
        a = a[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        kept = rank < limit
        best = [a[kept], b[order][kept], found[order][kept]]
        last = rank[kept] == limit - 1
        floor[best[0][last]] = np.maximum(floor[best[0][last]], best[2][last] * (1 - 1e-12) - slack)
        i = j
    repository = pa.repeat(asked["repository_id"][0], len(best[0])) if len(best[0]) else pa.array([], asked["repository_id"].type)
    return pa.table([query_ids.take(pa.array(best[0])), repository, chunk_ids.take(pa.array(best[1])), pa.array(best[2])], names=["query_id", "repository_id", "chunk_id", "score"])


def _expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges, each as often as it is long, and what lies in them."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + (begin - np.cumsum(n) + n)[of]


def half_up(score: np.ndarray, digits: int | None) -> np.ndarray:
    """Scores rounded as Spark rounds them, by their decimal digits."""
    if digits is None:
        return score
    with np.errstate(all="ignore"):
        scaled = np.abs(score) * 10.0**digits
        near = np.isfinite(score) & (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3)
        out = np.where(np.isfinite(score), np.copysign(np.floor(scaled + 0.5) / 10.0**digits, score) + 0.0, score)
    unit = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(near):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(unit, ROUND_HALF_UP))
    return out


def rounded(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)


def ranked(scored: DataFrame, by: str, limit: int) -> DataFrame:
    """The limit best rows of each `by`, with their rank from 1: highest score, then smallest chunk_id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)
