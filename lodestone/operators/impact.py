"""BM25 over impact-ordered postings: blocks of a term's postings with their greatest contribution, most of them never read.

A posting's impact is its BM25 weight without the term's idf. Postings are stored by term hash, repository, term and falling
impact level, so a term's rows lie together in few Parquet row groups, its best ones first; levels cut a frequent term
into blocks of any task's, never one key. For each block the greatest impact and the number of postings are kept.

A search reads the best blocks of each query's terms first. The k-th sum of these is no greater than the k-th score. A block
whose greatest contribution, with the greatest ones of the query's other terms, stays below it holds no posting of an
answer; only the others are read. Every posting of an answer is then read, so scores and ranks equal those of
`lexical.search`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import LexicalConfig
from lodestone.functions import text
from lodestone.operators import lexical
from lodestone.sources.tables import spread, stored

#: Impact levels; an impact is below k1 + 1.
LEVELS = 64
#: Term hashes, at most, that are pushed to the scan as values; queries of more terms are joined with all row groups.
PUSHED = 1000


@dataclass(frozen=True)
class ImpactIndex:
    """postings(term_hash, repository_id, term, level, chunk_id, impact) in this order, blocks(term_hash, repository_id, term, level,
    top, n, term_top, idf), lengths as in a LexicalIndex."""

    postings: DataFrame
    blocks: DataFrame
    lengths: DataFrame


def term_hash(repository_id: Column, term: Column) -> Column:
    return F.xxhash64(repository_id, term)


def build(chunks: DataFrame, config: LexicalConfig = LexicalConfig()) -> ImpactIndex:
    """The impact-ordered index of chunks, each with an id of its own. Postings are moved once, into their order; statistics
    are of whole repositories."""
    counts = stored(lexical.counted(spread(chunks)), "impact-counts")
    lengths = counts.drop("terms", "tfs")
    repositories = stored(lexical.statistics(lengths), "impact-repositories")
    each = counts.select("repository_id", "chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    rows = each.select("repository_id", "chunk_id", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf")).join(repositories, "repository_id")
    average = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    impact = F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / average))
    rows = rows.select(term_hash(F.col("repository_id"), F.col("term")).alias("term_hash"), "repository_id", "term", impact.alias("impact"), "chunk_id")
    rows = rows.withColumn("level", F.least(F.floor(F.col("impact") * LEVELS / (config.k1 + 1)), F.lit(LEVELS - 1)).cast("int"))
    order = ["term_hash", "repository_id", "term", F.desc("level"), "chunk_id"]
    laid = rows.select("term_hash", "repository_id", "term", "level", "chunk_id", "impact").repartitionByRange(*order).sortWithinPartitions(*order)
    postings = stored(laid, "impact-postings")
    chunks_of = repositories.select("repository_id", F.col("n").alias("chunks"))
    idf = F.log(F.lit(1.0) + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    columns = ["term_hash", "repository_id", "term", "level", "top", "n", "term_top", idf]
    runs = stored(_runs(postings).join(chunks_of, "repository_id"), "impact-runs")
    # what lies at a border may go on beyond it; that is few rows
    cut = runs.where(~F.col("whole")).groupBy("term_hash", "repository_id", "term", "level", "chunks").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    terms = cut.groupBy("term_hash", "repository_id", "term").agg(F.sum("n").alias("df"), F.max("top").alias("term_top"))
    rest = stored(cut.join(terms, ["term_hash", "repository_id", "term"]).select(*columns), "impact-blocks")
    return ImpactIndex(postings, runs.where("whole").select(*columns).unionByName(rest), lengths)


def _runs(postings: DataFrame) -> DataFrame:
    """(term_hash, repository_id, term, level, top, n, df, term_top, whole): blocks of stored postings as their files have them in order.
    A term that is neither first nor last in a batch or in what a task reads of a file lies there as a whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            numbers = lambda *names: [pc.dictionary_encode(b.column(c)).indices.to_numpy() if pa.types.is_string(b.column(c).type) else b.column(c).to_numpy() for c in names]
            changes = lambda *names: np.concatenate([[True], np.any([x[1:] != x[:-1] for x in numbers(*names)], axis=0)])
            of_file = changes("file", "file_block_start")
            of_term = of_file | changes("term_hash", "repository_id", "term")
            run, term = np.flatnonzero(of_term | changes("level")), np.flatnonzero(of_term)
            impact, of = b.column("impact").to_numpy(), np.cumsum(of_term)[run] - 1
            border = of_file[term] | np.append(of_file[term[1:]], True)
            values = {"top": np.maximum.reduceat(impact, run), "n": np.diff(run, append=b.num_rows), "df": np.diff(term, append=b.num_rows)[of], "term_top": np.maximum.reduceat(impact, term)[of], "whole": ~border[of]}
            names = ["term_hash", "repository_id", "term", "level"]
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(run)) for c in names] + [pa.array(x) for x in values.values()], names=[*names, *values])

    places = [F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("file_block_start")]
    return postings.select("term_hash", "repository_id", "term", "level", "impact", *places).mapInArrow(cut, "term_hash long, repository_id string, term string, level int, top double, n long, df long, term_top double, whole boolean")


def _pushed(postings: DataFrame, blocks: DataFrame) -> DataFrame:
    """postings of the blocks' terms: few hashes are pushed to the scan, where they skip row groups."""
    hashes = blocks.select("term_hash").distinct().limit(PUSHED + 1).collect()
    return postings if len(hashes) > PUSHED else postings.where(F.col("term_hash").isin([r.term_hash for r in hashes]))


def _sums(index: ImpactIndex, asked: DataFrame, filters: dict[str, object] | None, digits: int | None) -> DataFrame:
    blocks = asked.select("query_id", "term_hash", "repository_id", "term", "level", "idf")
    hits = _pushed(index.postings, asked).join(blocks, ["term_hash", "repository_id", "term", "level"])
    if filters:
        kept = index.lengths.where(lexical.matches(filters, index.lengths.columns)).select("repository_id", "chunk_id")
        hits = hits.join(kept, ["repository_id", "chunk_id"], "left_semi")
    return hits.groupBy("query_id", "repository_id", "chunk_id").agg(lexical.rounded(F.sum(F.col("idf") * F.col("impact")), digits).alias("score")).where("score > 0")


def searched(index: ImpactIndex, queries: DataFrame, limit: int, filters: dict[str, object] | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The result of `search`, and (query_id, postings_read, postings): how many postings of its terms each query read."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    terms = queries.select("query_id", "repository_id", F.explode(F.array_distinct(text.code_tokens(F.col("text")))).alias("term"))
    terms = terms.withColumn("term_hash", term_hash(F.col("repository_id"), F.col("term")))
    found = stored(terms.join(index.blocks, ["term_hash", "repository_id", "term"]), "impact-asked")
    # the best blocks of each term that hold `limit` postings give a floor under the k-th score
    better = Window.partitionBy("query_id", "term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    first = found.withColumn("before", F.coalesce(F.sum("n").over(better), F.lit(0))).where(F.col("before") < limit)
    floor = lexical.ranked(_sums(index, first, filters, digits), "query_id", limit).where(F.col("rank") == limit).select("query_id", F.col("score").alias("floor"))
    whole = found.groupBy("query_id", "term").agg(F.first(F.col("idf") * F.col("term_top")).alias("most")).groupBy("query_id").agg(F.sum("most").alias("most"))
    # rounding of scores, and sums in another order, may lift a score over its bound
    slack = (0.0 if digits is None else 10.0**-digits) + 1e-9
    bound = F.col("most") - F.col("idf") * (F.col("term_top") - F.col("top"))
    read = found.join(whole, "query_id").join(floor, "query_id", "left").where(F.col("floor").isNull() | (bound * (1 + 1e-9) + slack >= F.col("floor")))
    read = stored(read.drop("most", "floor"), "impact-read")
    work = found.groupBy("query_id").agg(F.sum("n").alias("postings")).join(read.groupBy("query_id").agg(F.sum("n").alias("postings_read")), "query_id", "left")
    work = work.select("query_id", F.coalesce("postings_read", F.lit(0)).alias("postings_read"), "postings")
    return lexical.ranked(_sums(index, read, filters, digits), "query_id", limit), work


def search(index: ImpactIndex, queries: DataFrame, limit: int, filters: dict[str, object] | None = None, digits: int | None = None) -> DataFrame:
    """As lexical.search, over an impact-ordered index."""
    return searched(index, queries, limit, filters, digits)[0]
