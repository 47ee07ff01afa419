"""Bounded cited contexts, prompts, answers and their citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import ContextConfig
from lodestone.functions import text

# Formats that answers and tests rely on.
INSUFFICIENT = "The retrieved repository context is insufficient to answer this question."
NO_SYMBOL = "<module>"
QUESTION, CONTEXT, REQUEST = "Repository question:", "Retrieved repository context:", "Answer the repository question using only the retrieved context above."
#: What a generator is told besides the prompt.
INSTRUCTIONS = "Answer from the context only, name its sources by their [number], and say so if it does not hold the answer."


def block(id: Column, c: Column) -> Column:
    """The text of one retrieved chunk (a struct) under a citation id."""
    symbol = F.coalesce(F.nullif(c["symbol_name"], F.lit("")), F.lit(NO_SYMBOL))
    return F.concat(
        F.lit("["), id, F.lit("]\nFile: "), c["file_path"], F.lit("\nLines: "), c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string"),
        F.lit("\nSymbol: "), symbol, F.lit("\nLanguage: "), c["language"], F.lit("\ncontent:\n"), c["content"], F.lit("\n"),
    )


CHUNK = ["rank", "chunk_id", "file_path", "start_line", "end_line", "symbol_name", "language", "content"]


def pack(results: DataFrame, config: ContextConfig = ContextConfig()) -> DataFrame:
    """(query_id, content, citations, used_chunk_count, context_char_count) of results (query_id, *CHUNK): whole blocks in
    order of rank while they fit; one that does not is skipped and later ones are still tried."""
    by = results.where(F.col("rank") <= config.max_chunks).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*CHUNK))).alias("chunks"))
    cite = "array<struct<citation_id:string,file_path:string,start_line:int,end_line:int,symbol_name:string,chunk_id:string>>"
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<string>").alias("blocks"), F.array().cast(cite).alias("citations"))

    def add(acc: Column, c: Column) -> Column:
        id = (F.size(acc["citations"]) + 1).cast("string")
        one = block(id, c)
        cited = F.struct(id.alias("citation_id"), c["file_path"].alias("file_path"), c["start_line"].cast("int").alias("start_line"), c["end_line"].cast("int").alias("end_line"), c["symbol_name"].alias("symbol_name"), c["chunk_id"].alias("chunk_id"))
        more = F.struct((acc["size"] + F.length(one)).alias("size"), F.array_append(acc["blocks"], one).alias("blocks"), F.array_append(acc["citations"], cited).alias("citations"))
        return F.when(acc["size"] + F.length(one) > config.max_chars, acc).otherwise(more)

    packed = by.select("query_id", F.aggregate("chunks", start, add).alias("x"))
    content = F.array_join("x.blocks", "\n")
    return packed.select("query_id", content.alias("content"), "x.citations", F.size("x.citations").alias("used_chunk_count"), F.length(content).alias("context_char_count"))


def prompt(question: Column, content: Column) -> Column:
    return F.concat(F.lit(QUESTION + "\n"), question, F.lit(f"\n\n{CONTEXT}\n"), content, F.lit(f"\n\n{REQUEST}"))


def validated(answers: DataFrame) -> DataFrame:
    """answers (answer, citations, ...) with unknown markers removed, and sources: the citations in order of first use."""
    known = F.transform("citations", lambda c: c["citation_id"])
    used = text.cited_ids(F.col("answer"), known)
    sources = F.transform(used, lambda id: F.element_at(F.filter("citations", lambda c: c["citation_id"] == id), 1))
    return answers.withColumn("sources", sources).withColumn("answer", text.without_unknown_citations(F.col("answer"), known))


def answer(questions: DataFrame, contexts: DataFrame, generator: Callable[[Column], Column]) -> DataFrame:
    """Answers for questions (query_id, question) from contexts (of `pack`): a fixed one where there is no context, else
    the generator's (a function of the prompt column), with checked citations. A blank question raises an error."""
    blank = F.raise_error(F.lit("a question must not be blank")).cast("string")
    rows = questions.withColumn("question", F.when(F.trim("question") == "", blank).otherwise(F.col("question"))).join(contexts, "query_id", "left")
    some = F.coalesce(F.col("content") != "", F.lit(False))
    # the generator only ever sees rows that have a context
    asked = validated(rows.where(some).withColumn("answer", generator(prompt(F.col("question"), F.col("content")))))
    columns = ["query_id", "answer", "used_chunk_count", "context_char_count", "sources"]
    none = rows.where(~some).select("query_id", F.lit(INSUFFICIENT).alias("answer"), F.lit(0).alias("used_chunk_count"), F.lit(0).alias("context_char_count"), F.array().cast(asked.schema["sources"].dataType).alias("sources"))
    return asked.select(*columns).unionByName(none)
