"""Retrieval and citation metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def relevant(path: Column, symbol: Column, paths: Column, symbols: Column) -> Column:
    """Whether a result's file is expected and, if symbols are, its symbol too."""
    return F.coalesce(F.array_contains(paths, path), F.lit(False)) & ((F.size(symbols) == 0) | F.coalesce(F.array_contains(symbols, symbol), F.lit(False)))


def judged(results: DataFrame, cases: DataFrame, methods: tuple[str, ...] | None = None) -> DataFrame:
    """Every case of every method with its results, if any: (method, case_id, rank, chunk_id, file_path, relevant). Methods
    that are named have their cases even without any result; else those of the results count."""
    if methods is None:
        methods = tuple(m.method for m in results.select("method").distinct().collect())  # a few
    all_cases = cases.withColumn("method", F.explode(F.array(*map(F.lit, methods)).cast("array<string>")))
    ok = relevant(F.col("file_path"), F.col("symbol_name"), F.col("expected_file_paths"), F.col("expected_symbols"))
    return all_cases.join(results, ["method", "case_id"], "left").select("method", "case_id", "rank", "chunk_id", "file_path", F.coalesce(ok & F.col("rank").isNotNull(), F.lit(False)).alias("relevant"))


def case_details(judged: DataFrame) -> DataFrame:
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", c)))), lambda x: x[c])
    return judged.groupBy("method", "case_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_relevant_rank"), ordered("chunk_id").alias("chunk_ids"), ordered("file_path").alias("file_paths"))


def metrics(judged: DataFrame, methods: tuple[str, ...] | None = None) -> DataFrame:
    """By method: recall_at_k (cases with a relevant result among the first k), mrr, precision_at_k (relevant results among
    the first k, by k). Methods that are named have a row of zeros where there are no cases."""
    cut = lambda k: F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"p{k}")
    by = judged.groupBy("method", "case_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), *[cut(k) for k in CUTS])
    share = lambda x: F.coalesce(F.round(F.avg(x.cast("double")), 9), F.lit(0.0))
    rows = by.groupBy("method").agg(
        F.count(F.lit(1)).alias("case_count"),
        *[share(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")).alias(f"recall_at_{k}") for k in CUTS],
        share(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
        *[share(F.col(f"p{k}") / F.lit(float(k))).alias(f"precision_at_{k}") for k in CUTS],
    )
    if methods is None:
        return rows
    named = judged.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    return named.join(rows, "method", "left").fillna(0)


def citation_metrics(answers: DataFrame) -> DataFrame:
    """answers (case_id, sources, expected_file_paths, expected_symbols) with citation_precision, null without sources, and
    citation_recall, null without expected paths."""
    ok = lambda s: relevant(s["file_path"], s["symbol_name"], F.col("expected_file_paths"), F.col("expected_symbols"))
    good = F.filter("sources", ok)
    precision = F.when(F.size("sources") > 0, F.size(good) / F.size("sources"))
    recall = F.when(F.size("expected_file_paths") > 0, F.size(F.array_distinct(F.transform(good, lambda s: s["file_path"]))) / F.size("expected_file_paths"))
    return answers.select("case_id", F.round(precision, 9).alias("citation_precision"), F.round(recall, 9).alias("citation_recall"))


def generation_metrics(answers: DataFrame, judge: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """One row for answers (case_id, question, answer, content, sources, expected_file_paths, expected_symbols): case_count, the
    means of citation precision and recall over the cases that have them, and, with a judge that gives struct(relevance,
    groundedness) of question, answer and content, their means; else those are null."""
    cited = citation_metrics(answers)
    given = judge(F.col("question"), F.col("answer"), F.col("content")) if judge else F.struct(F.lit(None).cast("double").alias("relevance"), F.lit(None).cast("double").alias("groundedness"))
    both = answers.select("case_id", given.alias("given")).join(cited, "case_id")
    mean = lambda c, name: F.round(F.avg(c), 9).alias(name)
    return both.agg(F.count(F.lit(1)).alias("case_count"), mean("citation_precision", "citation_precision"), mean("citation_recall", "citation_recall"), mean("given.relevance", "relevance"), mean("given.groundedness", "groundedness"))


def json_report(rows: DataFrame, run_name: str) -> DataFrame:
    """(json): one report of a run, its methods' metrics under their names, in order."""
    numbers = F.struct(*[c for c in rows.columns if c != "method"])
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", numbers.alias("metrics")))))  # a few methods
    return rows.agg(F.to_json(F.struct(F.lit(run_name).alias("run_name"), by.alias("methods")), {"ignoreNullFields": "false"}).alias("json"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """(line): a row of a Markdown table for each method; missing numbers as N/A."""
    cells = [F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("N/A")) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr", "precision_at_5")]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", "method", *cells), F.lit(" |")).alias("line"))
