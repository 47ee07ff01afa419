"""Reports appear whole, in order, or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, reports

COLUMNS = "method string, case_count long, recall_at_1 double, recall_at_3 double, recall_at_5 double, recall_at_10 double, mrr double, precision_at_5 double"


def test_metrics_as_json_and_markdown(spark, tmp_path):
    results = spark.createDataFrame([("hybrid", "c1", 2, "x", "a.py", "f"), ("bm25", "c1", 1, "y", "b.py", "g")], "method string, case_id string, rank int, chunk_id string, file_path string, symbol_name string")
    cases = spark.createDataFrame([("c1", "q", ["a.py"], []), ("c2", "q", ["z.py"], [])], "case_id string, question string, expected_file_paths array<string>, expected_symbols array<string>")
    rows = evaluation.metrics(evaluation.judged(results, cases)).orderBy("method")
    reports.write_report(rows, str(tmp_path / "run"))
    got = json.loads((tmp_path / "run" / "retrieval-results.json").read_text())
    assert [r["method"] for r in got] == ["bm25", "hybrid"] and got == [r.asDict() for r in rows.collect()]
    assert (tmp_path / "run" / "retrieval-report.md").read_text() == (
        "# Retrieval evaluation report\n\n| Method | Recall@1 | Recall@3 | Recall@5 | Recall@10 | MRR | Precision@5 |\n|---|---:|---:|---:|---:|---:|---:|\n"
        "| bm25 | 0.000 | 0.000 | 0.000 | 0.000 | 0.000 | 0.000 |\n| hybrid | 0.000 | 0.500 | 0.500 | 0.500 | 0.250 | 0.100 |\n")
    assert sorted(os.listdir(tmp_path / "run")) == ["retrieval-report.md", "retrieval-results.json"]


def test_order_over_many_partitions_and_odd_values(spark, tmp_path):
    rows = [(f"c{i:03}" if i else "a|b\nc", None if i % 2 else i / 100, 0.5, None, 1.0, [f"s{i}"]) for i in range(100)]
    df = spark.createDataFrame(rows, "case_id string, citation_precision double, citation_recall double, relevance double, groundedness double, sources array<string>").repartition(7).orderBy("case_id")
    reports.write_report(df, str(tmp_path / "run"), "generation")
    got = json.loads((tmp_path / "run" / "generation-results.json").read_text())
    assert [tuple(r.values()) for r in got] == sorted(rows)
    lines = (tmp_path / "run" / "generation-report.md").read_text().splitlines()[4:]
    assert lines[0] == "| a\\|b c | 0.000 | 0.500 | N/A | 1.000 |" and len(lines) == 100 and lines[1] == "| c001 | N/A | 0.500 | N/A | 1.000 |"


def test_a_failed_run_leaves_the_last_report_or_none(spark, tmp_path):
    good = spark.createDataFrame([("m", 1, *[0.5] * 6)], COLUMNS)
    bad = spark.range(0, 200, 1, 4).select(F.when(F.col("id") == 190, F.raise_error(F.lit("no"))).otherwise(F.lit("m")).cast("string").alias("method"), F.lit(1).cast("long").alias("case_count"), *[F.lit(0.1).alias(c.split()[0]) for c in COLUMNS.split(", ")[2:]])
    with pytest.raises(Exception, match="no"):
        reports.write_report(bad, str(tmp_path / "run"))
    assert os.listdir(tmp_path) == []
    reports.write_report(good, str(tmp_path / "run"))
    before = (tmp_path / "run" / "retrieval-results.json").read_text()
    with pytest.raises(Exception, match="no"):
        reports.write_report(bad, str(tmp_path / "run"), overwrite=True)
    with pytest.raises(Exception, match="overwrite takes its place"):
        reports.write_report(good, str(tmp_path / "run"))
    assert (tmp_path / "run" / "retrieval-results.json").read_text() == before and len(os.listdir(tmp_path)) == 2
    reports.write_report(good.limit(0), str(tmp_path / "run"), overwrite=True)
    assert json.loads((tmp_path / "run" / "retrieval-results.json").read_text()) == [] and len(os.listdir(tmp_path)) == 2


def test_what_is_no_report_stays(spark, tmp_path):
    good = spark.createDataFrame([("m", 1, *[0.5] * 6)], COLUMNS)
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "file").write_text("kept")
    with pytest.raises(Exception, match="no report"):
        reports.write_report(good, str(tmp_path / "mine"), overwrite=True)
    for bad in (good.drop("mrr"), good):
        with pytest.raises(Exception, match="lack the columns|kind must be"):
            reports.write_report(bad, str(tmp_path / "new"), "retrieval" if "mrr" not in bad.columns else "other")
    assert (tmp_path / "mine" / "file").read_text() == "kept" and os.listdir(tmp_path) == ["mine"]


def test_two_first_runs(tmp_path):
    writers = [reports.ReportWriter({"path": str(tmp_path / "run")}, COLUMNS.replace(",", "").split()[::2], False) for _ in range(2)]
    writers[0].commit([])
    with pytest.raises(FileExistsError):
        writers[1].commit([])
    assert (tmp_path / "run" / "retrieval-results.json").read_text() == "[]\n" and len(os.listdir(tmp_path)) == 2
