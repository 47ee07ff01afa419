import pytest
from lodestone.config import IngestConfig
from lodestone.functions import providers
from lodestone.operators import evaluation
from lodestone.plans.engine import Engine
from pyspark.sql import functions as F


def files(spark, extra=""):
    rows = [("r", "src/auth.py", "Python", "def validate_token(token):\n    return token\n" + extra), ("r", "README.md", "Markdown", "# Tokens\n\nHow tokens are validated.\n")]
    return spark.createDataFrame([(*r, len(r[3]), 2) for r in rows], "repository_id string, path string, language string, content string, size_bytes long, line_count int")


def test_index_search_answer_chat(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "tables"))
    assert e.index(files(spark), "https://github.com/o/demo.git", "demo", 1) == "completed"
    assert e.index(files(spark), "https://github.com/o/demo.git", "demo", 2) == "unchanged"
    assert e.index(files(spark, "\ndef other():\n    pass\n"), "https://github.com/o/demo.git", "demo", 3) == "completed"
    assert e.index(files(spark), "https://github.com/o/next.git", "next", 1) == "completed"
    rows = e.registry().collect()
    assert [(r.repository_name, r.version, r.file_count) for r in rows] == [("demo", 3, 2), ("next", 1, 2)]
    id = rows[0].repository_id
    asked = spark.createDataFrame([(1, id, "validate_token")], "query_id int, repository_id string, text string")
    found = e.search(asked, 2).orderBy("rank").collect()
    assert found[0].symbol_name == "validate_token" and {r.repository_id for r in found} == {id}
    assert e.search(asked, language="Markdown").select("file_path").distinct().collect()[0].file_path == "README.md"
    answer = e.answer(asked).first()
    assert answer.answer == "The most relevant source is [1]." and answer.sources[0].symbol_name == "validate_token"
    assert e.explain_file(id, "src//auth.py").first().used_chunk_count == 2
    history = spark.createDataFrame([], "repository_id string, conversation_id string, seq long, role string, content string")
    turns = spark.createDataFrame([(1, id, "c", "validate_token?")], "query_id int, repository_id string, conversation_id string, message string")
    answers, kept = e.chat(history, turns)
    assert answers.count() == 1
    assert [(r.role, r.content) for r in kept.orderBy("seq").collect()] == [("user", "validate_token?"), ("assistant", "The most relevant source is [1].")]


URL = "https://github.com/o/life.git"


def stages(spark, e):
    return [(r.stage, r.status, r.version) for r in e._table("registry").orderBy("recorded").collect()]


def test_stages_failures_and_deletion_are_recorded(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    e.index(files(spark), URL, "life", 1)
    assert stages(spark, e) == [("queued", "indexing", 1), ("ingesting", "indexing", 1), ("indexing", "indexing", 1), ("completed", "ready", 1)]
    id = e.registry().first().repository_id
    small = Engine(spark, e.root, ingest=IngestConfig(max_files=1))
    with pytest.raises(Exception, match="limits"):
        small.index(files(spark, "x = 1\n"), URL, "life", 2)
    failed = e.get(id)
    assert (failed.status, failed.version) == ("failed", 2) and failed.error
    assert e.index(files(spark), URL, "life", 3) == "completed"  # after a failure nothing counts as unchanged
    wide = Engine(spark, e.root, embedder=providers.hashing_embedder(16))
    with pytest.raises(ValueError, match="dimensions"):
        wide.index(files(spark), "https://github.com/o/wide.git", "wide", 1)
    assert e.delete(id, 4) and e.get(id) is None and not e.delete(id, 5)
    for name in ("points", "postings", "lengths", "repositories"):
        assert not (tmp_path / "t" / name / f"repository_id={id}").exists()


def test_a_repository_without_chunks_leaves_no_rows(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    e.index(files(spark), URL, "life", 1)
    e.index(files(spark), "https://github.com/o/next.git", "next", 1)
    empty = spark.createDataFrame([(None, "a.py", "Python", "X = 1\n", 6, 1)], files(spark).schema)
    id = next(r.repository_id for r in e.registry().collect() if r.repository_name == "life")
    assert e.index(empty, URL, "life", 2) == "completed"
    assert e._table("points").where(F.col("repository_id") == id).count() == 0 and e._table("points").count() > 0


def test_reports(spark):
    cases = spark.createDataFrame([("1", ["a"], [])], "case_id string, expected_file_paths array<string>, expected_symbols array<string>")
    none = spark.createDataFrame([], "method string, case_id string, rank int, chunk_id string, file_path string, symbol_name string")
    rows = evaluation.metrics(evaluation.judged(none, cases, ("bm25", "vector")))
    assert [(r.method, r.case_count, r.recall_at_1, r.mrr) for r in rows.orderBy("method").collect()] == [("bm25", 1, 0.0, 0.0), ("vector", 1, 0.0, 0.0)]
    nothing = evaluation.metrics(evaluation.judged(none, cases.limit(0), ("bm25", "vector")), ("bm25", "vector"))
    assert [(r.method, r.case_count, r.recall_at_10, r.mrr, r.precision_at_1) for r in nothing.orderBy("method").collect()] == [("bm25", 0, 0.0, 0.0, 0.0), ("vector", 0, 0.0, 0.0, 0.0)]
    import json

    report = json.loads(evaluation.json_report(rows, "run").first().json)
    assert report["run_name"] == "run" and report["methods"]["vector"]["precision_at_5"] == 0.0
    source = "array<struct<file_path:string,symbol_name:string>>"
    answers = spark.createDataFrame([("1", "q", "a [1]", "c", [("a", None)], ["a"], [])], f"case_id string, question string, answer string, content string, sources {source}, expected_file_paths array<string>, expected_symbols array<string>")
    judge = lambda q, a, c: F.struct(F.lit(0.5).alias("relevance"), F.lit(1.0).alias("groundedness"))
    assert tuple(evaluation.generation_metrics(answers, judge).first()) == (1, 1.0, 1.0, 0.5, 1.0)
    assert tuple(evaluation.generation_metrics(answers).first()) == (1, 1.0, 1.0, None, None)


def test_a_turn_without_conversation_begins_one(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    e.index(files(spark), URL, "life", 1)
    history = spark.createDataFrame([], "repository_id string, conversation_id string, seq long, role string, content string")
    turns = spark.createDataFrame([(1, e.registry().first().repository_id, None, "validate_token?")], "query_id int, repository_id string, conversation_id string, message string")
    _, kept = e.chat(history, turns)
    rows = kept.collect()
    assert len(rows) == 2 and len({r.conversation_id for r in rows}) == 1 and rows[0].conversation_id
