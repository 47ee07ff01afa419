import random

import pytest
from lodestone.config import ChunkConfig, ContextConfig, HybridConfig, RerankConfig
from lodestone.operators import chunking, context, conversation, evaluation, fusion, lexical, rerank, store, vectors
from lodestone.sources import files as sources
from pyspark.sql import functions as F


def spans(lengths, limit, overlap):
    """Lines packed greedily, one restart after the other."""
    out, i, n = [], 0, len(lengths)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + lengths[j] <= limit):
            size += lengths[j]
            j += 1
        out.append((i, j))
        if j >= n:
            break
        i = max(i + 1, j - overlap)
    return out


@pytest.mark.parametrize(("limit", "overlap"), [(5, 0), (30, 2), (12, 1), (7, 3)])
def test_line_spans(limit, overlap):
    r = random.Random(limit)
    cases = [[2, 2, 2, 2], [10, 10, 10, 100], [], [1]] + [[r.randint(1, 14) for _ in range(r.randint(1, 25))] for _ in range(60)]
    for c in cases:
        assert chunking.line_spans(c, ChunkConfig(limit, overlap)) == spans(c, limit, overlap), c


def chunks_of(spark, path, language, content, config=ChunkConfig()):
    rows = spark.createDataFrame([("r", path, language, content)], "repository_id string, path string, language string, content string")
    got = chunking.chunk_files(rows, config).collect()
    return sorted((c.start_line, c.end_line, c.chunk_type, c.symbol_name) for c in got)


def test_python_chunks(spark):
    source = "import os\n\n\nclass Greeter:\n    def hi(self):\n        return 1\n\n\ndef add(a, b):\n    return a + b\n"
    assert chunks_of(spark, "m.py", "Python", source) == [(1, 1, "import", None), (4, 6, "class", "Greeter"), (9, 10, "function", "add")]
    # constants are in no chunk, comments are; large classes go by method
    assert chunks_of(spark, "m.py", "Python", "X = 1\n# note\n") == [(2, 2, "module", None)]
    large = chunks_of(spark, "m.py", "Python", source, ChunkConfig(max_chars=40))
    assert (5, 6, "method", "Greeter.hi") in large and (4, 4, "class", "Greeter") in large
    assert chunks_of(spark, "m.py", "Python", "def broken(:\n") == [(1, 1, "fallback", None)]


def test_markdown_chunks(spark):
    text = "# A\n\none\n\n## B\n\ntwo\n\n### C\n\nthree\n"
    assert chunks_of(spark, "r.md", "Markdown", text) == [(1, 4, "markdown_section", "A"), (5, 8, "markdown_section", "B"), (9, 11, "markdown_section", "C")]
    assert chunks_of(spark, "r.md", "Markdown", "intro\n#\n") == [(1, 1, "fallback", None), (2, 2, "markdown_section", None)]
    assert chunks_of(spark, "r.md", "Markdown", "no headings\n") == [(1, 1, "fallback", None)]
    assert chunks_of(spark, "x.txt", "Go", "") == []


def test_tree_reading(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.bin.py": b"a\x00b", "node_modules/c.js": b"1", "sub/d.md": b"# h\n\xff", "e.txt": b"t"}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = sources.included(sources.read_tree(spark, str(tmp_path / "repo"), "r"))
    assert {(r.path, r.language, r.line_count) for r in rows.collect()} == {("a.py", "Python", 1), ("sub/d.md", "Markdown", 2)}
    assert sources.guarded(rows).first().file_count == 2
    with pytest.raises(Exception, match="exceeds"):
        sources.guarded(rows, sources.IngestConfig(max_files=1)).collect()


def test_fusion_prefers_what_both_find(spark):
    leg = lambda *rows: spark.createDataFrame(list(rows), "query_id int, chunk_id string, rank int")
    got = fusion.fuse(leg((1, "semantic", 1), (1, "shared", 2), (1, "shared", 3)), leg((1, "shared", 1), (1, "other", 2)), HybridConfig(rrf_k=10), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.vector_rank, r.bm25_rank) for r in got] == [("shared", 2, 1), ("semantic", 1, None), ("other", None, 2)]


def candidates(spark, scores):
    return spark.createDataFrame([(1, "q", c, f"text {s}", f, i + 1) for i, (c, f, s) in enumerate(scores)], "query_id int, question string, chunk_id string, content string, fused_score double, rank int")


def test_rerank(spark):
    rows = candidates(spark, [("a", 0.8, 0.2), ("b", 0.7, 0.9), ("c", 0.6, 0.5)])
    scorer = lambda q, c: F.struct(F.split(c, " ")[1].cast("double").alias("score"), F.lit(True).alias("ok"))
    assert [r.chunk_id for r in rerank.rerank(rows, scorer, RerankConfig(final=2)).orderBy("rank").collect()] == ["b", "c"]
    fails = lambda q, c: F.struct(F.lit(1.0).alias("score"), F.lit(False).alias("ok"))
    assert [r.relevance_score for r in rerank.rerank(rows, fails).orderBy("rank").collect()] == [0.8, 0.7, 0.6]
    with pytest.raises(Exception, match="reranker failed"):
        rerank.rerank(rows, fails, RerankConfig(fail_open=False)).collect()


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, i + 1, f"c{i}", f"f{i}", 1, 2, None, "en", "x" * n) for i, n in enumerate([20, 500, 30])]
    df = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, file_path string, start_line int, end_line int, symbol_name string, language string, content string")
    got = context.pack(df, ContextConfig(max_chars=220)).first()
    assert [(c.citation_id, c.chunk_id) for c in got.citations] == [("1", "c0"), ("2", "c2")]
    assert got.content.startswith("[1]\nFile: f0\nLines: 1-2\nSymbol: <module>\nLanguage: en\ncontent:\n") and got.context_char_count == len(got.content)


def test_history_is_bounded_and_apart(spark):
    rows = spark.createDataFrame([("r", c, i, "user", f"m{i}") for c in "ab" for i in range(5)], "repository_id string, conversation_id string, seq long, role string, content string")
    kept = conversation.retained(rows, conversation.ConversationConfig(history=2)).groupBy("conversation_id").count().collect()
    assert {(r.conversation_id, r["count"]) for r in kept} == {("a", 2), ("b", 2)}
    said = conversation.standalone(conversation.with_history(rows), lambda p: F.lit("  ")).where("query <> content").count()
    assert said == 0


def test_metrics(spark):
    cases = spark.createDataFrame([("1", ["a"], []), ("2", ["a"], ["s"])], "case_id string, expected_file_paths array<string>, expected_symbols array<string>")
    found = spark.createDataFrame([("m", "1", 1, "c1", "a", None), ("m", "2", 1, "c1", "a", "t"), ("m", "2", 2, "c2", "a", "s")], "method string, case_id string, rank int, chunk_id string, file_path string, symbol_name string")
    got = evaluation.metrics(evaluation.judged(found, cases)).first()
    assert (got.recall_at_1, got.recall_at_3, got.mrr, got.precision_at_1) == (0.5, 1.0, 0.75, 0.5)


def test_another_repository_changes_nothing(spark):
    row = lambda r, i, t: (r, f"{r}{i}", f"p{i}", "en", None, "fallback", t)
    schema = "repository_id string, chunk_id string, file_path string, language string, symbol_name string, chunk_type string, content string"
    one = [row("a", i, t) for i, t in enumerate(["getUserById", "authenticateUser now", "other text"])]
    asked = spark.createDataFrame([(1, "a", "user")], "query_id int, repository_id string, text string")
    search = lambda rows: [tuple(r) for r in lexical.search(lexical.build_index(spark.createDataFrame(rows, schema)), asked, 5).orderBy("rank").collect()]
    assert search(one) == search(one + [row("b", 1, "user user user")])
    assert len(search(one)) == 2


def test_vector_edges(spark):
    points = vectors.prepared(spark.createDataFrame([("r", "a", [1.0, 0.0]), ("r", "z", [0.0, 0.0]), ("x", "o", [1.0, 0.0])], "repository_id string, chunk_id string, vector array<double>"))
    asked = spark.createDataFrame([(1, "r", [2.0, 0.0])], "query_id int, repository_id string, vector array<double>")
    assert [(r.chunk_id, r.score) for r in vectors.search(points, asked, 5).orderBy("rank").collect()] == [("a", 1.0), ("z", 0.0)]
    with pytest.raises(ValueError):
        vectors.search(points, asked, 5, filters={"repository_id": "x"})
    with pytest.raises(ValueError):
        store.checked(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>"))


def test_repository_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    store.write_repository(spark.createDataFrame([("a", "1"), ("b", "2")], "repository_id string, chunk_id string"), path)
    store.write_repository(spark.createDataFrame([("a", "3")], "repository_id string, chunk_id string"), path)
    assert {(r.repository_id, r.chunk_id) for r in spark.read.parquet(path).collect()} == {("a", "3"), ("b", "2")}
