"""BM25 in a grid of cells: the scores of the definition, whatever cells the grid has, and pairs and postings that are not moved."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import lexical

CHUNKS = "repository_id string, chunk_id string, file_path string, language string, symbol_name string, content string"
ASKED = "query_id int, repository_id string, text string"


def made():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["getUserById", "JWT_SECRET", "2abc", "İstanbul", "Kelvin", "é1"]
    rows = [(f"r{i % 2}", f"{i:03d}", f"f{i % 5}.md", "ab"[i % 2], [None, "", "aSymbol"][i % 3], " ".join(rng.choices(words, k=rng.randrange(20)))) for i in range(200)]
    # copies, whose scores tie, ids that occur twice, rows without an id or a repository
    rows += [("r0", f"copy{i}", "c.md", "a", None, "w1 w2 w3") for i in range(40)] + [("r0", "000", "again.md", "a", None, "w1 w1 w9")]
    return [*rows, ("r0", None, "x", "a", None, "w1"), (None, "n", "x", "a", None, "w1"), ("r0", "null", "e", "b", None, None)]


ASKS = [(1, "r0", "w1 w2 w1"), (1, "r1", "w3"), (2, "r0", "getuserbyid secret 2"), (3, "r0", "absent"), (4, "r0", ""), (5, "r1", " ".join(f"w{i}" for i in range(30))), (6, "gone", "w1"), (7, "r0", "w5"), (7, "r0", "w5 w6"), (None, "r0", "md")]


def expected(spark, rows, asks, limit, keep=lambda r: True, digits=6):
    tokens = [r.t for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {CHUNKS}").orderBy("i").select(text.code_tokens(text.searchable_text(F.col("file_path"), F.col("symbol_name"), F.col("content"))).alias("t")).collect()]
    words = [r.t for r in spark.createDataFrame([(i, *r) for i, r in enumerate(asks)], f"i int, {ASKED}").orderBy("i").select(F.array_distinct(text.code_tokens(F.col("text"))).alias("t")).collect()]
    tf = Counter((r[0], r[1], t) for r, ts in zip(rows, tokens) for t in ts)
    df = Counter((repo, t) for repo, _, t in tf)
    scores = Counter()
    for (q, repo, _), ts in zip(asks, words):
        lengths = [len(x) for r, x in zip(rows, tokens) if r[0] == repo]
        for r, x in zip(rows, tokens):
            if r[0] == repo and r[1] is not None and keep(r):
                for t in ts:
                    if f := tf[repo, r[1], t]:
                        n, d = len(lengths), df[repo, t]
                        scores[q, repo, r[1]] += math.log(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(x) / (sum(lengths) / n)))
    out = []
    for q in {q for q, _, _ in scores}:
        best = sorted(((-round(s, digits), c) for (k, _, c), s in scores.items() if k == q))[:limit]
        out += [(str(q), k + 1, c, round(-s, digits)) for k, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("filters", [None, {"language": "b"}])
def test_scores_are_those_of_the_definition(spark, monkeypatch, small, filters):
    if small:  # many cells, and many steps in each
        for name, value in (("POSTINGS", 50), ("QUESTIONS", 5), ("HITS", 200), ("HELD", 40)):
            monkeypatch.setattr(lexical, name, value)
    rows = made()
    index = lexical.build_index(spark.createDataFrame(rows, CHUNKS).repartition(3))
    got = lexical.search(index, spark.createDataFrame(ASKS, ASKED), 5, filters, digits=6)
    keep = (lambda r: r[3] == "b") if filters else (lambda r: True)
    assert sorted((str(r.query_id), r["rank"], r.chunk_id, round(r.score, 6)) for r in got.collect()) == expected(spark, rows, ASKS, 5, keep)


def test_postings_are_counted_where_their_chunk_is(spark):
    rows = made()
    index = lexical.build_index(spark.createDataFrame(rows, CHUNKS).repartition(3))
    got = Counter({(r.repository_id, r.chunk_id, r.term): r.tf for r in index.postings.collect()})
    tokens = lexical.text.code_tokens(text.searchable_text(F.col("file_path"), F.col("symbol_name"), F.col("content")))
    want = Counter((r.repository_id, r.chunk_id, t) for r in spark.createDataFrame(rows, CHUNKS).select("repository_id", "chunk_id", tokens.alias("t")).collect() for t in r.t)
    assert got == want and index.postings.count() == len(want)
    # only repeated ids are gathered; their share is a table of its own, here of one id
    assert index.postings._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_pairs_of_queries_and_chunks_are_no_rows(spark):
    rows = [("r", f"{i:04d}", "f", "a", None, f"common w{i % 7}") for i in range(1000)]
    index = lexical.build_index(spark.createDataFrame(rows, CHUNKS))
    asked = spark.createDataFrame([(k, "r", "common") for k in range(50)], ASKED)
    found = lexical.search(index, asked, 3, digits=6)
    assert found.count() == 150
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.index("FlatMapGroupsInArrow") > plan.index("Window")


def test_cells_are_dealt_one_by_one_where_the_grid_is_not_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("r", f"{i}", "f", "a", None, f"common w{i % 7}") for i in range(20)]
        found = lexical.search(lexical.build_index(spark.createDataFrame(rows, CHUNKS)), spark.createDataFrame([(1, "r", "common")], ASKED), 3, digits=6)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # a join by repository does not deal the cells
    assert plan.index("FlatMapGroupsInArrow") < plan.index("hashpartitioning(cell#")
