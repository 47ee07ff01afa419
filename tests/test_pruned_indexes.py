"""The inverted file and the impact-ordered postings: results of the plain operators, with most rows never read."""

import random

import pytest

from lodestone.operators import impact, ivf, lexical, vectors

POINTS = "repository_id string, chunk_id string, vector array<float>, language string"
ASKED = "query_id int, repository_id string, vector array<float>"


def cloud(seed, n, clusters, spread=0.15, dim=8):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(middles)] for _ in range(n)]


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize(("threshold", "filters"), [(None, None), (0.9, None), (None, {"language": "b"})])
def test_an_inverted_file_gives_the_exact_result(spark, threshold, filters):
    made = [("big", f"{i:04d}", v, "ab"[i % 2]) for i, v in enumerate(cloud(1, 2000, 25))]
    made += [("small", f"{i}", v, "a") for i, v in enumerate(cloud(2, 30, 3))]
    # copies beyond a block, zero and opposite vectors, rows without one
    made += [("big", f"copy{i:03d}", made[0][2], "a") for i in range(300)] + [("big", "zero", [0.0] * 8, "b"), ("big", "none", None, "a"), ("big", "minus", [-x for x in made[0][2]], "b")]
    points = vectors.prepared(spark.createDataFrame(made, POINTS).repartition(4))
    asked = [(k, "big", v) for k, v in enumerate(cloud(3, 12, 12))] + [(50, "big", made[0][2]), (51, "big", [0.0] * 8), (52, "small", made[2005][2]), (53, "absent", made[0][2])]
    queries = spark.createDataFrame(asked, ASKED)
    index = ivf.build(points, cell=80, centres=64, block=50)
    got, work = ivf.searched(index, queries, 5, threshold, filters, digits=6)
    assert rows(got) == rows(vectors.search(points.where("vector IS NOT NULL"), queries, 5, threshold, filters, digits=6))
    shares = {r.query_id: r.points_read / r.points for r in work.collect()}
    assert shares[50] < 0.5 and sum(shares[k] for k in range(12)) / 12 < 0.9
    assert index.points.count() == len(made) - 1 and index.cells.where("repository_id = 'big'").count() > 10
    assert index.points.groupBy("repository_id", "cell", "block").count().agg({"count": "max"}).first()[0] < 120


def test_an_empty_inverted_file(spark):
    index = ivf.build(vectors.prepared(spark.createDataFrame([], POINTS)))
    assert ivf.search(index, spark.createDataFrame([(1, "a", [1.0])], ASKED), 5).count() == 0
    with pytest.raises(ValueError):
        ivf.search(index, spark.createDataFrame([], ASKED), 0)


CHUNKS = "repository_id string, chunk_id string, file_path string, language string, symbol_name string, content string"


def chunks(spark, n=1500):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    made = []
    for i in range(n):
        said = ["common"] * rng.randrange(6) + rng.choices(words, k=rng.randrange(30)) + (["rare"] * rng.randrange(1, 9) if i % 50 == 0 else [])
        made.append((f"r{i % 3 == 0}", f"{i:05d}", f"f{i}.md", "ab"[i % 2], None, " ".join(said)))
    return spark.createDataFrame([*made, ("r0", "empty", "e", "a", None, ""), ("r0", "null", "e", "a", None, None)], CHUNKS).repartition(4)


@pytest.mark.parametrize("filters", [None, {"language": "b"}, {"unknown": 1}])
def test_impact_ordered_postings_rank_alike(spark, filters):
    plain, index = lexical.build_index(chunks(spark)), impact.build(chunks(spark))
    texts = ["rare common", "common", "w1 w2 w3", "rare rare", "absent", "", "common w1 w2 w3 w4 w5 w6 w7 rare"]
    asked = spark.createDataFrame([(k, r, t) for k, t in enumerate(texts) for r in ["rTrue"]] + [(90, "rFalse", "rare common")], "query_id int, repository_id string, text string")
    got, work = impact.searched(index, asked, 5, filters, digits=6)
    assert rows(got) == rows(lexical.search(plain, asked, 5, filters, digits=6))
    if filters is None:
        read = {r.query_id: r.postings_read / r.postings for r in work.collect()}
        # a frequent term beside a rare one keeps its blocks, as the rare one's best could lift any of them
        assert read[1] < 0.2 and read[3] < 0.9 and all(x <= 1 for x in read.values())


def test_hashes_of_terms_reach_the_scan(spark):
    index = impact.build(chunks(spark, 60))
    asked = spark.createDataFrame([(1, "rTrue", "rare w1")], "query_id int, repository_id string, text string")
    plan = impact.search(index, asked, 3)._jdf.queryExecution().toString()
    assert "In(term_hash" in plan or "InSet" in plan or "term_hash IN" in plan
    hashes = [r.term_hash for r in index.postings.select("term_hash").collect()]
    # rows of a term lie together, its best first
    assert sum(a != b for a, b in zip(hashes, hashes[1:])) + 1 == len(set(hashes))


def test_blocks_are_those_of_all_postings_wherever_batches_end(spark):
    rows = ["term_hash", "repository_id", "term", "level"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        index = impact.build(chunks(spark))
        blocks = {tuple(r[c] for c in rows): r for r in index.blocks.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = index.postings.groupBy(*rows).agg({"impact": "max", "*": "count"}).collect()
    assert index.blocks.count() == len(blocks) == len(want)
    assert all((blocks[tuple(r)[:4]].top, blocks[tuple(r)[:4]].n) == (r["max(impact)"], r["count(1)"]) for r in want)
    most = {}
    for r in blocks.values():
        df, top = most.get(r.term_hash, (0, 0.0))
        most[r.term_hash] = (df + r.n, max(top, r.top))
    assert len({(r.term_hash, round(r.idf, 12)) for r in blocks.values()}) == len(most)
    assert all(r.term_top == most[r.term_hash][1] for r in blocks.values())
    # postings are not moved again for their blocks: only what lies at borders is aggregated
    assert "whole" in index.blocks._jdf.queryExecution().optimizedPlan().toString()


def test_cells_of_an_inverted_file_give_only_their_best(spark):
    made = [("r", f"{i:04d}", v, "a") for i, v in enumerate(cloud(5, 600, 4))]
    queries = spark.createDataFrame([(k, "r", v) for k, v in enumerate(cloud(6, 9, 4))], ASKED)
    index = ivf.build(vectors.prepared(spark.createDataFrame(made, POINTS)), cell=40, centres=64)
    asked = ivf.candidates(index, queries, 3).selectExpr("query_id", "repository_id", "cell", "blocks", "CAST(NULL AS double) AS floor")
    # all cells are asked for, and are one group: a query's three best of it are rows, not its pairs
    assert index.cells.count() > 5 and ivf._scored(index, queries, asked, 3, None, None, 6).count() == 27
