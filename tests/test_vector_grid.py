"""Vector search in a grid of cells, against scores of all pairs as column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, vectors


def by_pairs(points, queries, limit, threshold, digits):
    q = queries.select("query_id", "repository_id", F.col("vector").alias("w"), vectors.norm(F.col("vector")).alias("m"))
    length = F.col("norm") * F.col("m")
    cosine = F.when(length == 0, 0.0).otherwise(vectors.dot(F.col("vector"), F.col("w")) / length)
    rows = points.join(q, "repository_id").select("query_id", "repository_id", "chunk_id", lexical.rounded(cosine, digits).alias("score"))
    return lexical.ranked(rows if threshold is None else rows.where(F.col("score") >= threshold), "query_id", limit)


def found(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, str(r.score)) for r in df.collect())


@pytest.mark.parametrize(("kind", "threshold", "digits"), [("float", None, 6), ("double", 0.2, 6), ("double", None, 2), ("float", None, None), ("float", 0.0, 3)])
def test_cells_find_what_all_pairs_give(spark, monkeypatch, kind, threshold, digits):
    monkeypatch.setattr(vectors, "QUERY_VALUES", 80)
    monkeypatch.setattr(vectors, "POINT_VALUES", 800)
    r = random.Random(7)
    make = lambda: [r.gauss(0, 1) for _ in range(8)]
    odd = [[0.0] * 8, [], [1.0, 2.0], None, [1.0, None] + [0.5] * 6, [float("nan")] + [0.5] * 7, [float("inf")] + [0.5] * 7, [1e-30] * 8]
    made = [("a", f"{i}", make()) for i in range(700)] + [("a", f"o{i}", v) for i, v in enumerate(odd)] + [("few", f"{i}", v) for i, v in enumerate(odd[:6])] + [(None, "n", make())]
    # copies, whose ties go to the smaller id, and near ones that rounding makes equal
    made += [("a", f"c{i}", made[3][2]) for i in range(90)] + [("a", f"d{i}", [x + r.gauss(0, 1e-7) for x in made[4][2]]) for i in range(60)]
    points = vectors.prepared(spark.createDataFrame(made, f"repository_id string, chunk_id string, vector array<{kind}>").repartition(3))
    asked = [(i, "a", v[2]) for i, v in enumerate(made[:40])] + [(100 + i, x, v) for x, n in (("a", 100), ("few", 200)) for i, v in enumerate(odd, n)] + [(400, "absent", make()), (401, None, make())]
    queries = spark.createDataFrame(asked, f"query_id int, repository_id string, vector array<{kind}>").repartition(2)
    for limit in (1, 7):
        got = vectors.search(points, queries, limit, threshold, None, digits)
        assert found(got) == found(by_pairs(points, queries, limit, threshold, digits))
    assert vectors._best(points, vectors.prepared(queries), 1, None, 6).where("query_id = 3").count() > 5


def test_pairs_are_no_rows(spark):
    rows = spark.range(3000).selectExpr("'a' AS repository_id", "cast(id AS string) AS chunk_id", "array(cast(sin(id) AS float), cast(cos(id) AS float), 1.0F) AS vector")
    queries = rows.where("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "repository_id", "vector")
    plan = vectors.search(vectors.prepared(rows), queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "zip_with" not in plan
