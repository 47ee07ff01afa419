"""Open metadata: typed filters, and metadata that survives a write and filters both legs."""

import pytest
from lodestone.functions import payload
from lodestone.operators import vectors
from lodestone.plans.engine import Engine
from pyspark.sql import functions as F

ROWS = ['{"a": 1, "b": true, "c": "1", "it\'s \\"odd\\" [x]?": "y", "n": {"a": 1}, "l": [1], "z": null, "f": 1.0}', '{"a": "1", "b": 1, "c": 1}', "[1]", "7", "no json", None, "{}"]


@pytest.mark.parametrize(
    "key, value, hits",
    [("a", 1, [0]), ("a", "1", [1]), ("a", True, []), ("b", True, [0]), ("b", 1, [1]), ("b", False, []), ("c", "1", [0]), ("c", 1, [1]), ('it\'s "odd" [x]?', "y", [0]), ('it\'s "odd" [x]?', "x", []),
     ("n", 1, []), ("n.a", 1, []), ("l", 1, []), ("z", None, []), ("f", 1.0, []), ("unknown", "y", []), ("", 1, [])],
)
def test_filters_are_typed(spark, key, value, hits):
    rows = spark.createDataFrame([(i, j) for i, j in enumerate(ROWS)], "id int, j string").select("id", payload.payload(F.col("j")).alias("metadata"))
    assert sorted(r.id for r in rows.where(payload.same(F.col("metadata"), key, value)).collect()) == hits
    assert rows.where(payload.same(F.col("metadata"), key, value).isNull()).count() == 0


def test_fields_win_and_unknown_names_match_nothing(spark):
    rows = spark.createDataFrame([("x", '{"lang": "y", "k": 1}')], "lang string, j string").withColumn("metadata", payload.payload(F.col("j")))
    n = lambda f, df: df.where(payload.meets(f, df.columns, ["lang"])).count()
    assert [n(f, rows) for f in ({"lang": "x"}, {"lang": "y"}, {"k": 1}, {"lang": "x", "k": 2}, {"other": 1}, None)] == [1, 0, 1, 0, 0, 1]
    assert n({"k": 1}, rows.drop("metadata")) == 0
    with pytest.raises(ValueError, match="repository"):
        vectors.criteria({"repository_id": "r"}, [])


def files(spark, owner):
    texts = [("src/auth.py", "Python", "def validate_token(token):\n    return token\n", f'{{"owner": "{owner}", "level": 3, "open": true}}'), ("README.md", "Markdown", "# Tokens\n\nHow validate_token works.\n", '{"owner": "docs", "level": 3, "open": false}'), ("x.md", "Markdown", "# validate_token\n\nNothing else.\n", None)]
    rows = spark.createDataFrame([("r", *t, len(t[2]), 2) for t in texts], "repository_id string, path string, language string, content string, j string, size_bytes long, line_count int")
    return rows.withColumn("metadata", payload.payload(F.col("j"))).drop("j")


def test_metadata_survives_a_write_and_filters_both_legs(spark, tmp_path):
    e, url = Engine(spark, str(tmp_path / "t")), "https://github.com/o/open.git"
    assert e.index(files(spark, "core"), url, "open", 1) == "completed"
    id = e.registry().first().repository_id
    asked = spark.createDataFrame([(1, id, "validate_token")], "query_id int, repository_id string, text string")
    found = lambda **m: sorted({r.file_path for r in e.search(asked, metadata=m).collect()})
    assert found() == ["README.md", "src/auth.py", "x.md"]
    assert found(level=3) == ["README.md", "src/auth.py"] and found(level=3, open=True) == ["src/auth.py"]
    assert found(owner="docs") == ["README.md"] and found(owner="core", open=False) == [] and found(level="3") == [] and found(nothing=1) == []
    # metadata alone changes a file
    assert e.index(files(spark, "core"), url, "open", 2) == "unchanged"
    assert e.index(files(spark, "web"), url, "open", 3) == "completed"
    assert found(owner="core") == [] and found(owner="web") == ["src/auth.py"] and found(owner="docs") == ["README.md"]
    e.compact(id)
    assert found(owner="web") == ["src/auth.py"] and found(level=3) == ["README.md", "src/auth.py"]
    # files without metadata lose it
    assert e.index(files(spark, "web").drop("metadata"), url, "open", 4) == "completed"
    assert found(level=3) == [] and len(found()) == 3
