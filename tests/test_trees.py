"""The data source over repository trees: what it gives, and what it never opens."""

import os

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.sources import files as sources
from lodestone.sources import trees


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "all"
    for repository, path, data in [
        ("a", "main.py", b"x = 1\n"), ("a", "src/deep/er/util.go", b"package er\n"), ("a", "src/big.py", b"#" * 500), ("a", "docs/read.md", b"# A\n"),
        ("a", "node_modules/lib/i.js", b"1"), ("a", "src/x.min.js", b"1"), ("a", "src/.env.py", b"1"), ("a", "src/picture.png", b"1"), ("a", "src/nul.c", b"a\0b"),
        ("b", "main.py", b"y = \xff\n"), ("b", "empty.sql", b""), ("build", "x.py", b"z"),
    ]:
        place = top / repository / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)
    (top / "loose.py").write_bytes(b"no repository")
    (tmp_path / "secret.py").write_bytes(b"outside")
    os.symlink(tmp_path / "secret.py", top / "a" / "out.py")
    os.symlink(top / "a" / "main.py", top / "a" / "link.py")
    os.symlink(tmp_path, top / "a" / "around")
    os.symlink(tmp_path / "nothing.py", top / "a" / "broken.py")
    return top


def names(df):
    return sorted((r.repository_id, r.path) for r in df.select("repository_id", "path").collect())


ALL = [("a", "docs/read.md"), ("a", "link.py"), ("a", "main.py"), ("a", "src/deep/er/util.go"), ("a", "src/nul.c"), ("b", "empty.sql"), ("b", "main.py"), ("build", "x.py")]


@pytest.mark.parametrize(("splits", "shares"), [(1, 1), (2, 1), (2, 3), (64, 4)])
def test_files_of_every_repository_once(spark, root, splits, shares):
    df = trees.read_repositories(spark, str(root), max_file_bytes=100, splits=splits, shares=shares)
    assert names(df) == ALL and df.rdd.getNumPartitions() <= splits * shares
    content = {(r.repository_id, r.path): (bytes(r.content), r.size_bytes) for r in df.collect()}
    assert content["a", "link.py"] == (b"x = 1\n", 6) and content["b", "empty.sql"] == (b"", 0) and content["b", "main.py"] == (b"y = \xff\n", 6)


def test_included_equals_that_of_the_plain_reader(spark, root):
    mine = sources.included(trees.read_repositories(spark, f"file://{root}/b", "r"))
    plain = sources.included(sources.read_tree(spark, str(root / "b"), "r"))
    order = lambda df: [tuple(r) for r in df.orderBy("path").collect()]
    assert order(mine.where("size_bytes > 0")) == order(plain) and len(order(plain)) == 1
    assert [tuple(r) for r in mine.where("size_bytes = 0").collect()] == [("r", "empty.sql", "SQL", "", 0, 0)]


def test_pushed_filters_keep_files_unread(spark, root, monkeypatch):
    reader = trees.PushedReader({"path": str(root), "max_file_bytes": "100"})
    left = list(reader.pushFilters([ds.EqualTo(("repository_id",), "a"), ds.StringStartsWith(("path",), "src/"), ds.LessThan(("size_bytes",), 11), ds.EqualTo(("content",), b""), ds.IsNull(("path",))]))
    assert [type(f) for f in left] == [ds.EqualTo, ds.IsNull]
    opened, real = [], open
    monkeypatch.setattr("builtins.open", lambda p, *a, **k: opened.append(str(p)) or real(p, *a, **k))
    entered, scan = [], os.scandir
    monkeypatch.setattr(trees.os, "scandir", lambda p: entered.append(os.path.relpath(p, root)) or scan(p))
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [r["path"] for r in rows] == ["src/nul.c"]
    assert [os.path.relpath(p, root) for p in opened if str(root) in p] == ["a/src/nul.c"]
    assert not any(p.startswith(("b", "a/docs", "a/node_modules", "a/around")) for p in entered)


def test_spark_pushes_filters(spark, root):
    setting = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(setting, "true")
    try:
        df = trees.read_repositories(spark, str(root)).where((F.col("size_bytes") <= 6) & F.col("path").startswith("m"))
        assert names(df) == [("a", "main.py"), ("b", "main.py")]
        assert ") Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(setting)
    df = trees.read_repositories(spark, str(root)).where((F.col("size_bytes") <= 6) & F.col("path").startswith("m"))
    assert names(df) == [("a", "main.py"), ("b", "main.py")]


def test_roots(spark, tmp_path, root):
    (tmp_path / "none").mkdir()
    assert trees.read_repositories(spark, str(tmp_path / "none")).count() == 0
    assert names(trees.read_repositories(spark, str(root), prefix="src/")) == [("a", "src/big.py"), ("a", "src/deep/er/util.go"), ("a", "src/nul.c")]
    for bad in ({"path": str(tmp_path / "missing")}, {"path": "s3a://x/y"}, {}, {"path": str(root), "splits": "0"}):
        with pytest.raises((ValueError, FileNotFoundError)):
            trees.TreeReader(bad)


def test_rules_for_strings_equal_those_for_columns(spark):
    given = ["a.py", ".py", "a..py", "A.PY", "dist/a.py", "x/dist", "dist", "a/build/b/c.ts", ".env", ".ENV.py", "a.MIN.js", "a.generated.go", "a.map", "a.js.map", "a", "a.", "x/.min.py", "vendor.py", "a b/c.Md", "é.rs", "x.tar.gz", "__pycache__/m.py", "src/.hidden.py"]
    rows = spark.createDataFrame([(p,) for p in given], "path string").select("path", (~paths.ignored_path(F.col("path")) & paths.language(F.col("path")).isNotNull()).alias("ok"))
    assert {r.path: r.ok for r in rows.collect()} == {p: trees.wanted(p) for p in given}


def test_tables_as_trees(spark, tmp_path):
    rows = [("a", "x.py", b"1"), ("a", "d/e.md", None), ("b", "x.py", b"2"), ("b", "x.py", b"2")]
    df = spark.createDataFrame(rows, "repository_id string, path string, content binary").repartition(3)
    for _ in range(2):
        assert trees.write_repositories(df, f"file://{tmp_path}/t") == 4
    got = trees.read_repositories(spark, str(tmp_path / "t")).collect()
    assert sorted((r.repository_id, r.path, bytes(r.content)) for r in got) == [("a", "d/e.md", b""), ("a", "x.py", b"1"), ("b", "x.py", b"2")]
    for repository, path in (("..", "x.py"), ("a", "../x.py"), ("a/b", "x.py"), ("a", ""), ("a", "/etc/x.py"), (None, "x.py")):
        with pytest.raises(Exception, match="no path below a repository"):
            trees.write_repositories(spark.createDataFrame([(repository, path, b"")], "repository_id string, path string, content binary"), str(tmp_path / "u"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "u"] and trees.write_repositories(df.limit(0), str(tmp_path / "u")) == 0
