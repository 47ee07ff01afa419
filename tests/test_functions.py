import hashlib
import uuid

import pytest
from lodestone.config import ChunkConfig, HybridConfig, LexicalConfig
from lodestone.functions import paths, providers, text
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("HTTPServer", ["httpserver"]),
        ("getUserById", ["getuserbyid", "get", "user", "by", "id"]),
        ("JWT_SECRET", ["jwt_secret", "jwt", "secret"]),
        ("__init__", ["__init__", "init"]),
        ("user2Name", ["user2name", "user2", "name"]),
        ("2abc", ["2", "abc"]),
        ("foo_foo", ["foo_foo", "foo", "foo"]),
        ("naïve", ["na", "ve"]),
        ("", []),
    ],
)
def test_code_tokens(spark, given, want):
    assert one(spark, text.code_tokens(F.lit(given))) == want


@pytest.mark.parametrize("url", ["http://github.com/a/b", "https://gitlab.com/a/b", "https://github.com/a", "https://github.com/a/b/c", "https://github.com/a/b?x=1", "https://u@github.com/a/b", "https://github.com:443/a/b", "https://github.com/a/.git"])
def test_bad_addresses(spark, url):
    assert one(spark, paths.repository_address(F.lit(url))) is None


def test_good_address(spark):
    got = one(spark, paths.repository_address(F.lit("https://GitHub.com/owner/repo.git")))
    assert (got.canonical_url, got.name) == ("https://github.com/owner/repo.git", "repo")


@pytest.mark.parametrize("path", ["../secret.py", "/etc/passwd", "src\\auth.py", "./src/auth.py", ""])
def test_bad_paths(spark, path):
    assert one(spark, paths.indexed_path(F.lit(path))) is None


def test_normal_path(spark):
    assert one(spark, paths.indexed_path(F.lit("a/./b//c.py"))) == "a/b/c.py"


@pytest.mark.parametrize("t", ["", "a", "a\n", "a\nb", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h i", "\n\n", "a\r\n\r\nb"])
def test_lines(spark, t):
    assert one(spark, text.lines(F.lit(t))) == t.splitlines(keepends=True)


@pytest.mark.parametrize("name", ["x", "chunk-1", "é", ""])
def test_point_id(spark, name):
    assert one(spark, text.point_id(F.lit(name))) == str(uuid.uuid5(uuid.UUID("0de7d8c3-5910-48bb-bd81-cc78732cc1ad"), name))


def test_ids(spark):
    assert one(spark, text.repository_id(F.lit("u"))) == "repo_" + hashlib.sha256(b"u").hexdigest()[:16]
    got = one(spark, text.chunk_id(F.lit("r"), F.lit("p"), F.lit(1), F.lit(2), F.lit(None).cast("string"), F.lit("k"), F.lit("c")))
    assert got == hashlib.sha256("\x1f".join(["r", "p", "1", "2", "", "k", "c"]).encode()).hexdigest()


@pytest.mark.parametrize(("answer", "want", "ids"), [("a [99] b", "a  b", []), ("[01] [1]", " [1]", ["1"]), ("[[9]1]", "[1]", []), ("[2] [1] [2]", "[2] [1] [2]", ["2", "1"]), ("none", "none", [])])
def test_citations(spark, answer, want, ids):
    known = F.array(F.lit("1"), F.lit("2"))
    assert one(spark, text.without_unknown_citations(F.lit(answer), known)) == want
    assert one(spark, text.cited_ids(F.lit(answer), known)) == ids


@pytest.mark.parametrize("bad", [lambda: ChunkConfig(max_chars=0), lambda: ChunkConfig(overlap_lines=-1), lambda: LexicalConfig(k1=0), lambda: LexicalConfig(b=2), lambda: HybridConfig(vector_weight=0, lexical_weight=0), lambda: HybridConfig(pool=0)])
def test_settings(bad):
    with pytest.raises(ValueError):
        bad()


def test_retry_delays():
    slept, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise providers.ProviderError("busy", 503)
        return x

    assert providers.with_retry(call, 2, 0.25, slept.append)(7) == 7
    assert slept == [0.25, 0.5]
    for error, tries in ((providers.ProviderError("no", 400), 1), (ValueError("no"), 1), (ConnectionError("gone"), 3)):
        tried = []

        def fails(x, error=error, tried=tried):
            tried.append(x)
            raise error

        with pytest.raises(type(error)):
            providers.with_retry(fails, 2, 0.25, slept.append)(1)
        assert len(tried) == tries


def test_generator_falls_back(spark):
    def broken(prompts):
        raise providers.ProviderError("no", 400)

    rows = spark.createDataFrame([("what?",)], "q string")
    assert rows.select(providers.generate(F.col("q"), broken, fail_open=True).alias("a")).first().a is None


def test_embedding_batches(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "i int, t string").coalesce(1)
    got = rows.select(providers.embed(F.col("t"), providers.hashing_embedder(8), 2).alias("v")).collect()
    assert [list(r.v) for r in got] == [pytest.approx(v) for v in providers.hashing_embedder(8)([f"text {i}" for i in range(5)])]
