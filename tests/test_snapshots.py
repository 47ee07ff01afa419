"""Versions of an index: nothing half done is seen, deltas equal a rebuild, ids never name other folders."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import providers
from lodestone.operators import snapshots, store
from lodestone.plans import engine as engines
from lodestone.plans.engine import Engine

URL = "https://github.com/o/versions.git"
TABLES = ("points", "postings", "repositories")


def files(spark, texts):
    rows = [("r", p, "Python" if p.endswith(".py") else "Markdown", t, len(t), t.count("\n")) for p, t in texts.items()]
    return spark.createDataFrame(rows, "repository_id string, path string, language string, content string, size_bytes long, line_count int")


def state(e, commit=None):
    view = e.snapshots.view(commit)
    return {t: sorted(str(sorted(r.asDict().items())) for r in e._table(t, view).collect()) for t in TABLES}


ONE = {"a.py": "def a():\n    return 1\n", "b.py": "def b():\n    return token\n", "c.md": "# C\n\nA token.\n"}
TWO = {**ONE, "a.py": "def a():\n    return token\n", "d.py": "def d():\n    pass\n"}
THREE = {k: v for k, v in TWO.items() if k != "b.py"}


def test_deltas_equal_a_rebuild_and_old_views_stay(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"), merge_after=99)
    seen = []
    for n, texts in enumerate((ONE, TWO, THREE, ONE)):
        e.index(files(spark, texts), URL, "versions", n)
        seen.append(state(e))
    id = e.registry().first().repository_id
    assert len(e.snapshots.layers(id)) == 4
    fresh = Engine(spark, str(tmp_path / "fresh"))
    fresh.index(files(spark, THREE), URL, "versions", 1)
    assert state(fresh) == seen[2] and seen[3] == seen[0]
    assert state(e, 2) == seen[1]
    asked = spark.createDataFrame([(1, id, "token")], "query_id int, repository_id string, text string")
    assert {r.file_path for r in e.search(asked, 5, commit=2).collect()} >= {"a.py", "b.py", "c.md"}
    # only what changed was written
    rows = e.snapshots.view()._rows("points").groupBy("ordinal").agg(F.collect_set("file_path").alias("p")).collect()
    assert {r.ordinal: set(r.p) for r in rows} == {0: set(ONE), 1: {"a.py", "d.py"}, 3: {"a.py", "b.py"}}
    before = seen[-1]
    e.compact(id)
    assert state(e) == before and len(e.snapshots.layers(id)) == 1
    assert e.snapshots.collect(keep=1, grace_seconds=0) > 0
    assert state(e) == before
    parts = [p for p in (tmp_path / "t" / "index" / "points").glob("index_part=*/index_layer=*")]
    assert len(parts) == 1
    assert e.index(files(spark, TWO), URL, "versions", 9) == "completed"


def test_a_job_killed_between_tables_leaves_the_old_version(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "t"), retries=0)
    e.index(files(spark, ONE), URL, "versions", 1)
    before, written = state(e), []
    real = snapshots.Snapshots.write

    def dying(self, rows, table, repository_id, layer):
        if table == "lengths":
            raise RuntimeError("killed")
        written.append(table)
        real(self, rows, table, repository_id, layer)

    monkeypatch.setattr(snapshots.Snapshots, "write", dying)
    with pytest.raises(RuntimeError):
        e.index(files(spark, TWO), URL, "versions", 2)
    assert "points" in written and state(e) == before
    monkeypatch.setattr(snapshots.Snapshots, "write", real)
    assert e.snapshots.collect(keep=1) == 0  # a young layer may still be published by its writer
    assert e.snapshots.collect(keep=1, grace_seconds=0) == len(written) and state(e) == before
    record = e.registry().first()
    assert (record.status, record.progress_percent, record.error) == ("failed", 45, engines.FAILED)


def test_indexing_is_tried_again_and_empty_messages_are_recorded(spark, tmp_path, monkeypatch):
    e, calls = Engine(spark, str(tmp_path / "t"), delay=0.0), []
    real = Engine._index

    def failing(self, *args):
        calls.append(1)
        if len(calls) < 3:
            raise AssertionError()
        return real(self, *args)

    monkeypatch.setattr(Engine, "_index", failing)
    assert e.index(files(spark, ONE), URL, "versions", 1) == "completed" and len(calls) == 3
    monkeypatch.setattr(Engine, "_index", lambda self, *args: (_ for _ in ()).throw(AssertionError()))
    with pytest.raises(AssertionError):
        e.index(files(spark, TWO), URL, "versions", 2)
    assert e.registry().first().status == "failed"


def test_commits_are_exclusive_and_half_written_ones_are_none(spark, tmp_path):
    shots = snapshots.Snapshots(spark, str(tmp_path / "s"))
    assert shots.commit("r", ["l1"], []) == 1
    with pytest.raises(snapshots.Conflict):
        shots.commit("r", ["l2"], [])
    (tmp_path / "s" / "manifest" / "000000000002.json").write_text('{"commit": 2, "repository_id": "r", "lay')
    assert shots.layers("r") == ["l1"]
    assert not shots._create("000000000002.json", [])
    assert shots.commit("r", ["l1", "l3"], ["l1"]) == 3 and shots.layers("r") == ["l1", "l3"]
    assert [r["layers"] for r in shots.live(1).collect()] == [["l1"]]
    assert shots.commit("r", [], ["l1", "l3"]) == 4 and shots.live().count() == 0


@pytest.mark.parametrize("id", ["../../victim", "x/../../../victim", "..", "a:b", "a%3Ab", "a=b/c", "é ü"])
def test_no_id_names_another_folder(spark, tmp_path, id):
    (tmp_path / "victim").mkdir()
    path = str(tmp_path / "root" / "points")
    rows = spark.createDataFrame([(id, "1"), ("other", "2")], "repository_id string, chunk_id string")
    store.write_repository(rows, path)
    store.write_repository(rows.where("chunk_id = '2'"), path, id)  # nothing left of id
    assert [r.chunk_id for r in spark.read.parquet(path).collect()] == ["2"]
    assert not store.drop_repository(spark, path, id) and (tmp_path / "victim").exists()
    for wrong in ("", None):
        with pytest.raises(ValueError):
            store.drop_repository(spark, path, wrong)
    assert snapshots.part_of(id).isalnum()


def test_embedding_retries_every_refusal_but_not_missing_files():
    calls = []

    def refusing(texts):
        calls.append(1)
        raise providers.ProviderError("no", 400)

    with pytest.raises(providers.ProviderError):
        providers.with_retry(refusing, again=lambda e: isinstance(e, providers.ProviderError) or providers.passing(e), sleep=lambda s: None)([])
    assert len(calls) == 3 and not providers.passing(FileNotFoundError()) and providers.passing(ConnectionResetError())
