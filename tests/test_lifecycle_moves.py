"""The machine of lifecycles, in batch, in a stream and against a plain loop; signatures that merge."""

import random
from datetime import datetime, timedelta

import pytest
from lodestone.operators import lifecycle, moves
from lodestone.streaming import registry
from pyspark.sql import functions as F
from test_engine import URL, files

SCHEMA = "repository_id string, ts timestamp, seq long, move string"
HOUR = 3_600_000_000
START = datetime(2024, 1, 1)


def reports(n, ids, seed=3):
    r = random.Random(seed)
    names = [*moves.MOVES, *moves.BUSY, "queued", "sleeping", None]
    return [(r.choice(ids), START + timedelta(minutes=r.choice([0, 0, 1]) + 7 * k), k, r.choice(names)) for k in range(n)]


def looped(rows, timeout, until=None):
    legal = {"ingesting": ("queued",), "indexing": ("ingesting",), "completed": ("ingesting", "indexing"), "failed": moves.BUSY, "deleted": (*moves.BUSY, "completed", "failed")}
    out = {}
    for id in {r[0] for r in rows}:
        stage, progress, n, rejected, stuck, last = "none", 0, 0, 0, 0, None
        for _, ts, _, move in sorted((r for r in rows if r[0] == id and r[1]), key=lambda r: (r[1], r[2])):
            if last and (ts - last) / timedelta(microseconds=1) > timeout and stage in moves.BUSY:
                stage, stuck = "failed", stuck + 1
            if move == "queued" or stage in legal.get(move, ()):
                stage, progress = move, progress if move == "failed" else {"ingesting": 15, "indexing": 45, "completed": 100}.get(move, 0)
            else:
                rejected += 1
            n, last = n + 1, ts
        if until and last and (until - last) / timedelta(microseconds=1) > timeout and stage in moves.BUSY:
            stage, stuck = "failed", stuck + 1
        if n:
            out[id] = (stage, progress, n, rejected, stuck)
    return out


def found(df):
    return {r.repository_id: (r.stage, r.progress, r.n_moves, r.n_rejected, r.n_stuck) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 13])
def test_states_equal_a_loop_however_they_are_cut(spark, partitions):
    # one repository has most of all reports, so its stretches lie in several tasks
    rows = [*reports(900, ["hot"]), *reports(60, ["a", "b", None], 4), ("none", None, 1, "queued"), ("early", START, 1, "completed")]
    until = START + timedelta(days=9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert found(moves.states(df, HOUR // 4)) == looped(rows, HOUR // 4)
        got = found(moves.states(df, HOUR, F.lit(until)))
        assert got == looped(rows, HOUR, until) and "none" not in got and got["early"] == ("none", 0, 1, 1, 0)
        if partitions > 1:
            codes = df.where("ts IS NOT NULL").select("repository_id", F.unix_micros("ts").alias("us"), "seq", moves.move_code(F.col("move")).alias("move"))
            assert moves._stretches(codes, HOUR).where("repository_id = 'hot'").count() > 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_states_of_an_empty_table(spark):
    assert moves.states(spark.createDataFrame([], SCHEMA), HOUR).collect() == []


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = reports(120, ["a", "b"], 5)
    source, r = str(tmp_path / "in"), random.Random(1)
    for k in range(0, 120, 40):  # out of order within a file
        spark.createDataFrame(r.sample(rows[k : k + 40], 40), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    end = ("clock", START + timedelta(days=4), 0, "queued")
    spark.createDataFrame([end], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        out = registry.lifecycles(stream, HOUR // 2, "30 minutes").writeStream.format("memory").queryName("lifecycles").outputMode("update")
        q = out.option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = F.max_by(F.struct("stage", "progress", "n_moves", "n_rejected", "n_stuck"), F.col("n_moves") + F.col("n_stuck"))
    got = found(spark.table("lifecycles").groupBy("repository_id").agg(last.alias("x")).select("repository_id", "x.*"))
    want = found(moves.states(spark.createDataFrame(rows, SCHEMA), HOUR // 2, F.lit(START + timedelta(days=3))))
    assert {k: got.get(k) for k in want} == want
    assert sum(v[4] for v in want.values()) > 2


def test_merkle_signatures_depend_on_the_files_alone(spark):
    rows = [("a", f"p{k}", f"text {k % 50}") for k in range(500)] + [("a", "p1", "text 1"), ("b", "x", ""), ("c", None, "y"), ("c", "z", None), (None, "n", "m")]
    schema = "repository_id string, path string, content string"
    sign = lambda x, n: {r.repository_id: r.content_signature for r in lifecycle.merkle_signatures(spark.createDataFrame(x, schema).repartition(n)).collect()}
    once = sign(rows, 1)
    assert once == sign(rows[::-1], 7) and set(once) == {"a", "b", "c", None} and len(set(once.values())) == 4
    assert once["c"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    for other in (rows[1:], [*rows, rows[0]], [("a", "p0", "changed"), *rows[1:]], [("a", "renamed", "text 0"), *rows[1:]]):
        assert {k for k, v in sign(other, 3).items() if v != once[k]} == {"a"}
    assert sign([], 2) == {}


def test_engine_tells_what_a_killed_indexing_leaves(spark, tmp_path):
    from lodestone.plans.engine import Engine

    e = Engine(spark, str(tmp_path / "t"))
    e.index(files(spark), URL, "life", 1)
    e._record("killed", "u", "k", 1, "queued")
    e._record("killed", "u", "k", 1, "ingesting")
    done = e.registry().where("repository_name = 'life'").first().repository_id
    assert found(e.lifecycles(3600)) == {done: ("completed", 100, 4, 0, 0), "killed": ("ingesting", 15, 2, 0, 0)}
    # with no silence allowed the queued stage had failed before the next report, which then is illegal
    assert found(e.lifecycles(0))["killed"] == ("failed", 0, 2, 1, 1)
    e.delete(done, 2)
    assert found(e.lifecycles(3600))[done] == ("deleted", 0, 5, 0, 0)


def test_signatures_of_joined_files_are_of_whole_repositories(spark, tmp_path):
    made = spark.range(40000).selectExpr("concat('r', id % 3) AS repository_id", "concat('p', id) AS path", "concat('text ', id) AS content")
    made.repartition(8).write.parquet(str(tmp_path / "files"))
    rows = spark.read.parquet(str(tmp_path / "files"))
    # a join that is planned as a merge of shuffled rows, and found to be small when it runs
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        first = rows.where("repository_id IN ('r1', 'r7')").groupBy("repository_id").agg(F.min("path").alias("first"))
        joined = rows.join(first, "repository_id", "left").withColumn("content", F.when(F.col("path") == F.col("first"), "old").otherwise(F.col("content")))
        for sign in (lifecycle.signatures, lifecycle.exact_signatures):
            # repositories are dealt after the join: one that is read by several tasks has a signature of each
            assert "REPARTITION_BY_COL" in sign(joined)._jdf.queryExecution().executedPlan().toString()
            assert sign(joined).count() == 3
            assert [r.repository_id for r in lifecycle.changed(sign(rows), sign(joined)).collect()] == ["r1"]
    finally:
        for k in settings:
            spark.conf.unset(k)
