from lodestone.config import ConversationConfig
from lodestone.operators import conversation
from lodestone.streaming import history

SCHEMA = "repository_id string, conversation_id string, seq long, role string, content string"


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [("r", c, i, "user" if i % 2 else "assistant", f"{c}{i}") for c in "ab" for i in range(9)]
    config = ConversationConfig(history=4, rewrite=3)
    source = str(tmp_path / "in")
    for part in (rows[:5] + rows[9:12], rows[5:9] + rows[12:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = history.histories(stream, config).writeStream.format("memory").queryName("histories").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.conversation_id, r.seq, [(h.role, h.content) for h in r.history])
    got = sorted(map(key, spark.table("histories").collect()))
    want = sorted(map(key, conversation.with_history(spark.createDataFrame(rows, SCHEMA), config).collect()))
    assert got == want
