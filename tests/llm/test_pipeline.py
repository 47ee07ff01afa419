"""The corpus pipeline: what each stage keeps and changes."""

import re

import corpus_pipeline as pipeline
import pytest
from lodestone.llm import quality
from lodestone.llm.common import written
from pyspark.sql import functions as F
from test_llm import ODD, _tiktoken, brute_components, table

import numpy as np

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in pipeline.STAGES:
        out.append((name, docs, written(f(spark, docs, SF), "test-stage")))
        docs = out[-1][2]
    return out


def test_columns(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources", "byte-level BPE"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_stages_against_brute_force(spark, stages):
    (_, docs, good), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, encoded) = stages
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in brute_components(rows)}
    masked = {r.doc_id: r.text for r in clean.collect()}
    for r in single.collect():
        assert masked[r.doc_id] == re.sub(r'(?i)(?<=token = ")[0-9a-f]{40}(?=")', "[SECRET]", r.text)
    copies = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 3 and {r.doc_id for r in mixed.collect()} <= set(masked)
    library = _tiktoken()
    want = sorted((r.doc_id, len(library.encode_ordinary(r.text)), np.array(library.encode_ordinary(r.text), "<u4").tobytes()) for r in mixed.collect())
    assert sorted((r.doc_id, r.n_tokens, bytes(r.token_ids)) for r in encoded.collect()) == want


def test_odd_rows(spark):
    docs = table(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in pipeline.STAGES:
        assert f(spark, docs, SF).count() >= 0
        f(spark, docs.limit(0), SF).collect()


def test_written_tables_are_numbered_without_a_copy(spark, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(pipeline, "written", lambda df, name: names.append((name, df.columns)) or written(df, name))
    rows = [(i % 7 if i % 5 else None, f"text {i % 3}", "en", "s", 6) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    keyed = pipeline._keyed(stored)
    first = {r[pipeline.KEY]: tuple(r)[:-1] for r in keyed.collect()}
    # other splits, other order: the same numbers
    assert len(first) == 900 and first == {r[pipeline.KEY]: tuple(r)[:-1] for r in keyed.repartition(3).collect()}
    assert names == [("pipeline-files", ["file_", "file_no_"])]
    # rows that are not those of the files are written with their numbers
    several = pipeline._keyed(stored.unionByName(stored))
    assert several.select(pipeline.KEY).distinct().count() == 1800 and names[-1][0] == "pipeline-rows"
