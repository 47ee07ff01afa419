"""Of masked_lm: how rounds are dealt, and the parts of a step that are worked on in blocks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from lodestone.llm import masked_lm
from lodestone.llm.wordhash import LOWER, chunks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_a_slice_is_a_tasks_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got, texts = Counter(), 0
    for k in range(masked_lm.ROUNDS):
        rows = masked_lm.dealt(docs, k, 12).groupBy(F.spark_partition_id().alias("task"), "slice").count().collect()
        assert len({r.task for r in rows}) == len({r.slice for r in rows}) == len(rows) == 12
        texts += sum(r["count"] for r in rows)
    assert texts == docs.count()


def test_word_counts_are_whole(spark):
    docs = spark.createDataFrame([(1, "a b A"), (2, None), (3, ""), (4, "b  c\n")], "doc_id long, text string")
    got = {r.h: r.n for r in masked_lm.word_counts(docs).collect()}
    (_, w), = chunks(pa.array(["a b c"]), LOWER)
    assert got == dict(zip(w.hash.view(np.int64).tolist(), [2, 2, 1]))
    assert masked_lm.word_counts(docs.limit(0)).count() == 0


def test_sums_of_runs():
    r = np.random.default_rng(3)
    for sizes in ([1], [7], [1, 1, 1], [40, 1, 4, 5, 3, 2, 1, 200], r.zipf(1.5, 300).clip(1, 500).tolist()):
        first = np.cumsum([0, *sizes[:-1]])
        rows = r.normal(0, 1, (sum(sizes), masked_lm.HIDDEN)).astype(np.float32)
        want = np.add.reduceat(rows.astype(float), first, axis=0)
        assert np.allclose(masked_lm._sums(rows, first), want, atol=1e-4)


def test_blocks_do_not_change_a_step(monkeypatch):
    r = np.random.default_rng(2)
    flat = r.normal(0, 0.3, masked_lm.Network().flat.size)
    tokens = np.minimum(r.zipf(1.2, (5, 700)) - 1, masked_lm.TOKENS - 1).astype(np.int32)
    got = []
    for rows in (64, 4096):
        monkeypatch.setattr(masked_lm, "ROWS", rows)
        net = masked_lm.Network(flat)
        grown = np.zeros_like(net.flat)
        log_p = net.forward(tokens[:4], tokens[4])[0]
        for _ in range(3):
            net.step(tokens[:4], tokens[4], grown)
        got.append((log_p, net.flat, grown))
    for one, other in zip(*got):
        assert np.allclose(one, other, rtol=1e-3, atol=1e-4)


def test_many_classes(monkeypatch):
    """Models of more than 256 classes, most of them without a target, and logits beyond what exp can take."""
    r = np.random.default_rng(6)
    k = 260
    net = masked_lm.Network(r.normal(0, 6, masked_lm._size(k)))
    assert net.k == k
    tokens = r.integers(0, k * k, (5, 50)).astype(np.int32)
    log_p, h = net.forward(tokens[:4], tokens[4])
    p, target = net.part, tokens[4]
    a, z = h @ p["c"] + p["cb"], np.einsum("nh,nhk->nk", h, p["w"][target // k]) + p["wb"][target // k]
    assert max(abs(a).max(), abs(z).max()) > 60
    want = sum(x[np.arange(50), at] - np.logaddexp.reduce(x.astype(float), axis=1) for x, at in ((a, target // k), (z, target % k)))
    assert np.allclose(log_p, want, rtol=1e-3, atol=1e-2)
    before = net.flat.copy()
    net.step(tokens[:4], tokens[4], np.zeros_like(net.flat))
    assert np.isfinite(net.flat).all() and (net.flat != before).mean() < 0.5
