"""Signatures are digests of the whole sequence, without a group in one row."""

import hashlib

import pytest
from lodestone.operators import lifecycle


@pytest.mark.parametrize("f, end", [(lifecycle.exact_signatures, "\0"), (lifecycle.signatures, "\x1f")])
def test_signatures_stream(spark, f, end):
    rows = [("a", f"p{k}", f"é text {k}") for k in range(300)] + [("b", "x", "y"), ("b", None, "y"), ("b", "z", None), (None, "n", "m")]
    df = f(spark.createDataFrame(rows, "repository_id string, path string, content string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    inner = (lambda c: c) if end == "\0" else (lambda c: hashlib.sha256(c.encode()).hexdigest())
    want = {}
    for r in {r[0] for r in rows}:
        whole = "".join(p + end + inner(c) + end for i, p, c in sorted((x for x in rows if x[0] == r and None not in x[1:]), key=lambda x: x[1]))
        want[r] = hashlib.sha256(whole.encode()).hexdigest()
    assert {x.repository_id: x.content_signature for x in df.collect()} == want
