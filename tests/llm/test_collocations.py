"""op11: phrases against a count by hand, with tries, blocks and ranges so small that everything is cut and merged."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, queries
from tests.util import assert_same

TINY = collocations.Sizes(shard=60, block=7, pending=20, range=9, text=50, border=3)
SCHEMA = "doc_id long, text string, lang string, words int, a int"


def by_hand(rows, most, least, inside):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(len(q) > len(p) and x == lang and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in found.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "ab", "A", "b", "é", "éa", "\x01", "hot", "hot", "hot", "cold", "x" * 40, "x" * 41]
    gaps = [" ", " ", "\t", "  ", ". ", ",", "\n", "\r", "! "]
    return [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None, ""]), 1, 2) for i in range(n)]


@pytest.mark.parametrize(("most", "least"), [(3, 2), (2, 1), (5, 2)])
def test_phrases_are_those_counted_by_hand(spark, most, least):
    rows = [*texts(most, 60), (90, None, "en", 0, 0), (91, "", None, 0, 0), (92, "hot " * 300, "en", 0, 0), (92, "hot " * 300, "en", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = collocations.collocations(docs, most, least, 50, None, TINY)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, most, least, 50)


def test_a_frequent_first_word_is_split_over_ranges(spark):
    rows = [(i, f"hot w{i % 50} v{i % 7}", "en", 0, 0) for i in range(400)]
    blocks = collocations.shard_tries(spark.createDataFrame(rows, SCHEMA).repartition(4), 3, TINY).cache()
    borders = collocations._borders(blocks, TINY)
    assert sum(b[1][0] == b"hot" for b in borders) > 5
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), 3, 2, 50, None, TINY)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 3, 2, 50)


def test_ranks_ties_and_empty_tables(spark):
    rows = [(i, "zz b, a b. c d", "en", 0, 0) for i in range(3)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), 3, 2, 50, 2)
    assert [(r["rank"], r.phrase, r.score) for r in got.orderBy("rank").collect()] == [(1, "c d", 10**6), (2, "a b", 500_000)]
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], SCHEMA), 1)


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3 * 10**9
    row = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long")
    whole = "cast(a AS decimal(15, 0)) * cast(a AS decimal(15, 0)) * 1000000"
    got = row.select(F.expr(f"({whole}) div (cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0)))").alias("s")).first().s
    assert got == 10**6 * a * a // ((a + 1) * (a + 2))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    assert_same(queries.QUERIES["op11_collocations"](spark, sf), collocations.ORACLE, sf)
