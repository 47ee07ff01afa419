"""op12: places against comparing every rule with every place."""

import random
from pathlib import Path

import pytest

from lodestone.llm import licenses, queries
from tests.util import assert_same

SCHEMA = "doc_id long, text string, places int, labels string"


def by_hand(text, rules, share):
    words, out = licenses.words_of(text or ""), []
    for phrase, label in licenses.BASE.items():
        p = licenses.words_of(phrase)
        out += [(label, True, i, len(p), len(p)) for i in range(len(words)) if words[i : i + len(p)] == p]
    for rule in licenses.rules_of(rules, share):
        n = len(rule.words)
        for at in range(-n, len(words) + 1):
            hit = [0 <= at + p < len(words) and words[at + p] == w for p, w in enumerate(rule.words)]
            if 100 * sum(hit) >= share * n and all(hit[p] for p in rule.key):
                out.append((rule.label, False, at, n, sum(hit)))
    return sorted(out)


def noisy(rng):
    words = []
    for _ in range(rng.randrange(4)):
        part = licenses.words_of(rng.choice(licenses.RULES)[1]) if rng.random() < 0.8 else licenses.words_of(rng.choice(list(licenses.BASE)))
        part = [rng.choice([b"the", b"license", b"x"]) if rng.random() < rng.choice([0, 0.1, 0.25]) else w for w in part]
        words += part[rng.randrange(3) :] + [rng.choice([b"all", b"cc", b"version", "é".encode()]) for _ in range(rng.randrange(5))]
    return rng.choice([" ", "-", ". "]).join(w.decode().upper() if rng.random() < 0.3 else w.decode() for w in words)


@pytest.mark.parametrize("share", [80, 60, 100])
def test_every_place_is_found(spark, share):
    rng = random.Random(share)
    rows = [(i, noisy(rng), 1, "") for i in range(150)] + [(900, None, 1, ""), (901, "", 1, ""), (902, "cc by " * 500, 1, ""), (902, "cc by " * 500, 1, "")]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(3), share=share)
    found = sorted((r.doc_id, sorted(map(tuple, r.places))) for r in got.collect())
    assert found == sorted((r[0], by_hand(r[1], licenses.RULES, share)) for r in rows)
    assert sum(len(p) for _, p in found) > 100


def test_words_that_are_frequent_in_the_corpus_are_not_looked_up(spark):
    rules = licenses.rules_of([("x", "alpha beta gamma delta epsilon zeta eta theta iota kappa", "gamma delta")], 80)
    postings, votes = licenses.index(rules, 1000, {b"alpha": 999, b"beta": 900, b"gamma": 1, b"delta": 2, b"epsilon": 3, b"zeta": 800})
    assert set(postings) == {b"eta", b"theta", b"iota", b"kappa"} and votes == [2]


def test_a_key_phrase_is_mandatory(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3.", 0, ""), (2, "released under the BSD License", 0, "")]
    got = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base, got[1].first_word, got[1].score) == ("gpl", "gpl,gpl-3.0", 1, 7, 1.0)
    assert (got[2].labels, got[2].n_base, got[2].first_word, got[2].score) == ("", 0, None, 0.0)


def test_words_are_counted(spark):
    rows = [(1, "CC-BY, naïve\x00Über_2 x", 0, ""), (2, None, 0, ""), (3, " .,-", 0, ""), (4, "a " * 3000, 0, "")]
    got = licenses.licenses(spark.createDataFrame(rows, SCHEMA).repartition(2))
    assert got.schema["n_words"].dataType.simpleString() == "bigint"
    assert {r.doc_id: r.n_words for r in got.collect()} == {1: 6, 2: 0, 3: 0, 4: 3000}


def test_rules_are_checked_and_an_empty_table_gives_no_rows(spark):
    with pytest.raises(ValueError):
        licenses.rules_of([("x", "some words", "other words")], 80)
    assert licenses.licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    assert_same(queries.QUERIES["op12_licenses"](spark, sf), licenses.ORACLE, sf)
