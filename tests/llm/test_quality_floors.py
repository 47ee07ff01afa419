"""Each statistic alone can reject a document, and small languages are judged."""

import random

import pytest
from lodestone.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def kept(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    plain = lambda n=60: "\n".join(" ".join(word() for _ in range(10)) for _ in range(n // 10))
    rows = [(i, plain(), "en", "a") for i in range(200)]
    menu = [word() for _ in range(8)]
    varied = "\n".join([plain(20), *[r.choice(menu) for _ in range(60)]])
    sentence = " ".join(word() for _ in range(5))
    repeats = " ".join([sentence, *[word() for _ in range(22)], sentence, *[word() for _ in range(22)]])
    symbols = " ".join(word() + ("$" if k % 3 == 0 else "") for k in range(60))
    rows += [(1000, varied, "en", "a"), (1001, repeats, "en", "a"), (1002, symbols, "en", "a"), (1003, plain(6000), "en", "a"), (1005, plain(), "xx", "a")]
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("doc_id")
    return got


@pytest.mark.parametrize("doc_id", [1000, 1001, 1002, 1003])
def test_each_statistic_alone_rejects(kept, doc_id):
    assert not kept.base_failed[doc_id] and not kept.kept[doc_id]


def test_small_language_uses_all_documents(kept):
    assert kept.distance2.notna().all()
    assert kept.kept[1005] and kept.kept[kept.index < 1000].mean() > 0.97


def test_verdicts_do_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, other = (quality.quality_rules(d).toPandas().set_index("doc_id").distance2.sort_index() for d in (docs, docs.repartition(7)))
    assert (one == other).all()


def test_a_source_of_its_own_is_judged_by_itself(spark):
    """What all of a large source does is no fault there, and one elsewhere."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    plain = lambda end: "\n".join(" ".join(word() + end for _ in range(10)) for _ in range(6))
    rows = [(i, plain(""), "en", f"s{i % 5}") for i in range(900)] + [(1000 + i, plain("$"), "en", "prices") for i in range(900)]
    rows += [(5000, plain("$"), "en", "s1"), (5001, plain("$"), "en", "prices")]
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("doc_id")
    assert got.kept[5001] and got.kept[got.index < 5000].mean() > 0.97
    assert got.distance2[5000] > 3 * got.distance2[5001]


def test_floors_let_bounded_statistics_pass_the_cutoff():
    cut = quality.chi2_quantile(1 - quality.TAIL, len(quality.STATS))
    assert (1 / quality.STATS["dup_lines"]) ** 2 > cut and 0.2 / quality.STATS["repeats"] ** 2 > cut
