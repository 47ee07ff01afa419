"""op2: the sample of frequent pre-tokens is one job, and tokenizers that keep white space are refused."""

import public_tokenizers
import pytest

from lodestone.llm import token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_a_tokenizer_that_keeps_white_space_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    token_counts.checked(WORDS)


def test_the_sample_sets_no_result(spark):
    rows = [(i, f"word{i % 7} unusual{i} The end-of word{i % 3}", "x") for i in range(300)] + [(300, None, "x"), (301, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(6)
    frequent = token_counts.frequent_pretokens(docs, WORDS, "text", sample=100, kept=5)
    assert len(frequent) == 5
    t = token_counts._tokenizer(WORDS)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS).collect()} == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x, _ in rows}
