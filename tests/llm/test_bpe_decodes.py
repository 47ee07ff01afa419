"""What is returned as decoded comes from the ids of the document."""

import hashlib

import public_tokenizers
from lodestone.llm import byte_bpe


def test_wrong_ids_show_in_the_digest(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a cat, b")], "doc_id long, text string")
    # a pattern that leaves out the comma: the ids hold none, so neither may what they decode to
    got = byte_bpe.encode_documents(docs, path, r" ?[a-z]+", digests=True).first()
    assert got.decoded_sha256 == hashlib.sha256(b"a cat b").hexdigest()
