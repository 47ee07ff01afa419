import pytest

from lodestone.functions import providers
from pyspark.sql import functions as F


def refuser():
    def refusing(prompts):
        if "bad" in prompts:
            raise providers.ProviderError("no", 400)
        return [f" answer to {p} " if p != "mute" else " " for p in prompts]

    return refusing


def test_one_refused_prompt_does_not_take_the_batch_with_it(spark):
    rows = spark.createDataFrame([("a",), ("bad",), ("mute",), ("b",)], "prompt string").coalesce(1)
    got = {r.prompt: r.answer for r in rows.select("prompt", providers.generate(F.col("prompt"), refuser(), True).alias("answer")).collect()}
    assert got == {"a": "answer to a", "bad": None, "mute": None, "b": "answer to b"}


def test_errors_are_raised():
    for prompts in (["bad"], ["mute"]):
        with pytest.raises(providers.ProviderError):
            providers.answers(prompts, refuser(), False)
    with pytest.raises(KeyError):
        providers.answers(["a"], lambda p: {}[1], True)
    assert providers.answers(["mute"], refuser(), True) == [None]
