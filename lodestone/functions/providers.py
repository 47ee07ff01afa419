"""Model providers: batch functions from pandas series to series, and offline ones that need no service.

A provider is called once a batch within Arrow UDFs; `with_retry` gives it bounded retries with doubling delays.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from urllib.error import URLError

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str], list[str]], list[float]]
Generator = Callable[[list[str]], list[str]]


class ProviderError(Exception):
    """A provider's refusal with its HTTP status, if it has one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def passing(error: Exception) -> bool:
    """Whether a call may succeed when it is made again: a status of 429 or 5xx, or a failure of transport."""
    if isinstance(error, ProviderError):
        return error.status is not None and (error.status == 429 or 500 <= error.status < 600)
    return isinstance(error, (ConnectionError, TimeoutError, URLError))


def with_retry(call: Callable, retries: int = 2, delay: float = 0.25, sleep: Callable[[float], None] = time.sleep, again: Callable[[Exception], bool] = passing) -> Callable:
    """call, made again after errors that `again` takes for passing, with doubling delays; other errors are raised at once."""
    if retries < 0 or delay < 0:
        raise ValueError("retries and delay must not be negative")

    def tried(*args):
        for attempt in range(retries + 1):
            try:
                return call(*args)
            except Exception as e:
                if attempt == retries or not again(e):
                    raise
                sleep(delay * 2**attempt)

    return tried


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Feature hashing of words into signed counts of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def embed(text: Column, embedder: Embedder, batch: int = 32) -> Column:
    """Vectors of texts, in batches of at most `batch` calls; a provider that answers with another number of vectors fails."""
    if batch < 1:
        raise ValueError("batch must be at least 1")
    # every refusal of an embedding provider is taken for passing
    call = with_retry(embedder, again=lambda e: isinstance(e, ProviderError) or passing(e))

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].fillna("").tolist()
            vectors = call(part)
            if len(vectors) != len(part):
                raise ValueError("the embedder returned another number of vectors")
            if len({len(v) for v in vectors}) > 1:
                raise ValueError("the embedder returned vectors of different lengths")
            out += vectors
        return pd.Series(out, index=texts.index)

    return run(text)


def score(question: Column, content: Column, scorer: Scorer, batch: int = 16) -> Column:
    """struct(score, ok) by a scorer; ok is false for a batch in which it failed or returned another number of scores."""

    call = with_retry(scorer)

    @F.pandas_udf("score double, ok boolean")
    def run(questions: pd.Series, contents: pd.Series) -> pd.DataFrame:
        scores, ok = [], []
        for i in range(0, len(questions), batch):
            q, c = questions.iloc[i : i + batch].tolist(), contents.iloc[i : i + batch].tolist()
            try:
                got = [float(x) for x in call(q, c)]
            except Exception:
                got = []
            fine = len(got) == len(q)
            scores += got if fine else [0.0] * len(q)
            ok += [fine] * len(q)
        return pd.DataFrame({"score": scores, "ok": ok})

    return run(question, content)


def answers(prompts: list[str], call: Generator, fail_open: bool) -> list[str | None]:
    """Stripped answers. With fail_open a batch that the provider refuses is asked prompt by prompt, and only those refused, or
    answered with nothing, are null; errors that are no refusal are raised, as all are without it. An empty answer is a refusal."""

    def asked(part: list[str]) -> list[str]:
        out = [a.strip() for a in call(part)]
        if len(out) != len(part) or not all(out):
            raise ProviderError("the generator gave no answer")
        return out

    try:
        return asked(prompts)
    except (ProviderError, ValueError, ConnectionError, TimeoutError, URLError):
        if not fail_open:
            raise
        if len(prompts) == 1:
            return [None]
    return [a for p in prompts for a in answers([p], call, True)]


def generate(prompt: Column, generator: Generator, fail_open: bool = False) -> Column:
    """A generator's answers, with retries; with fail_open null where it fails, so that callers can fall back."""
    call = with_retry(generator)

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(answers(prompts.tolist(), call, fail_open) if len(prompts) else [], index=prompts.index, dtype=object)

    return run(prompt)
