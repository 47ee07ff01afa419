"""Quality rules with a robust multivariate outlier test, in DataFrame operations only.

Every document gets its base statistics and a vector of transformed ones, kept as whole thousandths so that all
sums below are exact and independent of their order. The minimum-covariance-determinant estimate of centre and spread
is taken for all documents, for each language, and for each language and source: from three deterministic starts
(quartiles, plain moments, distance from the median in units of the floors) concentration steps take mean and covariance of
the share H of documents with the smallest Mahalanobis distance, until no determinant falls any more, and the start with the
smallest determinant wins. A source's estimate is pooled with its language's, which counts as WEIGHT documents, and a
language's with that of all documents in the same way: small groups lean on wider ones by degrees. A document is rejected
where its squared distance exceeds the cutoff.

Moments are summed by group and bin of the distance, so one pass over the rows and one small table make a step, and no
group is gathered.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, SPACE_RUN, written

#: Share of a group's documents whose covariance has the smallest determinant.
H = 0.75
#: Documents that a wider group's estimate counts for in a narrower one's.
WEIGHT = 60
#: Fall of a determinant's logarithm below which a start has converged.
SETTLED = 1e-6
#: Estimates that are broadcast at most, a few hundred bytes each; more are joined by a shuffle.
BROADCAST = 20_000
#: The chi-squared quantile of probability 1 - TAIL with one degree for each statistic is the largest squared distance kept.
TAIL = 5e-4
#: The transformed statistics, and the standard deviation that each is given at least, in its own unit: statistics
#: that are zero in most documents have no spread in the concentrated share, and small deviations are no fault. Each is
#: so small that its statistic alone can pass the cutoff: dup_lines is at most 1, repeats below the base rule 0.447.
STATS = {"log_words": 0.6, "log_word_chars": 0.10, "symbols": 0.04, "dup_lines": 0.15, "repeats": 0.08, "capitals": 0.07, "marks": 0.09}
UNIT = 1000
#: Distances are counted by quarter powers of two in this many parts.
PARTS = 64
WINDOW = 5


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(df / 2, mid / 2) < q else (low, mid)
    return high


def base_statistics(docs: DataFrame, id: str, text: str, lang: str, source: str) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks)."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), t.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.select(
        "doc_id", "lang", "source",
        F.transform(F.filter(F.split("text", SPACE_RUN), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"),
        F.length(F.translate("text", SPACES, "")).alias("word_chars"),
        without(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        without(F.col("text"), "!?;:.,\"'()[]{}=_@/\\^~`+").alias("n_marks"),
        lines.alias("lines"),
    )
    n = F.size("words")
    gram = lambda i: F.xxhash64(*[F.element_at("words", i + k) for k in range(WINDOW)])
    rows = rows.withColumn("grams", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), gram)))
    rows = rows.withColumn("n_words", n).withColumn("n_lines", F.size("lines")).withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines")))
    rows = rows.withColumn("again", F.when(F.size("grams") > F.size(F.array_distinct("grams")), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    at = lambda k: F.get(F.col("again"), k)["g"]
    twice = F.filter("again", lambda x, k: F.coalesce(x["g"] == at(k - 1), F.lit(False)) | F.coalesce(x["g"] == at(k + 1), F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window's start covers words up to the next start, at most WINDOW of them
    covered = F.aggregate(
        F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), k + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    return rows.select(
        "doc_id", "lang", "source",
        *[F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *[F.col(c).cast("long") for c in ("n_lines", "n_capitals", "n_marks")],
    )


def _vector() -> list[Column]:
    c = lambda name: F.col(name).cast("double")
    share = lambda a, b: F.sqrt(c(a) / F.greatest(c(b), F.lit(1.0)))
    values = {
        "log_words": F.log(c("n_words") + 1),
        "log_word_chars": F.log((c("word_chars") + 1) / (c("n_words") + 1)),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "word_chars"),
    }
    return [F.round(values[k] * UNIT).cast("long").alias(k) for k in STATS]


KEYS = list(STATS)
PAIRS = [(i, j) for i in range(len(KEYS)) for j in range(i + 1)]


def _at(i: int, j: int) -> int:
    """The place of entry (i, j) among PAIRS, a symmetric matrix's lower triangle."""
    return max(i, j) * (max(i, j) + 1) // 2 + min(i, j)


def _array(entries: list[str]) -> str:
    return f"array({', '.join(entries)})"


# the formulas below are SQL text: hundreds of terms are put together faster so than as columns
MOMENT_SUMS = {
    "n": "count(1)", **{f"s_{i}": f"sum({k})" for i, k in enumerate(KEYS)},
    **{f"s_{i}_{j}": f"sum({KEYS[i]} * {KEYS[j]})" for i, j in PAIRS},
}
#: The squared Mahalanobis distance of a row of STATS by its columns m and p.
DISTANCE = " + ".join(f"p[{_at(i, j)}] * ({KEYS[i]} - m[{i}]) * ({KEYS[j]} - m[{j}])" for i, j in PAIRS)


def _moments() -> list[Column]:
    """Sums of whole thousandths and of their products, exact up to 2^63: 10^10 documents a group and more."""
    return [F.expr(x).alias(name) for name, x in MOMENT_SUMS.items()]


def _floor(i: int) -> float:
    return STATS[KEYS[i]] * UNIT


def _centre_and_spread(rows: DataFrame, share: float) -> DataFrame:
    """rows of moments with m (means) and c (covariance over PAIRS, consistent for the nearest `share` of documents, with
    the floors of STATS added), in place of the sums."""
    scale = share / _gamma_p((len(KEYS) + 2) / 2, chi2_quantile(share, len(KEYS)) / 2) if share < 1 else 1.0
    m = [f"s_{i} / n" for i in range(len(KEYS))]
    c = [f"(s_{i}_{j} / n - s_{i} / n * (s_{j} / n)) * {scale!r}D + {_floor(i) ** 2 if i == j else 0.0!r}D" for i, j in PAIRS]
    return rows.withColumns({"m": F.expr(_array(m)), "c": F.expr(_array(c))}).drop(*MOMENT_SUMS)


def inverted(c: str) -> Column:
    """struct(p, logdet) of a covariance over PAIRS: its inverse over PAIRS, entries off the diagonal doubled, and the
    logarithm of its determinant, by Gauss-Jordan elimination (no pivoting, as the matrix is positive definite)."""
    d = len(KEYS)
    rows = _array([_array([f"{c}[{_at(i, j)}]" for j in range(d)] + [f"{float(i == j)}D" for j in range(d)]) for i in range(d)])
    inverse = _array([f"s.a[{i}][{d + j}] * {1 if i == j else 2}" for i, j in PAIRS])
    return F.expr(f"""aggregate(sequence(0, {d - 1}), named_struct('a', {rows}, 'logdet', 0D), (s, k) -> named_struct(
        'a', transform(s.a, (r, i) -> IF(i = k, transform(r, x -> x / r[k]), zip_with(r, s.a[k], (x, y) -> x - r[k] / s.a[k][k] * y))),
        'logdet', s.logdet + ln(s.a[k][k])), s -> named_struct('p', {inverse}, 'logdet', s.logdet))""")


def _with_inverse(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", inverted("c")).select("*", "x.p", "x.logdet").drop("x")


def _joined(rows: DataFrame, by: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """rows with the estimates of their grp, of which there are n."""
    return rows.join(F.broadcast(by) if n <= BROADCAST else by, "grp", how)


def _starts(sample: DataFrame) -> DataFrame:
    """(grp, start, m, p, logdet): where the concentration steps of each group begin."""
    quartiles = [F.expr(f"percentile({k}, array(0.25, 0.5, 0.75))").alias(f"q_{i}") for i, k in enumerate(KEYS)]
    by = _centre_and_spread(sample.groupBy("grp").agg(*_moments(), *quartiles), 1.0).withColumn("plain", inverted("c"))
    diagonal = lambda entry: _array([entry(i) if i == j else "0D" for i, j in PAIRS])
    median = _array([f"q_{i}[1]" for i in range(len(KEYS))])
    wide = diagonal(lambda i: f"1 / pow((q_{i}[2] - q_{i}[0]) / 1.349D + {_floor(i)!r}D, 2)")
    floors = diagonal(lambda i: f"{_floor(i) ** -2!r}D")
    starts = ", ".join(f"named_struct('start', {k}, 'm', {m}, 'p', {p})" for k, (m, p) in enumerate([(median, wide), ("m", "plain.p"), (median, floors)]))
    return by.select("grp", F.expr(f"inline(array({starts}))"), F.lit(float("inf")).alias("logdet"))


def _step(sample: DataFrame, by: DataFrame, n: int) -> DataFrame:
    """(grp, start, documents, m, c, p, logdet, active): one concentration step from each estimate of `by`; active while its
    determinant falls. The nearest share H is taken in whole bins of the distance."""
    rows = _joined(sample, by.select("grp", "start", "m", "p", F.col("logdet").alias("before")), n)
    rows = rows.withColumn("part", F.expr(f"int(floor(log2(1 + {DISTANCE}) * {PARTS}))"))
    bins = rows.groupBy("grp", "start", "part").agg(F.max("before").alias("before"), *_moments())
    group = Window.partitionBy("grp", "start")
    bins = bins.withColumns({"upto": F.sum("n").over(group.orderBy("part")), "all": F.sum("n").over(group)})
    near = bins.where(f"upto - n < all * {H!r}D")
    sums = near.groupBy("grp", "start").agg(F.max("before").alias("before"), F.max("all").alias("documents"), *[F.sum(x).alias(x) for x in MOMENT_SUMS])
    new = _with_inverse(_centre_and_spread(sums, H))
    return new.withColumn("active", F.col("logdet") < F.col("before") - SETTLED).drop("before")


def robust_estimates(sample: DataFrame) -> DataFrame:
    """(grp, documents, m, c): the minimum-covariance-determinant estimate of every grp in rows of (grp, *STATS)."""
    by, settled = written(_starts(sample), "quality-starts"), []
    while n := by.count():
        stepped = written(_step(sample, by, n), "quality-step")
        settled.append(stepped.where("NOT active"))
        by = stepped.where("active")
    if not settled:
        return by.select("grp", F.lit(0).cast("long").alias("documents"), "m", F.col("p").alias("c"))
    best = F.min(F.struct("logdet", "start", "documents", "m", "c")).alias("x")
    return reduce(DataFrame.unionByName, settled).groupBy("grp").agg(best).select("grp", "x.documents", "x.m", "x.c")


def pooled(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(grp, m, p) for rows (groups: names from the widest to the narrowest): each group's estimate with the wider one's as
    WEIGHT more documents; without documents of its own, the wider one's."""
    mix = lambda a, b: f"zip_with({a}, {b}, (x, y) -> (documents * x + {WEIGHT}D * y) / (documents + {WEIGHT}D))"
    square = lambda c, m: f"zip_with({c}, {_product(m)}, (x, y) -> x + y)"
    for k in range(3):
        own = found.select(F.col("grp").alias("g"), "documents", F.col("m").alias("m_own"), F.col("c").alias("c_own"))
        groups = groups.join(own, F.get("groups", F.lit(k)) == F.col("g"), "left").drop("g")
        if k:
            groups = groups.withColumns({"m_mix": F.expr(mix("m_own", "m")), "c_mix": F.expr(mix(square("c_own", "m_own"), square("c", "m")))})
            groups = groups.withColumn("c_mix", F.expr(f"zip_with(c_mix, {_product('m_mix')}, (x, y) -> x - y)"))
            groups = groups.select("groups", F.coalesce("m_mix", "m").alias("m"), F.coalesce("c_mix", "c").alias("c"))
        else:
            groups = groups.select("groups", F.col("m_own").alias("m"), F.col("c_own").alias("c"))
    return groups.select(F.get("groups", F.lit(2)).alias("grp"), "m", inverted("c")["p"].alias("p"))


def _product(m: str) -> str:
    """m times its transpose, over PAIRS; m is bound to a lambda's variable, so that it is worked out once."""
    return f"transform(array({m}), v -> {_array([f'v[{i}] * v[{j}]' for i, j in PAIRS])})[0]"


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2) of every row.

    base_failed: fewer than 10 words, or more than 20 % of the words in 5-word windows that recur. kept: base rules
    passed and the robust squared distance within the cutoff; documents that failed the base rules take no part in
    the estimates. A null text has no words and fails; very long texts are read whole. A null language or source is a
    value of its own. Ties in distance fall into one bin and are near together. Repeated rows and null ids are judged
    like any other; an empty table gives an empty one, and a distance is null where no document passes the base rules;
    other columns are ignored. Results do not depend on the order or partitioning of rows.
    """
    base = base_statistics(docs, id, text, lang, source)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    name = lambda level, *cs: F.concat(F.lit(level), F.to_json(F.struct(*cs)))
    groups = F.array(F.lit("all"), name("lang ", "lang"), name("both ", "lang", "source"))
    rows = base.withColumn("base_failed", failed).select("*", *_vector(), groups.alias("groups")).drop("lang", "source")
    rows = written(rows, "quality-statistics")
    sample = rows.where(~F.col("base_failed")).select(F.explode("groups").alias("grp"), *KEYS)
    found = written(pooled(rows.select("groups").distinct(), robust_estimates(sample)), "quality-estimates")
    near = F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, len(STATS)), F.lit(True))
    judged = _joined(rows.withColumn("grp", F.get("groups", F.lit(2))), found, found.count(), "left").withColumn("d2", F.expr(DISTANCE))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), F.col("d2").alias("distance2"),
    )
