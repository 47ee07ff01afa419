"""The llm operators against SQL, libraries and brute force, and on odd rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from lodestone.llm import byte_bpe, graph, masked_lm, mixing, ngram_join, quality, queries, secrets, substring_dedup, token_counts, topk_search, warc
from lodestone.llm.common import written
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from util import assert_same

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CLIP = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, n double, copies string"


def table(spark, texts):
    """documents of (doc_id, text) with nulls elsewhere and columns whose names operators use themselves."""
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "s1", "s2", "s1"][k % 4], None, "k", 7, 0.5, "c") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{i % 977} and{i % 89}" for i in range(30000))
ODD = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, " \n\t "), (None, "the cat sat on the mat"), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (6, LONG), (7, "x" * 5000), (8, "é ß  漢字 \x1c\x85 <|endoftext|> don't  two  blanks \n \n end "), (9, "a b"), (10, "A B"), (None, None)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def frames(spark, f, **kw):
    """f over the odd rows, an empty table, and whether both end; the odd rows' result."""
    odd = table(spark, ODD)
    empty = f(odd.limit(0), **kw)
    assert empty.count() == 0
    return f(odd, **kw).toPandas()


def test_odd_rows_keep_their_number(spark):
    for f in (quality.quality_rules, masked_lm.score, mixing.mix, substring_dedup.remove_repeats, lambda d: ngram_join.near_duplicate_classes(d)[0]):
        got = frames(spark, f)
        assert len(got) == len(ODD) and sorted(got.doc_id.dropna()) == sorted(i for i, _ in ODD if i is not None)


# --- 1


def test_warc_odd_rows(spark):
    big = "x" * 200
    rows = [(1, "u\r\n", big), (2, None, big), (3, "v", None), (4, "w", "a\r\n\r\nb" * 50), (None, "z", big), (5, "z", "y" * 99), (6, "z", "y" * 99), (7, "é", "é\x00" * 60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = {r.page_id: r for r in warc.deduplicated_archive(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {2, None} and got[2].refers_to == 1
    assert warc.deduplicated_archive(pages.limit(0)).count() == 0


def test_warc_files_are_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "hi"), (2, "http://b/", "ho")], "page_id long, url string, html string").coalesce(1)
    warc.write_archive(warc.as_responses(pages, "page_id", "url", "html", "2024-01-01T00:00:00Z"), str(tmp_path / "w"))
    import gzip

    data = gzip.decompress(next((tmp_path / "w").glob("part-*")).read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"ho\r\n\r\n")
    assert [block for _, block in warc._records(data)] == [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + x for x in (b"hi", b"ho")]


# --- 2 and 4


def test_token_counts(spark):
    library = Tokenizer.from_file(CLIP)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(table(spark, ODD), allowMissingColumns=True)
    rows = docs.toPandas()
    got = token_counts.count_tokens(docs, CLIP, cache=50).toPandas()
    want = Counter((i if i == i else None, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in zip(rows.doc_id, rows.text))
    assert Counter((i if i == i else None, b, n) for i, b, n in zip(got.doc_id, got.n_bytes, got.n_tokens)) == want
    assert (got.over_limit == (got.n_tokens > 2048)).all()
    assert token_counts.count_tokens(docs.limit(0), CLIP).count() == 0


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark):
    library = _tiktoken()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(table(spark, ODD).select("doc_id", "text"))
    rows = docs.toPandas()
    encoded = written(byte_bpe.encode_documents(docs, BPE, public_tokenizers.PATTERN, cache=2000), "test-encoded")
    got = encoded.toPandas()
    key = lambda i: None if i != i else i
    want = Counter((key(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in zip(rows.doc_id, rows.text))
    assert Counter((key(i), bytes(x)) for i, x in zip(got.doc_id, got.token_ids)) == want
    decoded = byte_bpe.decode_documents(encoded, BPE).toPandas()
    assert Counter(bytes(x) for x in decoded.decoded) == Counter((t or "").encode() for t in rows.text)
    assert byte_bpe.encode_documents(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_pieces_and_long_words():
    library, r = _tiktoken(), random.Random(3)
    pieces = byte_bpe._Pieces(BPE, public_tokenizers.PATTERN, 1000)
    letters = list(" \n\t'abcsé!?19 \x1c\x85́漢\0ß")
    for _ in range(500):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        split = pieces.split(t)
        pieces.encode(set(split))
        ids = ",".join(x for x in (pieces.kept[0][p] for p in split) if x)
        assert ids == ",".join(map(str, library.encode_ordinary(t))), repr(t)
    for w in ("a" * 3000, "!" * 1500, "".join(r.choice("theandio") for _ in range(1200))):
        assert pieces.bpe.encode([w.encode()])[0] == library._encode_single_piece(w.encode())


# --- 3


def test_mixing(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i * 7 % 90)), [None, "a", "b", "c"][i % 4]) for i in range(800)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 45).all() and (got.taken <= 3 * got["size"]).all()
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))


def test_mixing_odds_grow_with_size_and_ties_are_settled(spark):
    rows = [(i, "w " * (400 if i % 2 else 100), "a") for i in range(3000)] + [(3000 + i, "w " * 60, "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    more = (got.copies > got.copies.min())[got.doc_id < 3000]
    p_long, p_short = more[got.doc_id % 2 == 1].mean(), more[got.doc_id % 2 == 0].mean()
    assert p_long > p_short + 0.05 and p_short > 0
    # the odds are as the roots of the sizes: 2 to 1
    assert (p_long / (1 - p_long)) / (p_short / (1 - p_short)) == pytest.approx(2, rel=0.35)
    tied = docs.select(F.lit(7).cast("long").alias("doc_id"), "text", "source")
    assert mixing.mix(tied).count() == 5000


# --- 5


def test_topk_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 8))
    v = np.round(base[r.integers(0, 40, 900)] + r.normal(size=(900, 8)) * 0.05 * r.integers(0, 2, (900, 1)), 2)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(900)], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df).toPandas()
    q = np.floor(v * 256)
    scores = (q @ q.T).astype(int)
    for i in range(0, 900, 50):
        want = sorted(((-scores[i, j], j) for j in range(900) if j != i))[:5]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id)) == want
    odd = spark.createDataFrame([(0, None), (1, [1.0]), (50, [1.0]), (50, [1.0]), (100, [None]), (150, []), (200, [float("nan")]), (None, [1.0]), (2, [float("inf")])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk_search.top_k(odd).collect()] == [(50, 1, 65536)]
    assert topk_search.top_k(odd.limit(0)).count() == 0


# --- 6


def test_secrets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = written(secrets.scan(docs), "test-secrets")
    rows = docs.toPandas()
    planted = {(i, s) for i, t in zip(rows.doc_id, rows.text) for s in re.findall(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert {(r.doc_id, r.candidate) for r in found.where("is_secret").collect()} == planted
    clean = secrets.masked(docs, found)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("text LIKE '%[SECRET]%'").count() == len({i for i, _ in planted})
    frames(spark, secrets.scan)


def test_secret_forest_on_held_out_findings(spark):
    labelled = secrets.labelled_findings(spark)
    triples = secrets.known_triples(secrets.dictionary(spark.read.parquet(f"{SF}/documents.parquet")))
    model = secrets.trained(labelled.where("id % 5 <> 0"), triples)
    rest = labelled.where("id % 5 = 0")
    found = secrets.features(secrets.candidates(rest, "id").join(rest.select(F.col("id").alias("doc_id"), "label"), "doc_id"), triples)
    right = model.transform(found).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.97


# --- 7


def test_masked_lm_scores_are_the_networks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(30)
    model = masked_lm.train(docs)
    got = masked_lm.score(docs, model=model).toPandas().set_index("doc_id")
    p, token = masked_lm.Network(model[1]).part, masked_lm.Vocabulary(model[0])
    from lodestone.llm.wordhash import LOWER, chunks
    import pyarrow as pa

    for r in docs.limit(3).collect():
        (_, w), = chunks(pa.array([r.text]), LOWER)
        t = token(w.hash)
        total = 0.0
        for i in range(len(t)):
            at = [t[i + k] if 0 <= i + k < len(t) else masked_lm.TOKENS for k in masked_lm.PLACES]
            h = np.tanh(sum(p["e"][k][x] for k, x in enumerate(at)) + p["b"])
            g, j = divmod(int(t[i]), masked_lm.PER_CLASS)
            a, z = h @ p["c"] + p["cb"], h @ p["w"][g] + p["wb"][g]
            total += a[g] - np.log(np.exp(a).sum()) + z[j] - np.log(np.exp(z).sum())
        assert got.log_likelihood[r.doc_id] == pytest.approx(float(total), abs=0.02 + 1e-4 * abs(float(total)))


def test_masked_lm_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    model = masked_lm.train(train)
    got = masked_lm.score(held, model=model).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    n = masked_lm.word_counts(held).toPandas().sort_values("n", ascending=False)["n"].to_numpy(float)
    top, rest = n[: masked_lm.TOKENS - masked_lm.UNKNOWN], n[masked_lm.TOKENS - masked_lm.UNKNOWN :].sum()
    share = np.concatenate([top, np.full(masked_lm.UNKNOWN, rest / masked_lm.UNKNOWN)]) / n.sum()
    unigram = (share * np.log(np.maximum(share, 1e-300))).sum()  # the best that any score without context reaches
    assert got[0] / got[1] > unigram + 0.2


def test_masked_lm_gradient():
    r = np.random.default_rng(1)
    net = masked_lm.Network(r.normal(0, 0.3, masked_lm.Network().flat.size))
    context, target = r.integers(0, masked_lm.TOKENS + 1, (4, 64)).astype(np.int32), r.integers(0, masked_lm.TOKENS, 64).astype(np.int32)
    loss = lambda flat: -masked_lm.Network(flat).forward(context, target)[0].astype(float).mean()
    before = net.flat.copy()
    grown = np.zeros_like(before)
    net.step(context, target, grown)
    assert loss(net.flat) < loss(before)
    moved = np.argsort(-grown)[:5]
    for i in moved:
        eps = np.zeros_like(before)
        eps[i] = 1e-2
        assert abs(loss(before + eps) - loss(before - eps)) / 2e-2 == pytest.approx(np.sqrt(grown[i]), rel=0.1, abs=2e-3)


def test_masked_lm_does_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, other = (masked_lm.score(d).toPandas().sort_values("doc_id").log_likelihood.to_numpy() for d in (docs, docs.repartition(5)))
    assert (one == other).all()


def test_masked_lm_trains_on_every_token():
    import pyarrow as pa

    net, token = masked_lm.Network(), masked_lm.Vocabulary([])
    used = masked_lm.learn(net, token, pa.array(["a b c d e", "f", None, "g h"]), np.zeros_like(net.flat), np.random.default_rng(1))
    assert used == 8


def test_masked_lm_vocabulary_grows(spark):
    side = [masked_lm.side(n) for n in (0, 10**6, 10**9, 5 * 10**9, 10**12)]
    assert side[0] == side[1] == masked_lm.CLASSES and side == sorted(side) and side[-1] >= 1000
    for k in side[2:]:
        net = masked_lm.Network(np.zeros(masked_lm._size(k), np.float32))
        assert net.k == k and masked_lm._unknown(k * k) * 16 == k * k
        break
    words, flat = masked_lm.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    assert len(set(words)) == len(words) <= masked_lm.TOKENS - masked_lm.UNKNOWN and np.isfinite(flat).all()


# --- 8


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    c = list(range(len(rows)))

    def root(x):
        while c[x] != x:
            x = c[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                c[root(a)] = root(b)
    small = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            small[root(k)] = min(small.get(root(k), i), i)
    return Counter((i, len(shingles(t)), small[root(k)] if i is not None else None) for k, (i, t) in enumerate(rows))


def families(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{r.randint(0, 4000)}" for _ in range(r.choice([4, 6, 30, 120, 300]))]
        for _ in range(r.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy) + r.choice(["", "\n"])))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(len(rows) + k, passage + " " + " ".join(f"q{r.randint(0, 10**6)}" for _ in range(20 + 3 * k))) for k in range(25)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_brute_force(spark, seed):
    rows = families(seed) + ([(i, t) for i, t in ODD if i != 6] if seed == 2 else [])
    members, links = ngram_join.near_duplicate_classes(table(spark, rows))
    key = lambda x: None if x != x else int(x)
    got = members.toPandas()
    assert Counter(zip(map(key, got.doc_id), got.n_shingles, map(key, got.component_id))) == brute_components(rows)
    for r in links.collect():
        assert 180 * r.shared >= 80 * (r.n_a + r.n_b)
    few, _ = ngram_join.near_duplicate_classes(table(spark, rows), every_link=False)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in few.collect()) == brute_components(rows)


def test_count_tree_finds_all(spark):
    r = np.random.default_rng(4)
    base = r.poisson(1.0, (12, 64))
    points = np.maximum(base[r.integers(0, 12, 700)] + r.integers(-1, 2, (700, 64)) * (r.random((700, 64)) < 0.05), 0).astype(np.uint8)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = ngram_join.CountTree(points, sizes)
    for i in range(0, 700, 37):
        want = {j for j in range(700) if 180 * int(np.minimum(points[i], points[j]).sum()) >= 80 * int(sizes[i] + sizes[j])}
        assert set(tree.search(points[i], int(sizes[i]), 80, 100).tolist()) == want


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(r.randint(100, 140), r.randint(100, 140)) for _ in range(25)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    c = {}
    for a, b in [(a, b) for a, b in edges if a is not None and a != b] * 60:
        m = min(c.get(a, a), c.get(b, b))
        c[a] = c[b] = m
    assert got == c


# --- 9


def brute_statistics(t):
    t = t or ""
    w = WORDS.findall(t)
    n = len(w)
    grams = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    covered = set()
    for i in range(n - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def brute_verdicts(rows):
    """The squared distances in numpy: rows with doc_id, lang, source, base_failed and the statistics."""
    keys = list(quality.STATS)
    floor = np.array([quality.STATS[k] * quality.UNIT for k in keys])
    x, ok = rows[keys].to_numpy(float), ~rows.base_failed.to_numpy()
    scale = quality.H / quality._gamma_p((len(keys) + 2) / 2, quality.chi2_quantile(quality.H, len(keys)) / 2)

    def moments(near, factor):
        mean = near.mean(axis=0)
        return mean, (near.T @ near / len(near) - np.outer(mean, mean)) * factor + np.diag(floor**2)

    def distance(x, mean, inverse):
        return ((x - mean) @ inverse * (x - mean)).sum(axis=1)

    def estimate(x):
        low, median, high = np.percentile(x, [25, 50, 75], axis=0)
        plain = moments(x, 1.0)
        starts = [(median, np.diag(((high - low) / 1.349 + floor) ** -2.0)), (plain[0], np.linalg.inv(plain[1])), (median, np.diag(floor**-2.0))]
        best = None
        for mean, inverse in starts:
            before = np.inf
            while True:
                part = np.floor(np.log2(1 + distance(x, mean, inverse)) * quality.PARTS)
                values, n = np.unique(part, return_counts=True)
                mean, cov = moments(x[part <= values[np.flatnonzero(np.cumsum(n) >= len(x) * quality.H)[0]]], scale)
                now, inverse = np.linalg.slogdet(cov)[1], np.linalg.inv(cov)
                if now >= before - quality.SETTLED:
                    break
                before = now
            if best is None or now < best[0]:
                best = now, mean, cov
        return best[1:]

    def pooled(mask, wide):
        n, k = mask.sum(), quality.WEIGHT
        if not n:
            return wide
        (m, c), (wm, wc) = estimate(x[mask]), wide
        mean = (n * m + k * wm) / (n + k)
        return mean, (n * (c + np.outer(m, m)) + k * (wc + np.outer(wm, wm))) / (n + k) - np.outer(mean, mean)

    everything, d2 = estimate(x[ok]), np.full(len(rows), np.nan)
    for lang in rows.lang.unique():
        in_lang = (rows.lang == lang).to_numpy() | (rows.lang.isna().to_numpy() & (lang is None))
        wide = pooled(in_lang & ok, everything)
        for source in rows.source[in_lang].unique():
            group = in_lang & (rows.source == source).to_numpy()
            mean, cov = pooled(group & ok, wide)
            d2[group] = distance(x[group], mean, np.linalg.inv(cov))
    return d2


def test_quality_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source")))
    got = quality.quality_rules(docs).toPandas().set_index("doc_id").sort_index()
    texts = docs.toPandas().set_index("doc_id").sort_index()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i in got.index[::3]:
        assert tuple(got.loc[i, names]) == brute_statistics(texts.text[i]), i
    base = quality.base_statistics(docs, "doc_id", "text", "lang", "source").select("*", *quality._vector()).toPandas().sort_values("doc_id").reset_index(drop=True)
    base["base_failed"] = got.base_failed.to_numpy()
    d2 = brute_verdicts(base)
    assert got.distance2.to_numpy() == pytest.approx(d2, rel=1e-6)
    cut = quality.chi2_quantile(1 - quality.TAIL, len(quality.STATS))
    assert (got.kept.to_numpy() == (~base.base_failed & ~(d2 > cut))).all()


def test_quality_keeps_clean_documents(spark):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id")
    got = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas().set_index("doc_id").join(labels, how="inner")
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.2


# --- 10


def brute_removal(rows):
    words = [WORDS.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for p in range(len(w) - 49):
                s = tuple(w[p : p + 50])
                first[s] = min(first.get(s, i), i)
    out = Counter()
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_substring_brute_force(spark):
    r = random.Random(5)
    word = lambda: r.choice("abcde")
    shared = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 130)]
    rows = [(k, " ".join(r.choice(shared) if r.random() < 0.5 else word() for _ in range(r.randint(0, 6)))) for k in range(80)]
    rows += [(90, "a " * 300), (91, "a " * 60), (92, shared[3]), (92, shared[3] + " x"), (None, shared[3]), (93, None), (94, "")] + [(i, t) for i, t in ODD if i != 6]
    got = substring_dedup.remove_repeats(table(spark, rows)).toPandas()
    mine = Counter((None if i != i else int(i), a, b, c) for i, a, b, c in zip(got.doc_id, got.n_words, got.n_removed, got.kept_sha256))
    assert mine == brute_removal(rows)


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_differ_by_a_pattern_are_different(spark):
    """Polynomials modulo 2^64 take a Thue-Morse word and its complement for the same."""
    a, b = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    rest = [f"w{i}" for i in range(60)]
    texts = [" ".join([*rest[:30], x, *rest[30:]]) for x in (a, b)]
    got = substring_dedup.remove_repeats(table(spark, list(enumerate(texts)))).toPandas()
    assert got.n_removed.tolist() == [0, 0]
    members, links = ngram_join.near_duplicate_classes(table(spark, [(1, a), (2, b), (3, a + " x y z"), (4, b + " x y z")]))
    assert sorted(r.component_id for r in members.collect()) == [1, 2, 3, 4] and links.count() == 0


def test_places_come_from_the_automaton():
    import pyarrow as pa
    from lodestone.llm.wordhash import chunks

    r = random.Random(8)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
    texts = [" ".join(words[:150]), " ".join(words[120:300]), "", " ".join(words[:60])]
    (_, w), = chunks(pa.array(texts))
    code, *_ = substring_dedup._windows(w, 50)
    some = np.unique(code[[3, 40, 200]])
    at = substring_dedup.Automaton(some)(w)
    assert set(np.flatnonzero(at)) == {i for i in range(len(code)) if code[i] in some and w.text[i] == w.text[i + 7]} and at.sum() >= 3
    assert not len(substring_dedup.runs_of(w, np.zeros_like(at), 50)[0])
    start, n, _, _ = substring_dedup.runs_of(w, np.ones_like(at) & substring_dedup.inside(w, 8), 50)
    covered = {s + k for s, m in zip(start, n) for k in range(m)}
    assert covered == set(np.flatnonzero(substring_dedup.inside(w, 50)))


def test_substring_shards_and_parts_do_not_matter(spark):
    r = random.Random(9)
    shared = [" ".join(f"p{r.randint(0, 10**6)}" for _ in range(70)) for _ in range(6)]
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(r.randint(0, 30))] + [r.choice(shared)] + [f"v{i}x{k}" for k in range(r.randint(0, 30))])) for i in range(120)]
    got = substring_dedup.remove_repeats(table(spark, rows), phrases_of_shard=3, shard_bytes=5000).toPandas()
    assert Counter(zip(got.doc_id, got.n_words, got.n_removed, got.kept_sha256)) == brute_removal(rows)
