"""Secret scans: candidate strings by pattern, false positives removed by a random forest, in DataFrame operations
and Spark's own machine learning only.

A candidate is a run of at least LEAST token characters, or what is stated to be a secret: a value of at least SHORT
characters of any kind that is assigned to a password, secret, token or key, or the password of an address. Its features: length, transitions between character classes,
share of distinct characters, shares of digits and capitals, hexadecimal digits only, dictionary coverage, whether the
word is a path or address, what its neighbouring words say, the share of other characters, and whether it is stated. Dictionary coverage is the share of the
candidate's letter triples that the corpus' common words contain; those words are counted over all documents, and there
are at most 26^3 triples, so that table may be broadcast.

The forest is trained from labelled findings: `labelled_findings` makes LABELLED of them, secrets and the usual false
alarms, in contexts that speak for and against; other labelled snippets (text, label) can be given instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE_RUN, written

LEAST, SHORT = 16, 6
#: A web token of three parts, or a run of token characters; a sign of equality only ends one, so names and values part.
TOKEN = r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST
#: A name that a secret is assigned to, with its sign of assignment.
NAMED = r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[a-z0-9_-]*[\"'`]?"
ASSIGNED = NAMED + "[:=]+"
#: The password of an address.
CREDENTIAL = "://[^/:@]*:([^/]{%d,})@" % SHORT
#: Given labelled snippets that the forest is fitted to at most, chosen by hash.
MOST_LABELLED = 100_000
#: Labelled findings for training, and how often in a million words a word must occur to be in the dictionary.
LABELLED, COMMON = 6000, 5
TREES, DEPTH, SEED = 24, 7, 11
#: Words that speak for a secret, and against one, as parts of a neighbour.
FOR = "token|secret|passw|pwd|api[_-]?key|apikey|auth|bearer|credential|private[_-]?key|access[_-]?key"
AGAINST = "commit|sha1|sha256|md5|checksum|digest|etag|uuid|guid|revision|example|sample|card|phone|order|invoice|isbn"
MASK = "[SECRET]"


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word_index, part, candidate, word, before, before2, after) of every candidate in every whole text."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), SPACE_RUN).alias("words"))
    at = lambda i: F.coalesce(F.get(F.col("words"), i), F.lit(""))
    named = lambda i: at(i).rlike(ASSIGNED) | at(i).contains("://") | at(i - 1).rlike(ASSIGNED + "[\"'`]?$") | (at(i - 1).rlike("^[:=]+$") & at(i - 2).rlike(NAMED + "$"))
    long = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.length(at(i)) >= LEAST) | ((F.length(at(i)) >= SHORT) & named(i)))
    seen = F.transform(long, lambda i: F.struct(i.alias("i"), at(i).alias("word"), at(i - 1).alias("before"), at(i - 2).alias("before2"), at(i + 1).alias("after")))
    rows = rows.select("doc_id", F.explode(seen).alias("x"))
    runs = F.regexp_extract_all("x.word", F.lit(TOKEN), F.lit(0))
    told = F.filter(F.array_distinct(F.array(*_stated(F.col("x.word"), F.col("x.before"), F.col("x.before2")))), lambda v: ~F.array_contains(runs, v) & (v != ""))
    parts = F.posexplode(F.concat(runs, told)).alias("part", "candidate")
    return rows.select("doc_id", F.col("x.i").alias("word_index"), "x.word", "x.before", "x.before2", "x.after", parts)


def _stated(word: Column, before: Column, before2: Column) -> list[Column]:
    """The values that a word and those before it state to be secrets, empty where they state none."""
    inside = F.regexp_extract(word, ASSIGNED + "(.*)$", 1)
    follows = before.rlike(ASSIGNED + "[\"'`]?$") | (before.rlike("^[:=]+$") & before2.rlike(NAMED + "$"))
    rest = F.when(follows, word).otherwise(inside)
    quoted = F.regexp_extract(rest, "^([\"'`])(.{%d,}?)\\1" % SHORT, 2)
    plain = F.regexp_extract(rest, "^[\"'`]?(.{%d,}?)[\"'`]?[.,;)\\]}]*$" % SHORT, 1)
    return [F.when(quoted != "", quoted).otherwise(plain), F.regexp_extract(word, CREDENTIAL, 1)]


def dictionary(docs: DataFrame, text: str = "text", common: float = COMMON) -> DataFrame:
    """(triple): the letter triples of the words that are at least `common` of a million words of all texts, and occur
    more than once."""
    word = F.explode(F.split(F.lower(F.col(text)), r"[^a-z]+")).alias("word")
    words = written(docs.select(word).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secrets-words")
    all_words = words.agg(F.sum("n")).first()[0] or 0
    words = words.where((F.col("n") >= max(2, common * all_words / 1e6)) & (F.length("word") >= 3))
    return words.select(F.explode(_triples(F.col("word"))).alias("triple")).distinct()


def _triples(c: Column) -> Column:
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


FEATURES = ["length", "transitions", "distinct", "digits", "capitals", "hexadecimal", "coverage", "path", "separators", "assigned", "quoted", "says_for", "says_against", "symbols", "stated"]


def known_triples(triples: DataFrame) -> str:
    """The dictionary as 26^3 characters, 1 where a triple is in it."""
    found = {r.triple for r in triples.collect()}  # 26^3 at most
    letters = "abcdefghijklmnopqrstuvwxyz"
    return "".join("01"[a + b + c in found] for a in letters for b in letters for c in letters)


def features(found: DataFrame, known: str) -> DataFrame:
    """found (of candidates) with the columns FEATURES; known: the dictionary, of known_triples."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    count = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)).cast("double")
    flag = lambda x: x.cast("double")
    near = F.lower(F.concat_ws(" ", "before2", "before", F.split_part("word", c, F.lit(1))))
    letters = F.array_distinct(F.filter(_triples(F.lower(c)), lambda t: t.rlike("^[a-z]{3}$")))
    code = lambda t, i: F.ascii(F.substring(t, i, 1)) - 97
    has = lambda t: F.substring(F.lit(known), code(t, 1) * 676 + code(t, 2) * 26 + code(t, 3) + 1, F.lit(1)) == "1"
    rows = found.withColumn("triples", letters)
    head = F.split_part("word", c, F.lit(1))
    return rows.withColumns({
        "length": n,
        "transitions": count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "digits": count("[0-9]") / n,
        "capitals": count("[A-Z]") / n,
        "hexadecimal": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "coverage": F.size(F.filter("triples", has)) / F.greatest(F.size("triples"), F.lit(1)),
        "path": flag(F.col("word").rlike(r"://|^/|^\.{0,2}/|@|\.[a-z]{2,4}$|/.*/")),
        "separators": count("[-_/]") / n,
        "assigned": flag(head.rlike("[=:]") | F.col("before").rlike("[=:]$")),
        "quoted": flag(head.rlike("[\"'`]$")),
        "says_for": flag(near.rlike(FOR)),
        "says_against": flag(near.rlike(AGAINST)),
        "symbols": count("[^A-Za-z0-9+/_=-]") / n,
        "stated": flag(F.array_contains(F.array(*_stated(F.col("word"), F.col("before"), F.col("before2"))), c)),
    }).drop("triples")


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """(text, label): n snippets of long candidates, label 1 for secrets, and a third as many of short stated values;
    the same rows every time."""
    h = lambda salt: F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    pick = lambda salt, options: F.element_at(F.array(*options), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(options))) + 1).cast("int"))
    words = [F.lit(w) for w in ("counter", "ation", "market", "inter", "national", "house", "under", "stand", "able", "ment", "water", "light", "press", "over", "ing", "the", "er", "tion", "and", "le", "que", "ment", "de", "eau", "schaft", "keit", "ver", "ung", "cion", "ado", "mente", "por")]
    compound = F.concat(*[pick(f"w{k}", words) for k in range(4)])
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[+/=]", "")
    mixed = F.substring(F.concat(b64, F.regexp_replace(F.base64(F.unhex(h("c"))), "[+/=]", "")), F.lit(1), pick("len", [F.lit(x) for x in (20, 24, 32, 36, 40, 48, 64)]))
    uuid = F.concat_ws("-", *[F.substring(h("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    secret = pick("s", [F.substring(h("a"), 1, 40), F.substring(h("a"), 1, 32), F.upper(F.substring(h("a"), 1, 40)), h("a"), mixed, mixed, F.concat(pick("pre", [F.lit("sk_live_"), F.lit("ghp_"), F.lit("AKIA"), F.lit("pk-")]), mixed)])
    digits = F.substring(F.translate(h("d"), "abcdef", "123456"), 1, 16)
    other = pick("o", [
        compound, compound, F.upper(compound), F.initcap(compound), digits, digits, F.concat(F.lit("+"), digits), uuid,
        F.repeat(pick("x", [F.lit("x"), F.lit("0"), F.lit("="), F.lit("-"), F.lit("ab")]), 20),
        F.concat(compound, F.lit("-"), compound), F.concat(compound, F.lit("_"), pick("w9", words)),
        F.concat(F.lit("/"), compound, F.lit("/"), pick("w8", words), F.lit("/index.html")),
        F.concat(F.lit("https://www."), compound, F.lit(".com/"), compound), F.lit("your_api_key_goes_here"), F.lit("REPLACE_WITH_TOKEN"),
    ])
    for_ = pick("f", [F.lit(x) for x in ('token = "%s"', 'TOKEN = "%s"', "token = \"%s\"###", "api_key: %s", "API_KEY=%s", "secret = '%s'", "password: %s", "Authorization: Bearer %s", "access_key = \"%s\",", "client_secret=%s", "%s", "key %s")])
    against = pick("g", [F.lit(x) for x in ("%s", "%s", "%s.", "%s, and", "(%s)", "see %s", "commit %s", "sha256 %s", "card %s", 'name = "%s"', "token %s", "the token = %s")])
    hash_ = F.substring(h("a"), 1, 40)
    label = F.pmod(F.col("id"), F.lit(2)).cast("double")
    # every sixteenth finding is a digest where digests belong
    digest = F.pmod(F.col("id"), F.lit(16)) == 4
    found = F.when(label == 1, secret).when(digest, hash_).otherwise(other)
    frame = F.when(label == 1, for_).when(digest, pick("h", [F.lit("commit %s"), F.lit("sha1 %s"), F.lit("checksum: %s")])).otherwise(against)
    lead = pick("l", [F.lit(x) for x in ("", "the ", "und die ", "que el ", "avec la ")])
    snippet = lambda frame, found: F.concat(lead, F.replace(frame, F.lit("%s"), found), F.lit(" of the")).alias("text")
    long = spark.range(0, n, 1, 1).select("id", snippet(frame, found), label.alias("label"))
    digit, sign = F.substring(F.translate(h("e"), "abcdef", ""), 1, 3), pick("sign", [F.lit(x) for x in "!$#@.:_%&*"])
    word = pick("w1", words)
    short = pick("t", [
        F.concat(word, F.substring(digit, 1, 2), F.initcap(pick("w2", words)), F.substring(digit, 3, 1)), F.concat(F.initcap(word), digit, sign, F.initcap(pick("w2", words)), F.substring(digit, 1, 1)),
        F.concat(F.substring(b64, 1, 5), sign, F.substring(b64, 6, 6)), F.substring(b64, 1, 10), F.concat(F.substring(b64, 1, 2), sign, word, F.substring(digit, 1, 2), F.substring(b64, 3, 2)),
    ])
    plain = pick("q", [F.concat(word, pick("w2", words), F.lit("able")), F.concat(F.initcap(word), pick("w2", words), F.lit("ing")), F.lit("required"), F.lit("********"), F.lit("changeme"), F.lit("<password>"), F.lit("${PASSWORD}"), F.lit("undefined"), F.lit("xxxxxxxx")])
    stated = pick("k", [F.lit(x) for x in ("password: %s", "pwd=%s", "secret = '%s'", "db_password=\"%s\",", "token: %s", "postgres://user:%s@host/db", "PASSWORD=%s.", "api_key: %s")])
    few = spark.range(n, n + n // 3, 1, 1).select("id", snippet(stated, F.when(label == 1, short).otherwise(plain)), label.alias("label"))
    return long.unionByName(few)


def trained(labelled: DataFrame, known: str) -> PipelineModel:
    """The forest fitted to labelled snippets (id, text, label), MOST_LABELLED at most."""
    labelled = labelled.orderBy(F.xxhash64("id", "text"), "id").limit(MOST_LABELLED)
    rows = candidates(labelled, "id").join(labelled.select(F.col("id").alias("doc_id"), "label"), "doc_id")
    rows = written(features(rows, known).select("doc_id", "part", "label", *FEATURES), "secrets-labelled").coalesce(1).sortWithinPartitions("doc_id", "part")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, word_index, part, candidate, probability, is_secret) of every candidate in docs.

    word_index: the place among the parts of the text between runs of white space; part: which candidate of that word.
    Null, empty and blank texts have no candidates; very long texts are scanned whole; equal candidates of a text are
    found at each of their places, and probabilities at the threshold are secrets; rows with null or repeated ids are scanned like any other; an empty
    table gives an empty one (its dictionary has no words); other columns are ignored.
    """
    known = known_triples(dictionary(docs, text))
    model = trained(labelled if labelled is not None else labelled_findings(docs.sparkSession), known)
    scored = model.transform(features(candidates(docs, id, text), known))
    p = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return scored.select("doc_id", "word_index", "part", "candidate", p.alias("probability"), (p >= threshold).alias("is_secret"))


def masked(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text", mask: str = MASK) -> DataFrame:
    """docs with the secrets of `found` (of scan) replaced in their texts, all columns kept."""
    by = found.where("is_secret").groupBy(F.col("doc_id").alias("found_in_")).agg(F.sort_array(F.collect_set("candidate"), asc=False).alias("secrets_"))
    rows = docs.join(by, docs[id] == by["found_in_"], "left")
    # longer strings first, as one secret may be part of another
    order = F.array_sort("secrets_", lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(order, F.col(text), lambda t, s: F.replace(t, s, F.lit(mask)))
    return rows.withColumn(text, F.coalesce(clean, F.col(text))).select(*docs.columns)
