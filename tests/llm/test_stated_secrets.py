"""Short secrets that their context states, and a dictionary that follows the size of the corpus."""

import random
import re
import string

import pytest
from lodestone.llm import secrets
from lodestone.llm.common import written

TEXTS = {1: ("password: hunter2Abc then", "hunter2Abc"), 2: ("use pwd=S3cr3t!Pass9 now", "S3cr3t!Pass9"), 3: ("see postgres://bob:Zk8!qW2x@db.host/x", "Zk8!qW2x"), 4: ('api_key = "aB3.xY9:Qw2@Lm" here', "aB3.xY9:Qw2@Lm")}
PLAIN = "the password house is under water and the market stands over the light press"


def test_stated_secrets_are_found_and_masked(spark):
    rows = [(i, t) for i, (t, _) in TEXTS.items()] + [(10 + i, PLAIN) for i in range(50)] + [(99, "password: required and the token: market")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = written(secrets.scan(docs), "test-stated")
    assert {(r.doc_id, r.candidate) for r in found.where("is_secret").collect()} == {(i, s) for i, (_, s) in TEXTS.items()}
    clean = {r.doc_id: r.text for r in secrets.masked(docs, found).collect()}
    assert all(s not in clean[i] and secrets.MASK in clean[i] for i, (_, s) in TEXTS.items()) and clean[99] == rows[-1][1]


def test_dictionary_is_relative(spark):
    small = spark.createDataFrame([("common words",), ("common words",)], "text string")
    assert {r.triple for r in secrets.dictionary(small).collect()} >= {"com", "mon", "wor"}
    rare = spark.range(1_000_000).selectExpr("'often' AS text").union(spark.range(4).selectExpr("'qzx' AS text"))
    assert "qzx" not in {r.triple for r in secrets.dictionary(rare).collect()}


def _of(alphabet, n):
    return lambda r: "".join(r.choice(alphabet) for _ in range(n))


B64 = string.ascii_letters + string.digits
#: Forms of findings that the generator of labelled ones does not make: (text, how the secret is made).
FORMS = {
    "cloud id": ("export AWS_ACCESS_KEY_ID={} and", lambda r: "AKIA" + _of(string.ascii_uppercase + string.digits, 16)(r)),
    "cloud key": ("AWS_SECRET_ACCESS_KEY={} is set", _of(B64, 40)),
    "web token": ("Authorization: Bearer {} was sent", lambda r: "eyJ" + _of(B64, 33)(r) + ".eyJ" + _of(B64, 60)(r) + "." + _of(B64, 43)(r)),
    "yaml": ("auth_token: {} in the file", _of("0123456789abcdef", 48)),
    "json": ('{{"client_secret":"{}","a":1}} here', _of(B64, 32)),
    "password": ("the db_password={} for it", lambda r: _of(B64, 6)(r) + r.choice("!#%&") + _of(string.digits, 3)(r)),
    "address": ("amqp://svc:{}@queue.local/v", lambda r: _of(B64, 8)(r) + r.choice("!#%&") + _of(B64, 3)(r)),
}


def test_recall_on_forms_that_training_lacks(spark):
    r = random.Random(12)
    rows, want = [], {}
    for form, (frame, make) in FORMS.items():
        for _ in range(40):
            secret = make(r)
            want[len(rows)] = (form, secret)
            rows.append((len(rows), "we saw " + frame.format(secret) + " of the house"))
    plain = [(10_000 + i, PLAIN) for i in range(200)]
    found = secrets.scan(spark.createDataFrame(rows + plain, "doc_id long, text string")).where("is_secret").collect()
    hit = {f.doc_id for f in found if f.doc_id in want and want[f.doc_id][1] in f.candidate}
    share = {form: sum(i in hit for i, (f, _) in want.items() if f == form) / 40 for form in FORMS}
    assert min(share.values()) >= 0.9, share
    assert not [f for f in found if f.doc_id >= 10_000]


def test_features_brute_force(spark):
    texts = ["key = 'abc123DEF456ghi789JKL'", "see https://a.example/path/to/thewordsthere now", "token: 0123456789abcdef0123", "the-common-words-in-a-row", "x ==== y ________________ z"]
    known = secrets.known_triples(spark.createDataFrame([("the",), ("wor",), ("com",)], "triple string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.features(secrets.candidates(docs), known).collect()
    assert len(got) >= 5
    for x in got:
        c, n = x.candidate, len(x.candidate)
        triples = {t for t in (c.lower()[i : i + 3] for i in range(n - 2)) if re.fullmatch("[a-z]{3}", t)}
        assert x.length == n and x.digits == pytest.approx(sum(k in string.digits for k in c) / n) and x.capitals == pytest.approx(sum(k in string.ascii_uppercase for k in c) / n)
        assert x.coverage == pytest.approx(len(triples & {"the", "wor", "com"}) / max(len(triples), 1))
        assert x.distinct == pytest.approx(len(set(c)) / min(n, 64)) and x.separators == pytest.approx(sum(k in "-_/" for k in c) / n)
        assert x.transitions == pytest.approx(len(re.findall("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]", c)) / n)
        assert x.hexadecimal == bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c)) and x.symbols == pytest.approx(len(re.findall("[^A-Za-z0-9+/_=-]", c)) / n)
