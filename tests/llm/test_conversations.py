"""op13: edits against a search over all edit sequences, with segments of few rows."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest

from lodestone.llm import conversations as c
from lodestone.llm import queries
from tests.util import assert_same

SCHEMA = "conv_id long, turn long, role string, text string, key string, seg int"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def search(rows):
    """(cost, edits, repaired) by Dijkstra's order over all edits, states being the repaired initials as a whole."""
    seen, best = set(), None
    marks = []
    for _, _, role, text in rows:
        blank = not text.strip(SPACE)
        marks.append((role, text, blank or (role, text) in seen, not blank and text.strip(SPACE)[-1] not in ".!?"))
        seen.add((role, text))
    front = {("", ()): (0, "")}
    for i in range(len(marks) + 1):
        for _ in range(3):
            for (initials, lines), (cost, edits) in list(front.items()):
                for r in ("user", "assistant"):
                    key = (initials + r[0], (*lines, f"{r}:"))
                    if re.fullmatch("s?(ua)*u?", key[0]) and ((cost + 2, edits + "I") < front.get(key, (99, ""))) and edits[-2:] != "II":
                        front[key] = (cost + 2, edits + "I")
        if i == len(marks):
            break
        role, text, gone, cut = marks[i]
        following = {}
        for (initials, lines), (cost, edits) in front.items():
            options = [("D", None, 3)]
            if not gone:
                options += [("K", role, cut), ("R", "user", 2 + cut), ("R", "assistant", 2 + cut)]
            for e, r, more in options:
                key = (initials, lines) if r is None else (initials + r[:1], (*lines, f"{r}:{text}"))
                if r is not None and (not r or not re.fullmatch("s?(ua)*u?", key[0])):
                    continue
                following[key] = min(following.get(key, (99, "")), (cost + more, edits + e))
        front = following
    for (initials, lines), weight in front.items():
        if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (weight, lines) < best):
            best = (weight, lines)
    return best


def by_hand(conv, rows):
    rows = damage([r for r in rows if r[0] == conv])
    seen, n = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        last = text.strip(SPACE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    (cost, edits), lines = search(rows)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, digest)


def rows_of(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "", None, "tool", "u:x"]
    return [(rng.choice([None, *range(n)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(["Yes.", "No!", "cut off", "", None, " \t", "é? ", "a\nb."])) for _ in range(n * 4)]


@pytest.mark.parametrize("most", [1, 2, 1024])
def test_repairs_are_the_cheapest(spark, most):
    rows = rows_of(most, 25)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(3)
    got = c.repair(c.damaged(df), most)[0].collect()
    want = {"n" if k is None else f"v{k}": by_hand(k, rows)[1:] for k in {r[0] for r in rows}}
    found = {r.key: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert found == {k: v for k, v in want.items() if k in found}
    query = c.repaired_conversations(df).collect()
    assert sorted(map(str, map(tuple, query))) == sorted(str(by_hand(k, rows)) for k in {r[0] for r in rows})


def test_a_long_conversation_is_cut_into_segments_of_all_tasks(spark):
    rows = [(7, i, ("user", "assistant", "assistant", "user", "system")[i % 5], f"Said {i % 300}." if i % 3 else "cut") for i in range(3000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(4)
    one, many = (c.repair(c.damaged(df), most) for most in (5000, 16))
    assert sorted(map(tuple, one[0].collect())) == sorted(map(tuple, many[0].collect()))
    said = [f"{r.role}:{r.text}" for r in many[1].orderBy("seg", "n").collect()]
    assert hashlib.sha256("\n".join(said).encode()).hexdigest() == one[0].first().repaired_sha256
    cut = c.segments(c.faults(c.damaged(df)), 16)
    assert cut.count() > 150 and cut.agg({"n": "max"}).first()[0] <= 16


def test_nothing_left_and_empty_tables(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = c.repaired_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.", "", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.repaired_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    assert_same(queries.QUERIES["op13_conversations"](spark, sf), c.ORACLE, sf)
