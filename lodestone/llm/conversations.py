"""Conversation structure repair by weighted finite-state composition.

A conversation is an input acceptor (a chain of its rows), composed with an edit transducer (keep, re-role, delete, insert)
and an acceptor of role initials, `(s?(ua)+)?`. Composed states (row, grammar state) are expanded only where they are
reached, row by row, which is their topological order; inserts are at most two in a row, as a third would come back to a
state at a higher cost. Weights are (cost, edit initials), least first by cost and then by string: two paths between the
same states never have equal cost and one string before the other, so the order survives composition on either side.

So a conversation need not be one task's. Rows are sorted by conversation and turn over all tasks; each task cuts its rows
into segments and works out a segment's weights between all grammar states. A conversation's segments are then combined in
order, small rows, and its repaired text goes through the digest in order, a segment at a time. Only the digest reads a
conversation's texts in one task, as SHA-256 is defined over one sequence; no task holds them.

Rows: null roles and texts are one blank; null turns come first; rows of one turn come by role and text, equal rows next to
each other, all but the first of them duplicates. A null conv_id is a conversation. An empty table gives no rows. Extra
columns are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written

#: The role grammar: state 0 begins, 1 is behind s, 2 behind u, 3 behind a.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = (0, 1, 2, 3), (0, 3)
#: Costs of edits; a truncated row that is not deleted adds 1.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: A segment ends after so many rows, or so many characters of text.
ROWS, CHARACTERS = 1024, 1_000_000

Weights = dict[int, tuple[int, str]]


def _least(weights: Weights, state: int | None, weight: tuple[int, str]) -> None:
    if state is not None and (state not in weights or weight < weights[state]):
        weights[state] = weight


def inserted(weights: Weights) -> Weights:
    """Up to two arcs of the transducer that read nothing."""
    out, now = dict(weights), weights
    for _ in range(2):
        following: Weights = {}
        for state, (cost, label) in now.items():
            for role in ROLES:
                _least(following, GRAMMAR.get((state, role)), (cost + INSERT, label + "I"))
        for state, weight in following.items():
            _least(out, state, weight)
        now = following
    return out


def read(weights: Weights, initial: str, delete: bool, truncated: bool) -> Weights:
    """The composition's arcs that read one row, from all states reached."""
    more = TRUNCATED if truncated else 0
    out: Weights = {}
    for state, (cost, label) in weights.items():
        _least(out, state, (cost + DELETE, label + "D"))
        if not delete:
            _least(out, GRAMMAR.get((state, initial)), (cost + more, label + "K"))
            for role in ROLES:
                _least(out, GRAMMAR.get((state, role)), (cost + more + REROLE, label + "R"))
    return out


def walked(state: int, edits: str, roles: list[str], texts: list[str | None]) -> tuple[int, list[tuple[str, str]]]:
    """The state behind the edits and the repaired (role, text): the grammar leaves one role to each insert and re-role."""
    out, row = [], 0
    for e in edits:
        if e != "D":
            role = roles[row] if e == "K" else ROLES["a" if state == 2 else "u"]
            out.append((role, "" if e == "I" else texts[row]))
            state = GRAMMAR[state, role[:1]]
        row += e != "I"
    return state, out


def conversation_key(conv_id: Column) -> Column:
    """Text for each conv_id, null too."""
    return F.coalesce(F.concat(F.lit("v"), conv_id.cast("string")), F.lit("n"))


def damaged(rows: DataFrame) -> DataFrame:
    """(key, has_turn, at, role, text, copies) of conversation rows after damage by crc32(`conv_id:turn`) % 20."""
    blank = F.lit(" ")
    text, role = F.coalesce(F.col("text").cast("string"), blank), F.coalesce(F.col("role").cast("string"), blank)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(F.encode(name, "utf-8")) % 20
    out = rows.select(
        conversation_key(F.col("conv_id")).alias("key"),
        F.col("turn").cast("long").alias("at"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
        fault.alias("fault"),
    )
    return turned(out.where("fault <> 0"))


def turned(rows: DataFrame) -> DataFrame:
    """(key, has_turn, at, role, text, copies) of rows with a turn `at` that may be null."""
    return rows.select("key", F.col("at").isNotNull().alias("has_turn"), F.coalesce("at", F.lit(0).cast("long")).alias("at"), "role", "text", "copies")


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies, whether they are the first of their role and text in the conversation, blank, truncated.

    Equal rows are summed before anything moves. The first turn of a role and text is joined on the turn too, so that a
    text said in very many turns is no hot key."""
    same = rows.groupBy("key", "has_turn", "at", "role", "text").agg(F.sum("copies").alias("copies"))
    first = rows.groupBy("key", "role", "text").agg(F.min(F.struct("has_turn", "at")).alias("turn"))
    first = first.select("key", "role", "text", "turn.has_turn", "turn.at", F.lit(True).alias("first"))
    out = same.join(first, ["key", "has_turn", "at", "role", "text"], "left")
    word, end = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
    return out.withColumns({"first": F.coalesce("first", F.lit(False)), "blank": ~F.col("text").rlike(word), "truncated": ~F.col("text").rlike(end)})


SEGMENTS = (
    "key string, seg long, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "initials string, weights array<struct<start:int,end:int,cost:long,edits:string>>, roles array<string>, texts array<string>"
)
_SEGMENT = pa.schema(
    [
        ("key", pa.string()),
        ("seg", pa.int64()),
        *[(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")],
        ("initials", pa.string()),
        ("weights", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))),
        ("roles", pa.list_(pa.string())),
        ("texts", pa.list_(pa.string())),
    ]
)
#: Stands for a role without a first character, so that each row has one initial.
NONE = "\0"


def segments(rows: DataFrame, most: int = ROWS, characters: int = CHARACTERS) -> DataFrame:
    """Segments of conversations (SEGMENTS) in order of seg, of rows of `faults`. Texts of rows that must go are left out."""
    order = ["key", "has_turn", "at", "role", "text"]

    class Segment:
        def __init__(self, key: str, starts: tuple[int, ...]):
            self.row = {"key": key, **dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns"), 0), "first_turn": None, "last_turn": None, "roles": [], "texts": []}
            self.weights = {s: {s: (0, "")} for s in starts}
            self.initials: list[str] = []
            self.size = 0

        def add(self, turn: int | None, role: str, text: str, first: bool, blank: bool, truncated: bool) -> None:
            r, initial = self.row, role[:1] or NONE
            if turn is not None and turn != r["last_turn"]:
                r["turns"] += 1
                r["first_turn"] = turn if r["first_turn"] is None else r["first_turn"]
                r["last_turn"] = turn
            fault = "blank" if blank else "duplicate" if not first else "truncated" if truncated else None
            if fault:
                r[fault] += 1
            if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
                r["illegal"] += 1
            delete = fault in ("blank", "duplicate")
            self.initials.append(initial)
            r["roles"].append(role)
            r["texts"].append(None if delete else text)
            r["n"] += 1
            self.size += 0 if delete else len(text)
            self.weights = {s: read(inserted(w), initial, delete, fault == "truncated") for s, w in self.weights.items()}

        def done(self, seg: int) -> pa.RecordBatch:
            found = [{"start": s, "end": e, "cost": c, "edits": x} for s, w in self.weights.items() for e, (c, x) in w.items()]
            return pa.RecordBatch.from_pylist([self.row | {"seg": seg, "initials": "".join(self.initials), "weights": found}], schema=_SEGMENT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, now = TaskContext.get().partitionId() << 32, None
        for b in batches:
            for r in b.to_pylist():
                for k in range(r["copies"]):
                    fresh = now is not None and now.row["key"] != r["key"]
                    if now is not None and (fresh or now.row["n"] >= most or now.size >= characters):
                        yield now.done(seg)
                        seg, now = seg + 1, None
                    if now is None:
                        # the rows before a task's first conversation or a cut may leave any state
                        now = Segment(r["key"], (0,) if fresh else STATES)
                    now.add(r["at"] if r["has_turn"] else None, r["role"], r["text"], r["first"] and k == 0, r["blank"], r["truncated"])
        if now is not None:
            yield now.done(seg)

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "copies", "first", "blank", "truncated").mapInArrow(cut, SEGMENTS)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FOLDED = "key string, seg long, state int, edits string, " + ", ".join(f"{c} long" for c in COUNTS)


def folded(cut: DataFrame) -> DataFrame:
    """(FOLDED) a conversation's totals and edits with seg null, and the edits of each of its segments with the state before."""
    schema = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), *[(c, pa.int64()) for c in COUNTS]])

    class Conversation:
        def __init__(self, key: str):
            self.key, self.weights, self.sure = key, {0: (0, "")}, []
            self.parts: list[tuple[int, str]] = []
            self.total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
            self.low = self.high = None
            self.last = ""

        def add(self, r: dict) -> None:
            for c in self.total:
                self.total[c] += r[c]
            if r["first_turn"] is not None:
                self.total["turns"] -= r["first_turn"] == self.high
                self.low, self.high = r["first_turn"] if self.low is None else self.low, r["last_turn"]
            if self.last and self.last + r["initials"][0] not in ("su", "ua", "au"):
                self.total["illegal"] += 1
            self.last = r["initials"][-1]
            self.parts.append((r["seg"], r["initials"]))
            out: Weights = {}
            for w in r["weights"]:
                if w["start"] in self.weights:
                    cost, label = self.weights[w["start"]]
                    _least(out, w["end"], (cost + w["cost"], label + w["edits"]))
            # what all paths begin with is settled; the rest stays short
            common = os.path.commonprefix([label for _, label in out.values()])
            self.sure.append(common)
            self.weights = {s: (cost, label[len(common) :]) for s, (cost, label) in out.items()}

        def done(self) -> Iterator[dict]:
            cost, tail = min(w for s, w in inserted(self.weights).items() if s in FINAL)
            edits = "".join([*self.sure, tail])
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.total.pop("turns")
            self.total.pop("turns", None)
            yield dict.fromkeys(schema.names) | {"key": self.key, "edits": edits, "gaps": gaps, "cost": cost} | self.total
            at, state = 0, 0
            for k, (seg, initials) in enumerate(self.parts):
                begin, rows = at, len(initials)
                while rows or (k + 1 == len(self.parts) and at < len(edits)):
                    rows -= edits[at] != "I"
                    at += 1
                yield dict.fromkeys(schema.names) | {"key": self.key, "seg": seg, "state": state, "edits": edits[begin:at]}
                state = walked(state, edits[begin:at], list(initials), [""] * len(initials))[0]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or now.key != r["key"]:
                    out.extend(now.done() if now else ())
                    now = Conversation(r["key"])
                now.add(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist(list(now.done()), schema=schema)

    return cut.drop("roles", "texts").repartition("key").sortWithinPartitions("key", "seg").mapInArrow(fold, FOLDED)


def digests(cut: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of segments and their edits; each segment's edits come just before its rows."""
    wanted = "key string, seg long, part int, state int, edits string, roles array<string>, texts array<string>"
    before = edits.selectExpr("key", "seg", "0 AS part", "state", "edits", "CAST(NULL AS array<string>) AS roles", "CAST(NULL AS array<string>) AS texts")
    rows = cut.selectExpr("key", "seg", "1 AS part", "CAST(NULL AS int) AS state", "CAST(NULL AS string) AS edits", "roles", "texts")
    assert before.columns == [c.split()[0] for c in wanted.split(", ")]

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = held = None
        empty = True
        for b in batches:
            out = []
            for r in b.to_pylist():
                if digest is None or r["key"] != key:
                    if digest is not None:
                        out.append({"key": key, "repaired_sha256": digest.hexdigest()})
                    key, digest, empty = r["key"], hashlib.sha256(), True
                if r["part"] == 0:
                    held = r
                    continue
                for role, text in walked(held["state"], held["edits"], r["roles"], r["texts"])[1]:
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "repaired_sha256": digest.hexdigest()}])

    return before.unionByName(rows).repartition("key").sortWithinPartitions("key", "seg", "part").mapInArrow(feed, "key string, repaired_sha256 string")


def repair(rows: DataFrame, most: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """For rows (key, has_turn, at, role, text, copies) of `turned`: a row a conversation (key, COUNTS, audit, repaired_sha256), and
    the repaired messages (key, seg, n, role, text) in order of seg and n."""
    cut = written(segments(faults(rows), most), "conversation-segments")
    edits = written(folded(cut), "conversation-edits")
    whole = edits.where("seg IS NULL").select("key", *COUNTS, F.col("edits").alias("audit"))
    of = edits.where("seg IS NOT NULL").select("key", "seg", "state", "edits")
    return whole.join(digests(cut, of), "key"), messages(cut, of)


def messages(cut: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, seg, n, role, text): the repaired rows, segment by segment."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                said = walked(r["state"], r["edits"], r["roles"], r["texts"])[1]
                if said:
                    roles, texts = zip(*said, strict=True)
                    yield pa.RecordBatch.from_pydict({"key": [r["key"]] * len(said), "seg": [r["seg"]] * len(said), "n": list(range(len(said))), "role": roles, "text": texts})

    return cut.join(edits, ["key", "seg"]).select("key", "seg", "state", "edits", "roles", "texts").mapInArrow(apply, "key string, seg long, n long, role string, text string")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id, after damage."""
    found = repair(damaged(conversations))[0]
    every = conversations.select("conv_id", conversation_key(F.col("conv_id")).alias("key")).distinct()
    nothing = {**{c: F.lit(0).cast("long") for c in COUNTS}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.join(found, "key", "left").select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in nothing.items()])


#: A weight is (cost, edits, repaired text); each step relaxes two inserts and then one row.
def _oracle() -> str:
    def insert(w: str) -> str:
        def more(x: str, line: str) -> str:
            return f"CASE WHEN {x} IS NULL THEN NULL ELSE struct_pack(c := {x}.c + 2, e := {x}.e || 'I', t := {x}.t || '{line}') END"

        u = f"list_min([{more(f'{w}[1]', chr(10) + 'user:')}, {more(f'{w}[2]', chr(10) + 'user:')}, {more(f'{w}[4]', chr(10) + 'user:')}])"
        return f"[NULL, NULL, {u}, {more(f'{w}[3]', chr(10) + 'assistant:')}]"

    def least(*lists: str) -> str:
        return "[" + ", ".join("list_min([" + ", ".join(f"{x}[{s}]" for x in lists) + "])" for s in (1, 2, 3, 4)) + "]"

    def row(x: str, cost: str, edit: str, line: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN NULL ELSE struct_pack(c := {x}.c + {cost}, e := {x}.e || '{edit}', t := {x}.t || {line}) END"

    def reading() -> str:
        states = []
        sources = {1: [], 2: [(1, "s")], 3: [(1, "u"), (2, "u"), (4, "u")], 4: [(3, "a")]}
        for s, arcs in sources.items():
            options = [row(f"w[{s}]", "3", "D", "''")]
            for source, initial in arcs:
                options.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {row(f'w[{source}]', 'cut', 'K', 'chr(10) || role || chr(58) || text')} END")
                if initial != "s":
                    options.append(f"CASE WHEN NOT gone THEN {row(f'w[{source}]', '2 + cut', 'R', chr(39) + chr(10) + ROLES[initial] + ':' + chr(39) + ' || text')} END")
            states.append("list_min([" + ", ".join(options) + "])")
        return "[" + ", ".join(states) + "]"

    # crc32 bit by bit
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(name))), lambda k: ('0x' || substr(hex(encode(name)), 2 * k + 1, 2))::BIGINT)), lambda a, b: {step})"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), hashed AS (
  SELECT *, xor({crc}, 4294967295) % 20 AS fault FROM named
), broken AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE fault <> 0
), sorted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM broken
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS initial,
    regexp_extract(text, '(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending
  FROM sorted
), judged AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM judged GROUP BY conv_id
), steps AS (
  SELECT conv_id, i, role, text, initial, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut FROM judged
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, [struct_pack(c := 0::BIGINT, e := '', t := ''), NULL, NULL, NULL] AS w FROM totals
  UNION ALL
  SELECT conv_id, i, {reading()} FROM (
    SELECT s.*, {least('w0', 'w1', 'w2')} AS w FROM (
      SELECT *, {insert('w1')} AS w2 FROM (SELECT p.w AS w0, {insert('p.w')} AS w1, s.* FROM paths p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i + 1)) s)
), ends AS (
  SELECT conv_id, list_min([w0[1], w0[4], w1[4], w2[4]]) AS x FROM (
    SELECT *, {insert('w1')} AS w2 FROM (SELECT p.conv_id, p.w AS w0, {insert('p.w')} AS w1 FROM paths p JOIN totals t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.i))
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0) AS cost, coalesce(x.e, '') AS audit, sha256(coalesce(substr(x.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE = _oracle()
