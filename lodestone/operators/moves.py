"""The lifecycle of repositories as a machine over reported moves: illegal ones are rejected, silent stages fail.

A report's effect is a function from the state before it to the state after it, and such functions compose. So a repository's
reports are sorted over all tasks, each task folds its stretch of them for every state that it may begin in, and the
stretches are composed: a repository with a third of all reports is many tasks' work. `streaming.registry` runs the same
machine as keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lifecycle import PROGRESS

#: States: stage and progress. A failure keeps the progress that the stage before it had.
BUSY = ("queued", "ingesting", "indexing")
STATES = [("none", 0), *PROGRESS.items(), ("deleted", 0), *(("failed", PROGRESS[s]) for s in BUSY)]
MOVES = (*PROGRESS, "failed", "deleted")


def _after(state: int, move: str) -> int | None:
    """The state after a legal move, or None. A repository can be queued anew at any time; completed follows ingesting where
    nothing changed."""
    stage, progress = STATES[state]
    legal = {
        "queued": True,
        "ingesting": stage == "queued",
        "indexing": stage == "ingesting",
        "completed": stage in ("ingesting", "indexing"),
        "failed": stage in BUSY,
        "deleted": stage not in ("none", "deleted"),
    }
    return STATES.index((move, progress if move == "failed" else PROGRESS.get(move, 0))) if legal[move] else None


NEXT = [[_after(s, m) for m in MOVES] for s in range(len(STATES))]
#: What a state becomes when nothing is heard of it for too long.
SILENT = [NEXT[s][MOVES.index("failed")] for s in range(len(STATES))]


def advance(state: int, move: int | None, late: bool) -> tuple[int, int, int]:
    """(state, 1 if the move is rejected, 1 if the stage before had failed of silence) after one report; None is no move."""
    stuck = int(late and SILENT[state] is not None)
    state = SILENT[state] if stuck else state
    to = None if move is None else NEXT[state][move]
    return (state, 1, stuck) if to is None else (to, 0, stuck)


def move_code(name: Column) -> Column:
    """The place of a move's name in MOVES; null for any other."""
    place = F.array_position(F.array(*map(F.lit, MOVES)), name)
    return F.when(place > 0, place.cast("int") - 1)


def micros(ts: Column, kind: str) -> Column:
    """Microseconds of a timestamp; one without a time zone is not moved by the session's."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), ts) if kind == "timestamp_ntz" else F.unix_micros(ts)


_STRETCH = "repository_id string, first long, first_seq long, last long, n long, after array<int>, rejected array<long>, stuck array<long>"


def _stretches(rows: DataFrame, timeout: int) -> DataFrame:
    """A row for each repository's stretch in each task, of rows (repository_id, us, seq, move) sorted over all tasks: for each
    state before it the state after it, and how many moves were rejected and stages stuck. One row at a time is held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None

        def done() -> pa.RecordBatch:
            id, first, seq, last, n, runs = at
            columns = [[id], [first], [seq], [last], [n], *([[r[k] for r in runs]] for k in range(3))]
            kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _STRETCH.split(", ")])

        for b in batches:
            for id, us, seq, move in zip(*(b.column(k).to_pylist() for k in range(4))):
                if at is None or id != at[0]:
                    if at is not None:
                        yield done()
                    at = [id, us, seq, us, 0, [(s, 0, 0) for s in range(len(STATES))]]
                late = us - at[3] > timeout
                # states that have met stay together: few steps differ
                steps = {s: advance(s, move, late) for s in {r[0] for r in at[5]}}
                at[5] = [(steps[s][0], r + steps[s][1], k + steps[s][2]) for s, r, k in at[5]]
                at[3], at[4] = us, at[4] + 1
        if at is not None:
            yield done()

    order = ["repository_id", "us", "seq", "move"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(fold, _STRETCH)


def states(moves: DataFrame, timeout: int, until: Column | None = None) -> DataFrame:
    """(repository_id, stage, progress, n_moves, n_rejected, n_stuck) after all reports (repository_id, ts timestamp, seq long,
    move string), taken in order of ts, then seq. A queued, ingesting or indexing repository of which nothing is heard, not
    even an illegal move, for more than `timeout` microseconds has failed; with `until`, a timestamp, silence up to then
    counts too. An illegal, null or unknown move is rejected and changes nothing. Reports without a time take no part;
    reports of no repository (null) are one of their own; equal reports count each."""
    kind = moves.schema["ts"].dataType.simpleString()
    id = moves.schema["repository_id"].dataType.simpleString()
    rows = moves.where("ts IS NOT NULL").select(F.col("repository_id").cast("string").alias("repository_id"), micros(F.col("ts"), kind).alias("us"), F.coalesce(F.col("seq").cast("long"), F.lit(-1).cast("long")).alias("seq"), move_code(F.col("move")).alias("move"))
    silent = F.array(*[F.lit(s) for s in SILENT])
    part = F.struct("first", "first_seq", "last", "n", "after", "rejected", "stuck")
    whole = _stretches(rows, timeout).groupBy("repository_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("long").alias("last"), zero.alias("n"), zero.alias("rejected"), zero.alias("stuck"))

    def waited(a: Column, now: Column) -> Column:
        return F.coalesce((now - a["last"] > timeout) & F.get(silent, a["at"]).isNotNull(), F.lit(False))

    def compose(a: Column, p: Column) -> Column:
        late = waited(a, p["first"])
        s = F.when(late, F.get(silent, a["at"])).otherwise(a["at"])
        return F.struct(
            F.get(p["after"], s).alias("at"),
            p["last"].alias("last"),
            (a["n"] + p["n"]).alias("n"),
            (a["rejected"] + F.get(p["rejected"], s)).alias("rejected"),
            (a["stuck"] + F.get(p["stuck"], s) + late.cast("long")).alias("stuck"),
        )

    out = whole.select("repository_id", F.aggregate("parts", start, compose).alias("a"))
    a = F.col("a")
    over = F.lit(False) if until is None else waited(a, micros(until.cast(kind), kind))
    out = out.select("repository_id", F.when(over, F.get(silent, a["at"])).otherwise(a["at"]).alias("at"), "a", over.cast("long").alias("over"))
    names, progress = (F.array(*[F.lit(s[k]) for s in STATES]) for k in (0, 1))
    return out.select(
        F.col("repository_id").cast(id).alias("repository_id"),
        F.get(names, F.col("at")).alias("stage"),
        F.get(progress, F.col("at")).alias("progress"),
        a["n"].alias("n_moves"),
        a["rejected"].alias("n_rejected"),
        (a["stuck"] + F.col("over")).alias("n_stuck"),
    )
