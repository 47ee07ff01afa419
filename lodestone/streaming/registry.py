"""The lifecycle of repositories as a stream: the machine of operators.moves as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators import moves as machine

OUT = "repository_id string, stage string, progress int, n_moves long, n_rejected long, n_stuck long"


class Lifecycle(StatefulProcessor):
    """Reports wait in state until the watermark has passed them, so they are taken in order of time however they arrive. A
    timer fires for the first that waits, and one when a busy stage has been silent for too long."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, move int")
        self.now = handle.getValueState("now", "at int, last long, n long, rejected long, stuck long")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = [(int(u), int(s), None if pd.isna(m) else int(m)) for u, s, m in zip(frame.us, frame.seq, frame.move)]
            self.waiting.appendList(new)
            self._wake(min(x[0] for x in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((x for x in held if x[0] <= passed), key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))
        left = [x for x in held if x[0] > passed]
        before = tuple(self.now.get()) if self.now.exists() else (0, None, 0, 0, 0)
        at, last, n, rejected, stuck = before
        for us, _, move in due:
            at, r, s = machine.advance(at, move, last is not None and us - last > self.timeout)
            last, n, rejected, stuck = us, n + 1, rejected + r, stuck + s
        if last is not None and passed - last > self.timeout and machine.SILENT[at] is not None:
            at, stuck = machine.SILENT[at], stuck + 1
        if due:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        if left:
            self._wake(min(x[0] for x in left))
        if last is not None and machine.SILENT[at] is not None:
            self._wake(last + self.timeout)
        if (at, last, n, rejected, stuck) == before:
            return iter([])
        self.now.update((at, last, n, rejected, stuck))
        stage, progress = machine.STATES[at]
        return iter([pd.DataFrame([(key[0], stage, progress, n, rejected, stuck)], columns=[x.split()[0] for x in OUT.split(", ")])])

    def close(self) -> None:
        pass


def lifecycles(moves: DataFrame, timeout: int, delay: str) -> DataFrame:
    """A stream of states (as of moves.states) of a stream of reports (repository_id, ts, seq, move): one each time the
    watermark, `delay` behind the newest report, has passed reports of a repository, or its silence of more than `timeout`
    microseconds. Later reports than that, and those without a time, are dropped; a missing repository is named "". The session's state store must be RocksDB's."""
    rows = moves.where("ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select(F.coalesce(F.col("repository_id").cast("string"), F.lit("")).alias("repository_id"), "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("seq").cast("long"), F.lit(-1).cast("long")).alias("seq"), machine.move_code(F.col("move")).alias("move"))
    return rows.groupBy("repository_id").transformWithStateInPandas(Lifecycle(timeout), OUT, "Update", "EventTime")
