"""Reports of evaluations as a data source to write to: a JSON and a Markdown file that appear together or not at all.

Phase one: each task writes its rows, in both forms, as files of its own into a hidden folder; only the files of attempts that
Spark accepts are named to the driver. Phase two: the driver joins them in order of the partitions, reading one
piece at a time, and a link to the finished folder takes the place of the last report in one step. A run that fails leaves
the last report, or none. The folder lies on a file system that driver and executors mount.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import datasource as ds

from lodestone.sources.trees import mounted

NAME = "evaluation_report"
#: Bytes that the driver holds at once.
PIECE = 1 << 20

# File names, titles and headings of the two reports.
REPORTS = {
    "retrieval": ("retrieval-results.json", "retrieval-report.md", "Retrieval evaluation report", {"method": "Method", "recall_at_1": "Recall@1", "recall_at_3": "Recall@3", "recall_at_5": "Recall@5", "recall_at_10": "Recall@10", "mrr": "MRR", "precision_at_5": "Precision@5"}),
    "generation": ("generation-results.json", "generation-report.md", "Generation evaluation report", {"case_id": "Case", "citation_precision": "Citation precision", "citation_recall": "Citation recall", "relevance": "Answer relevance", "groundedness": "Groundedness"}),
}


def cell(value: object) -> str:
    """A cell of a Markdown table: numbers with three digits, N/A for none, and text that stays in its cell."""
    if value is None:
        return "N/A"
    if isinstance(value, float):
        return f"{value:.3f}"
    return re.sub(r"\s*[\r\n]+\s*", " ", str(value)).replace("|", "\\|")


@dataclass
class Part(ds.WriterCommitMessage):
    """What a task wrote: its place in order, its files' name, and its number of rows."""

    partition: int
    name: str
    rows: int


class ReportWriter(ds.DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        folder = mounted(options.get("path") or "")
        if not folder.startswith("/"):
            raise ValueError("the option path must be a folder of a mounted file system")
        self.kind = options.get("kind", "retrieval")
        if self.kind not in REPORTS:
            raise ValueError(f"kind must be one of {', '.join(REPORTS)}")
        missing = [c for c in REPORTS[self.kind][3] if c not in columns]
        if missing:
            raise ValueError(f"the rows lack the columns {', '.join(missing)}")
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        if os.path.lexists(self.folder) and not (overwrite and os.path.islink(self.folder)):
            raise FileExistsError(f"{self.folder} is there" + ("" if overwrite else "; mode overwrite takes its place") + ("" if os.path.islink(self.folder) else ", and is no report"))
        parent, name = os.path.split(self.folder)
        self.hidden = os.path.join(parent, f".{name}-{uuid.uuid4().hex}")
        os.makedirs(self.hidden)  # here alone: a task that outlives its run has nowhere to write

    def write(self, iterator: Iterator[Row]) -> Part:
        part = Part(TaskContext.get().partitionId(), uuid.uuid4().hex, 0)
        place = os.path.join(self.hidden, part.name)
        with open(place + ".json", "w", encoding="utf-8") as data, open(place + ".md", "w", encoding="utf-8") as table:
            for row in iterator:
                data.write((",\n" if part.rows else "") + json.dumps(row.asDict(recursive=True), indent=2, default=str))
                table.write("| " + " | ".join(cell(row[c]) for c in REPORTS[self.kind][3]) + " |\n")
                part.rows += 1
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        data_file, table_file, title, headings = REPORTS[self.kind]
        done = os.path.join(self.hidden, "report")
        os.makedirs(done)
        with open(os.path.join(done, data_file), "w", encoding="utf-8") as out:
            out.write("[")
            for i, p in enumerate(parts):
                out.write(",\n" if i else "\n")
                self._append(out, p.name + ".json")
            out.write("\n]\n" if parts else "]\n")
        with open(os.path.join(done, table_file), "w", encoding="utf-8") as out:
            out.write(f"# {title}\n\n| {' | '.join(headings.values())} |\n|---|{'---:|' * (len(headings) - 1)}\n")
            for p in parts:
                self._append(out, p.name + ".md")
        for f in os.scandir(self.hidden):
            if f.is_file():
                os.remove(f.path)
        self._publish(done)

    def _append(self, out, name: str) -> None:
        with open(os.path.join(self.hidden, name), encoding="utf-8") as f:
            shutil.copyfileobj(f, out, PIECE)

    def _publish(self, done: str) -> None:
        link = self.hidden + ".link"
        os.symlink(os.path.relpath(done, os.path.dirname(self.folder)), link)
        if self.overwrite:
            before = os.path.realpath(self.folder) if os.path.islink(self.folder) else None
            os.replace(link, self.folder)
            if before and os.path.basename(os.path.dirname(before)).startswith(f".{os.path.basename(self.folder)}-"):
                shutil.rmtree(os.path.dirname(before), ignore_errors=True)
            return
        try:
            os.link(link, self.folder, follow_symlinks=False)  # fails where another run was first
        except OSError:
            shutil.rmtree(self.hidden, ignore_errors=True)
            raise
        finally:
            os.remove(link)

    def abort(self, messages: list[Part | None]) -> None:
        gone = self.hidden + ".gone"  # first out of the way of tasks that still run
        os.replace(self.hidden, gone)
        shutil.rmtree(gone, ignore_errors=True)


class EvaluationReport(ds.DataSource):
    """Options: path (the report's folder), kind (retrieval or generation)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options), schema.names, overwrite)


def write_report(rows: DataFrame, folder: str, kind: str = "retrieval", overwrite: bool = False) -> None:
    """Writes rows of evaluation.metrics, or of judged answers by case (kind generation), in their order: every column to JSON, those
    of the kind's headings to Markdown. No rows give an empty list and a table of headings. Raises where a report is there
    already, unless it is to be overwritten, and never touches a folder that is none."""
    rows.sparkSession.dataSource.register(EvaluationReport)
    rows.write.format(NAME).option("kind", kind).mode("overwrite" if overwrite else "append").save(folder)
