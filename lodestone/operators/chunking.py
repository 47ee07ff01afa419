"""Deterministic, line-addressable chunks of files.

A file becomes sections (Python by its syntax tree, Markdown by headings, all else as a whole); a section's lines are
packed into pieces of bounded length by one pass over its lines, in Arrow batches.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import ChunkConfig
from lodestone.functions import text

SECTION = "repository_id string, path string, language string, content string, start_line int, symbol string, kind string, whole boolean"


PIECE = "repository_id string, path string, language string, content string, start_line int, end_line int, symbol string, kind string, part int, parts int"


def line_spans(lengths: list[int], config: ChunkConfig) -> list[tuple[int, int]]:
    """Half-open spans of lines packed greedily to max_chars; a longer line stands alone. The next span starts
    overlap_lines before the last one's end, but later than its start. Each step moves one end of the span."""
    out, start, end, size = [], 0, 0, 0
    while end < len(lengths):
        if end > start and size + lengths[end] > config.max_chars:
            out.append((start, end))
            later = max(start + 1, end - config.overlap_lines)
            size -= sum(lengths[start:later])
            start = later
        else:
            size += lengths[end]
            end += 1
    return [*out, (start, end)] if lengths else out


def pieces(sections: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of sections (SECTION): a section marked whole stays in one piece, one without lines has none."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in PIECE.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for repository, path, language, content, first, symbol, kind, whole in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = (content or "").splitlines(keepends=True)
                spans = [(0, len(lines))] if whole and lines else line_spans([len(x) for x in lines], config)
                rows += [(repository, path, language, "".join(lines[x:y]), first + x, first + y - 1, symbol, kind, i + 1, len(spans)) for i, (x, y) in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    rows = sections.select(*[x.split()[0] for x in SECTION.split(", ")]).mapInArrow(pack, PIECE)
    key = [F.col(c) for c in ("repository_id", "path", "start_line", "end_line", "symbol", "kind", "content")]
    return rows.select(
        text.chunk_id(*key).alias("chunk_id"), "repository_id", F.col("path").alias("file_path"), "language", "content", "start_line", "end_line",
        F.col("symbol").alias("symbol_name"), F.col("kind").alias("chunk_type"), "part", "parts",
    )


def text_sections(files: DataFrame) -> DataFrame:
    return files.select("repository_id", "path", "language", "content", F.lit(1).alias("start_line"), F.lit(None).cast("string").alias("symbol"), F.lit("fallback").alias("kind"), F.lit(False).alias("whole"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """From each heading to the next; what stands before the first, if not blank; a file without headings as text."""
    rows = files.withColumn("lines", text.lines(F.col("content")))
    heads = F.filter(F.transform("lines", lambda x, i: F.when(F.ltrim(F.translate(x, "\t", " ")).startswith("#"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("heads", heads)
    cut = lambda a, b: F.array_join(F.slice("lines", a + 1, b - a), "")
    title = lambda x: F.nullif(F.regexp_replace(F.regexp_replace(x, r"^\s*#*", ""), r"^\s+|\s+$", ""), F.lit(""))
    section = lambda start, symbol, kind, content: F.struct((start + 1).cast("int").alias("start_line"), symbol.alias("symbol"), F.lit(kind).alias("kind"), content.alias("content"))
    none = F.lit(None).cast("string")
    first = F.coalesce(F.get("heads", F.lit(0)), F.size("lines"))
    before = F.filter(F.array(section(F.lit(0), none, "fallback", cut(F.lit(0), first))), lambda x: (F.size("heads") == 0) | ~x["content"].rlike(r"^\s*$"))
    found = F.transform("heads", lambda h, i: section(h, title(F.get(F.col("lines"), h)), "markdown_section", cut(h, F.coalesce(F.get(F.col("heads"), i + 1), F.size("lines")))))
    rows = rows.select("repository_id", "path", "language", F.explode(F.concat(before, found)).alias("x"))
    return rows.select("repository_id", "path", "language", "x.content", "x.start_line", "x.symbol", "x.kind", F.lit(False).alias("whole"))


def _blocks(source: str, limit: int) -> Iterator[tuple[int, int, str | None, str]]:
    """(first line, last line, symbol, kind) of a module's parts; raises SyntaxError."""
    body = ast.parse(source).body
    n = len(source.splitlines())
    begin = lambda node: min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
    size = lambda a, b: sum(map(len, source.splitlines(keepends=True)[a - 1 : b]))
    function = (ast.FunctionDef, ast.AsyncFunctionDef)
    free = set(range(1, n + 1))
    for node in body:
        a, b = begin(node), node.end_lineno
        free -= set(range(a, b + 1))
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            yield a, b, None, "import"
        elif isinstance(node, function):
            yield a, b, node.name, "function"
        elif isinstance(node, ast.ClassDef):
            methods = [] if size(a, b) <= limit else [m for m in node.body if isinstance(m, function)]
            at = a
            for m in methods:
                if at < begin(m):
                    yield at, begin(m) - 1, node.name, "class context"
                yield begin(m), m.end_lineno, f"{node.name}.{m.name}", "method"
                at = m.end_lineno + 1
            if at <= b:
                yield at, b, node.name, "class context" if methods else "class"
    # runs of lines outside every statement; statements of other kinds are in no chunk
    rest = sorted(free)
    for i, line in enumerate(rest):
        if not i or rest[i - 1] != line - 1:
            end = line
            while end + 1 in free:
                end += 1
            yield line, end, None, "module"


def python_sections(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Imports, functions, classes (large ones by method) and what lies between; a file that does not parse as text."""

    def parse(batches):
        for b in batches:
            rows = []
            for repository, path, language, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = content.splitlines(keepends=True)
                try:
                    found = list(_blocks(content, config.max_chars))
                except (SyntaxError, ValueError):
                    rows.append((repository, path, language, content, 1, None, "fallback", False))
                    continue
                for a, e, symbol, kind in found:
                    part = "".join(lines[a - 1 : e])
                    if part.strip() or kind not in ("module", "class context"):
                        rows.append((repository, path, language, part, a, symbol, kind.split()[0], False))
            names = [x.split()[0] for x in SECTION.split(", ")]
            kinds = [{"int": pa.int32(), "boolean": pa.bool_()}.get(x.split()[1], pa.string()) for x in SECTION.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.select("repository_id", "path", "language", "content").mapInArrow(parse, SECTION)


def chunk_files(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of all files (repository_id, path, language, content); a file without a language is chunked as text."""
    python = python_sections(files.where("language = 'Python'"), config)
    markdown = markdown_sections(files.where("language = 'Markdown'"))
    other = text_sections(files.where("coalesce(language, '') NOT IN ('Python', 'Markdown')"))
    return pieces(python.unionByName(markdown).unionByName(other), config)


def gaps(covered: DataFrame) -> DataFrame:
    """(file, start_line, end_line): runs of lines that are not covered, of rows (file, line, covered)."""
    from pyspark.sql import Window

    rows = covered.where("NOT covered").withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line")))
    return rows.groupBy("file", "run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("run")
