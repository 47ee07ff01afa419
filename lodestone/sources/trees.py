"""Repository trees as a data source, for file systems that driver and executors mount (others: files.read_tree).

Folders are the partitions, splits * shares at most. The driver opens folders level by level only until there are `splits` of
them; what lies below is walked by the tasks, `shares` of them a folder, so that one folder with most files is several tasks' work. Ignored folders are never opened, and files that are ignored, in no known language, too large, linked from
outside of the root or excluded by a pushed filter are never read. Filters on repository_id, path and size_bytes are
pushed where spark.sql.python.filterPushdown.enabled is set; elsewhere Spark applies them after the scan, and the options
`max_file_bytes` and `prefix` do the same without it.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lodestone.config import IngestConfig
from lodestone.functions import paths

NAME = "repository_tree"
SCHEMA = "repository_id string, path string, content binary, size_bytes long"
#: Folders that are dealt to tasks, at least where there are so many; tasks that share a folder; bytes of a batch, about.
SPLITS, SHARES, BATCH = 64, 4, 16 << 20

_name = re.compile(paths.IGNORED_NAME)
_suffix = re.compile(paths.SUFFIX)


def wanted(path: str) -> bool:
    """Whether paths.ignored_path and paths.language let a file be read; the same rules for a string."""
    *parents, name = path.split("/")
    name = name.lower()
    suffix = _suffix.search(name)
    return not any(p in paths.IGNORED_DIRECTORIES for p in parents) and not _name.search(name) and bool(suffix) and suffix[1] in paths.LANGUAGE_BY_SUFFIX


def mounted(root: str) -> str:
    """The place of a folder given as a path or a file: address; any other scheme is an error."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", root):
        return root
    if not root.startswith("file:"):
        raise ValueError(f"{root} is on no mounted file system")
    return "/" + root[5:].lstrip("/")


@dataclass
class Folder:
    """Files of a folder, relative to the root: those in it, or with `deep` below it too; of these one share by path."""

    folder: str
    deep: bool
    share: int
    shares: int


@dataclass
class Folders(ds.InputPartition):
    """What one task reads."""

    folders: list[Folder]


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        root = options.get("path")
        if not root:
            raise ValueError("the option path must name the root of the trees")
        self.root = os.path.realpath(mounted(root))
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"{root} is no folder")
        self.repository = options.get("repository_id")
        self.largest = int(options.get("max_file_bytes", IngestConfig().max_file_bytes))
        self.splits, self.shares = int(options.get("splits", SPLITS)), int(options.get("shares", SHARES))
        if self.splits < 1 or self.shares < 1:
            raise ValueError("splits and shares must be at least 1")
        self.tests: list[ds.Filter] = []
        self.prefixes = [options["prefix"]] if options.get("prefix") else []

    def _named(self, relative: str) -> tuple[str, str]:
        """Repository and path of something below the root; without a given repository the first folder is it."""
        if self.repository is not None:
            return self.repository, relative
        first, _, rest = relative.partition("/")
        return first, rest

    def _enters(self, folder: str) -> bool:
        """Whether files that are asked for can lie in or below a folder."""
        repository, path = self._named(folder)
        if path and path.rsplit("/", 1)[-1] in paths.IGNORED_DIRECTORIES:
            return False
        inner = path + "/" if path else ""
        if not all(p.startswith(inner) or inner.startswith(p) for p in self.prefixes):
            return False
        return not repository or all(TESTS[type(f)](repository, f) for f in self.tests if f.attribute == ("repository_id",))

    def _open(self, folder: str) -> tuple[list[str], list[str]]:
        """The folders in a folder that are entered, links not among them, and its files' paths, all relative to the root."""
        folders, files = [], []
        with os.scandir(os.path.join(self.root, folder)) as found:
            for e in found:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if self._enters(path):
                        folders.append(path)
                elif e.is_file():
                    files.append(path)
        return folders, files

    def partitions(self):
        out, level = [], [""]
        while level and len(level) < self.splits:
            below = []
            for folder in level:
                folders, files = self._open(folder)
                below += folders
                shares = min(self.shares, len(files))
                out += [Folder(folder, False, i, shares) for i in range(shares)]
            level = below
        most = self.splits * self.shares
        shares = self.shares if len(level) < most else 1
        out += [Folder(folder, True, i, shares) for folder in level for i in range(shares)]
        return [Folders(out[i::most]) for i in range(min(most, len(out)))] or [Folders([])]

    def _files(self, part: Folder) -> Iterator[tuple[str, str, str, int]]:
        """(repository, path, real place, size) of a partition's files that are read."""
        stack = [part.folder]
        while stack:
            folders, files = self._open(stack.pop())
            stack += folders if part.deep else []
            for file in files:
                repository, path = self._named(file)
                if zlib.crc32(file.encode("utf-8", "surrogateescape")) % part.shares != part.share or not path or not wanted(path):
                    continue
                place = os.path.realpath(os.path.join(self.root, file))
                if os.path.commonpath([place, self.root]) != self.root:  # a link out of the root
                    continue
                try:
                    size = os.stat(place).st_size
                except FileNotFoundError:  # gone since the folder was opened
                    continue
                value = {"repository_id": repository, "path": path, "size_bytes": size}
                if size <= self.largest and all(path.startswith(p) for p in self.prefixes) and all(TESTS[type(f)](value[f.attribute[0]], f) for f in self.tests):
                    yield repository, path, place, size

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for repository, path, place, _ in itertools.chain.from_iterable(map(self._files, partition.folders)):
            try:
                with open(place, "rb") as f:
                    content = f.read()
            except FileNotFoundError:
                continue
            rows.append((repository, path, content, len(content)))
            held += len(content)
            if held >= BATCH or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


class PushedReader(TreeReader):
    """The reader where the session lets Python data sources take filters; elsewhere Spark refuses one that would."""

    def pushFilters(self, filters):
        for f in filters:
            known = getattr(f, "attribute", None) in {("repository_id",), ("path",), ("size_bytes",)}
            if not known or type(f) not in TESTS:
                yield f
                continue
            self.tests.append(f)
            if f.attribute == ("path",) and isinstance(f, (ds.StringStartsWith, ds.EqualTo)):
                self.prefixes.append(f.value)


def _batch(rows: list[tuple[str, str, bytes, int]]) -> pa.RecordBatch:
    # names that are not UTF-8 are read with replacement characters
    text = lambda x: x.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    repository, path, content, size = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"repository_id": pa.array(map(text, repository), pa.string()), "path": pa.array(map(text, path), pa.string()), "content": pa.array(content, pa.binary()), "size_bytes": pa.array(size, pa.int64())})


#: The filters that are pushed, as tests of a value that is never null.
TESTS = {
    ds.IsNotNull: lambda x, f: True,
    ds.EqualTo: lambda x, f: x == f.value,
    ds.In: lambda x, f: x in f.value,
    ds.LessThan: lambda x, f: x < f.value,
    ds.LessThanOrEqual: lambda x, f: x <= f.value,
    ds.GreaterThan: lambda x, f: x > f.value,
    ds.GreaterThanOrEqual: lambda x, f: x >= f.value,
    ds.StringStartsWith: lambda x, f: x.startswith(f.value),
    ds.StringEndsWith: lambda x, f: x.endswith(f.value),
    ds.StringContains: lambda x, f: f.value in x,
}


class RepositoryTree(ds.DataSource):
    """Options: path (the root), repository_id (else each folder of the root is a repository), max_file_bytes, prefix, splits,
    shares, and pushdown, whether the session lets filters be pushed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushdown") == "true" else TreeReader)(options)


def read_repositories(spark: SparkSession, root: str, repository_id: str | None = None, **options: object) -> DataFrame:
    """(repository_id, path, content, size_bytes) of the files of one repository, or of one in each folder of root: those that
    `files.included` keeps by path, language and size, and it takes these rows for the rest. An empty root gives no rows; a
    missing one is an error; links to folders are not followed, as are links to files out of the root."""
    spark.dataSource.register(RepositoryTree)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    given = {"pushdown": pushdown} | {k: v for k, v in {"repository_id": repository_id, **options}.items() if v is not None}
    return spark.read.format(NAME).options(**given).load(root)


def write_repositories(rows: DataFrame, root: str) -> int:
    """Writes rows (repository_id, path, content) as files root/repository_id/path by the tasks that hold them, and gives their
    number. Null contents are empty files; a repository or path that would leave its folder is an error. A file is renamed into place when it
    is whole, so a task that runs again changes nothing; of rows that share a path one stays."""
    place = mounted(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for repository, path, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                parts = [repository or "", *(path or "").split("/")]
                if any(p in ("", ".", "..") or "\0" in p for p in parts) or "/" in parts[0]:
                    raise ValueError(f"{repository}/{path} is no path below a repository")
                file = os.path.join(place, *parts)
                os.makedirs(os.path.dirname(file), exist_ok=True)
                part = os.path.join(os.path.dirname(file), f".{uuid.uuid4().hex}.part")
                with open(part, "wb") as f:
                    f.write(content or b"")
                os.replace(part, file)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    done = rows.select("repository_id", "path", F.col("content").cast("binary")).mapInArrow(write, "n long")
    os.makedirs(place, exist_ok=True)
    return done.agg(F.sum("n")).first()[0] or 0
