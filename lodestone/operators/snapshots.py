"""Index tables in versions that appear all at once: layers, a manifest of commits, pinned views, compaction, collection.

A repository's index is a list of layers. Each layer is a folder in each table, `root/table/index_part=../index_layer=..`, written once,
by a job of its own, and never changed. A commit is one small file of the manifest, created exclusively, that names the layers a
repository has from then on; before it no reader sees a new layer, after it every reader sees those of all tables. So a job
that is killed anywhere leaves the old version in place, and nothing is deleted before a write.

A delta layer holds what is new of changed files, and in the table `dead` the files of older layers that it changes or
removes: a view drops those rows by an anti join with that table, which is empty for repositories of one layer. `compacted` writes
a repository's live rows as one layer. `collect` deletes layers that no commit still kept names.

The part of a repository is a digest of its id, so an id can hold any characters and never names a path.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.sources.tables import stored

MANIFEST = "commit long, repository_id string, index_part string, layers array<string>, dimension int, recorded long"
#: Columns of the files of a layer, and of the older files that it changes or removes.
FILES = "repository_id string, file_path string, digest string"
DEAD = "repository_id string, file_path string, dead_layer string"
#: Tables whose rows belong to files, with the column by which `dead` finds them.
OF_FILES = ("files", "points", "lengths")


class Conflict(Exception):
    """Another commit changed the repository in the meantime."""


def part_of(repository_id: str) -> str:
    if not repository_id:
        raise ValueError("a repository needs an id")
    return "p" + hashlib.sha256(repository_id.encode()).hexdigest()[:32]


def part_column(repository_id: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(repository_id, 256), 1, 32))


@dataclass(frozen=True)
class Snapshots:
    spark: SparkSession
    root: str

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The number of the last commit, 0 before the first."""
        fs, path = self._files(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self) -> DataFrame:
        """All commits that are still kept (MANIFEST); a file whose writer was killed is no commit."""
        if not self._files().exists(self._path("manifest")):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(f"{self.root}/manifest").where("commit IS NOT NULL")

    def live(self, commit: int | None = None) -> DataFrame:
        """The last row of each repository's commits up to `commit`, of repositories that then have layers."""
        rows = self.manifest() if commit is None else self.manifest().where(F.col("commit") <= commit)
        last = rows.groupBy("repository_id").agg(F.max_by(F.struct(*[c.split()[0] for c in MANIFEST.split(", ")]), "commit").alias("x")).select("x.*")
        return last.where(F.size("layers") > 0)

    def layers(self, repository_id: str) -> list[str]:
        row = self.live().where(F.col("repository_id") == repository_id).first()
        return list(row["layers"]) if row else []

    def commit(self, repository_id: str, layers: list[str], expected: list[str], dimension: int | None = None) -> int:
        """Makes `layers` those of the repository, if they still are `expected`; the number of the commit."""
        while True:
            n = self.latest() + 1
            if self.layers(repository_id) != expected:
                raise Conflict(f"{repository_id} was changed by another commit")
            row = {"commit": n, "repository_id": repository_id, "index_part": part_of(repository_id), "layers": layers, "dimension": dimension, "recorded": time.time_ns()}
            if self._create(f"{n:012d}.json", [row]):
                return n

    def _create(self, name: str, rows: list[dict]) -> bool:
        """Whether a manifest file could be created; False if another writer has its name."""
        path = self._path("manifest", name)
        try:
            out = self._files().create(path, False)
        except Exception as e:
            if "exist" in str(e):
                return False
            raise
        out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
        out.close()
        return True

    def write(self, rows: DataFrame, table: str, repository_id: str, layer: str) -> None:
        rows.write.parquet(f"{self.root}/{table}/index_part={part_of(repository_id)}/index_layer={layer}")

    def new_layer(self) -> str:
        return "l" + uuid.uuid4().hex

    def view(self, commit: int | None = None) -> View:
        """What readers see: the tables as of a commit, the last one by default, whatever is committed later."""
        return View(self, self.latest() if commit is None else commit)

    def collect(self, keep: int = 1, grace_seconds: float = 86_400.0) -> int:
        """Deletes layers that none of the last `keep` versions of the manifest names, and the commits before those; layers
        of no commit at all, a killed or a running writer's, only when they are older than the grace. Views pinned to earlier
        commits end with this. How many layer folders went."""
        fs, last = self._files(), self.latest()
        first = max(last - keep + 1, 0)
        rows = self.manifest()
        kept = self.live(first).unionByName(rows.where(F.col("commit") > first))
        held = {(r.index_part, x) for r in kept.select("index_part", "layers").toLocalIterator() for x in r["layers"]}
        named = {(r.index_part, x) for r in rows.select("index_part", "layers").toLocalIterator() for x in r["layers"]}
        gone = 0
        for s in fs.globStatus(self._path("*", "index_part=*", "index_layer=*")) or []:
            part, layer = (p.getName().split("=")[1] for p in (s.getPath().getParent(), s.getPath()))
            young = time.time() * 1000 - s.getModificationTime() < grace_seconds * 1000
            if (part, layer) not in held and ((part, layer) in named or not young):
                gone += fs.delete(s.getPath(), True)
        # the state at the first version kept takes the place of the commits up to it
        base = f"{first:012d}.base-{last}.json"
        if first and self._create(base, [r.asDict() for r in self.live(first).toLocalIterator()]):
            for s in fs.listStatus(self._path("manifest")):
                name = s.getPath().getName()
                if name.endswith(".json") and name != base and int(name.split(".")[0]) <= first:
                    fs.delete(s.getPath(), False)
        return gone


class View:
    """The tables of all repositories as of one commit. Its layers are read from the manifest once, into a table."""

    def __init__(self, of: Snapshots, commit: int):
        self.of, self.commit = of, commit
        rows = of.live(commit).select("index_part", F.posexplode("layers").alias("ordinal", "index_layer"), (F.size("layers") - 1).alias("last"))
        self._layers = stored(rows, "snapshot-layers")
        #: Whether any repository has layers over others; without, no row is dead.
        self.layered = self._layers.where("last > 0").limit(1).count() > 0

    def exists(self, table: str) -> bool:
        return self.of._files().exists(self.of._path(table))

    def _rows(self, table: str, schema: str | None = None) -> DataFrame:
        """All rows of a table's live layers, with part, layer, and the layer's place among the repository's."""
        spark = self.of.spark
        if not self.exists(table):
            return spark.createDataFrame([], StructType.fromDDL(schema or FILES)).withColumns({"index_part": F.lit(""), "index_layer": F.lit(""), "ordinal": F.lit(0), "last": F.lit(0)})
        path = f"{self.of.root}/{table}"
        # names of parts and layers begin with a letter: they are never taken for numbers
        known = StructType.fromDDL(schema) if schema else StructType([f for f in spark.read.parquet(path).schema if f.name not in ("index_part", "index_layer")])
        full = StructType([*known, StructField("index_part", StringType()), StructField("index_layer", StringType())])
        return spark.read.schema(full).parquet(path).join(self._layers, ["index_part", "index_layer"])

    def _dead(self) -> DataFrame:
        return self._rows("dead", DEAD).select("index_part", F.col("dead_layer").alias("index_layer"), "file_path").distinct()

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """The live rows of a table, with their layer's part and name: of `repositories` the last layer's, of tables of
        files those of files that no later layer changes or removes, of postings those of such files' chunks."""
        rows = self._rows(name, schema)
        if name == "repositories":
            rows = rows.where("ordinal = last")
        elif name in OF_FILES and self.layered:
            rows = rows.join(self._dead(), ["index_part", "index_layer", "file_path"], "left_anti")
        elif name == "postings" and self.layered:
            gone = self._rows("lengths").join(self._dead(), ["index_part", "index_layer", "file_path"], "left_semi").select("index_part", "index_layer", "chunk_id")
            rows = rows.join(gone, ["index_part", "index_layer", "chunk_id"], "left_anti")
        return rows.drop("ordinal", "last")


def difference(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new or changed files of (repository_id, path, content, language, ...) with their digest, (repository_id, file_path,
    dead_layer) of known files (repository_id, file_path, digest, index_layer) that they change, or that are gone). Files are
    compared by a digest of language, content and metadata, if they have such; one shuffle by repository and path, in which no contents meet."""
    new = files.withColumn("digest", file_digest(F.col("content"), F.col("language"), F.col("metadata") if "metadata" in files.columns else None))
    old = known.select("repository_id", F.col("file_path").alias("path"), F.col("digest").alias("old"), "index_layer")
    both = new.select("repository_id", "path", "digest").join(old, ["repository_id", "path"], "full_outer")
    same = F.col("digest").eqNullSafe(F.col("old"))
    names = both.where("digest IS NOT NULL").where(~same).select("repository_id", "path")
    dead = both.where("old IS NOT NULL").where(~same).select("repository_id", F.col("path").alias("file_path"), F.col("index_layer").alias("dead_layer"))
    return new.join(names, ["repository_id", "path"], "left_semi"), dead


def file_digest(content: Column, language: Column, metadata: Column | None = None) -> Column:
    more = F.lit("") if metadata is None else F.coalesce(F.concat(F.lit("\0"), F.to_json(metadata)), F.lit(""))
    return F.sha2(F.concat(F.coalesce(language, F.lit("")), F.lit("\0"), F.coalesce(content, F.lit("")), more), 256)
