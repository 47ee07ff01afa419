"""Whole runs over stored tables: indexing a repository, search, answers, explanations and chat turns.

Tables lie under one root in layers (operators.snapshots): files, dead, points (chunks with vectors), postings, lengths,
repositories (their statistics); and registry, a row for each stage of each indexing. An indexing chunks, embeds and posts the
files that differ from the version before, writes them as a layer, and publishes all tables at once by one commit; the row of
a finished one comes last, so a signature is never stored without the tables it stands for. One that failed says so and
leaves the version before. Every `merge_after` layers a repository's live rows are written as one.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import ChunkConfig, ContextConfig, ConversationConfig, HybridConfig, IngestConfig, RerankConfig
from lodestone.functions import payload, providers, text
from lodestone.operators import chunking, context, conversation, fusion, lexical, lifecycle, moves, rerank, snapshots, store, vectors
from lodestone.sources import files as sources
from lodestone.sources.tables import stored

log = logging.getLogger(__name__)

#: What callers see of a failure; the log has the rest.
FAILED = "Indexing failed; the log says why."

REGISTRY = (
    "repository_id string, repository_url string, repository_name string, status string, stage string, progress_percent int, file_count long, "
    "total_size_bytes long, languages array<string>, content_signature string, error string, version long, recorded long"
)


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    root: str
    embedder: providers.Embedder = field(default_factory=providers.hashing_embedder)
    scorer: Callable[[Column, Column], Column] = rerank.overlap
    generator: Callable[[Column], Column] = lambda prompt: F.when(prompt.isNotNull(), F.lit("The most relevant source is [1]."))
    ingest: IngestConfig = IngestConfig()
    chunks: ChunkConfig = ChunkConfig()
    hybrid: HybridConfig = HybridConfig()
    reranking: RerankConfig = RerankConfig()
    packing: ContextConfig = ContextConfig()
    talking: ConversationConfig = ConversationConfig()
    #: An indexing is tried so many times again, after delays that double; a repository has so many layers at most.
    retries: int = 2
    delay: float = 0.25
    merge_after: int = 8

    @property
    def snapshots(self) -> snapshots.Snapshots:
        return snapshots.Snapshots(self.spark, f"{self.root}/index")

    def _table(self, name: str, view: snapshots.View | None = None) -> DataFrame:
        """The registry, or the live rows of an index table as of the last commit."""
        if name == "registry":
            return self.spark.read.parquet(f"{self.root}/registry")
        return (view or self.snapshots.view()).table(name).drop("index_part", "index_layer")

    def registry(self) -> DataFrame:
        """The latest record of each repository that is not deleted, by name."""
        return lifecycle.listed(lifecycle.latest(self._table("registry"), "repository_id", ("version", "recorded")).where("status <> 'deleted'"))

    def get(self, repository_id: str) -> Row | None:
        """A repository's latest record, if it has one and is not deleted."""
        return self.registry().where(F.col("repository_id") == repository_id).first() if store.exists(self.spark, f"{self.root}/registry") else None

    def lifecycles(self, silence_seconds: float) -> DataFrame:
        """The state of every repository that was ever recorded (moves.states), in which a stage that has reported nothing for
        longer than the silence has failed: what an indexing that was killed leaves."""
        rows = self._table("registry").select("repository_id", F.timestamp_micros(F.floor(F.col("recorded") / 1000)).alias("ts"), F.col("recorded").alias("seq"), F.when(F.col("status") == "deleted", "deleted").otherwise(F.col("stage")).alias("move"))
        return moves.states(rows, int(silence_seconds * 1_000_000), F.current_timestamp())

    def _record(self, id: str, url: str, name: str, version: int, stage: str, status: str = "indexing", row: Row | None = None, error: str | None = None, progress: int | None = None) -> None:
        summary = (row.file_count, row.total_size_bytes, row.languages, row.content_signature) if row else (None,) * 4
        progress = lifecycle.PROGRESS.get(stage, 0) if progress is None else progress
        done = [(id, url, name, status, stage, progress, *summary, error, version, time.time_ns())]
        self.spark.createDataFrame(done, REGISTRY).write.mode("append").parquet(f"{self.root}/registry")

    def index(self, files: DataFrame, url: str, name: str, version: int) -> str:
        """Indexes one repository's files (of sources.included; a VARIANT column `metadata` goes to their chunks) and gives its state: `unchanged` if its latest indexing
        finished with its signature, else `completed`. Every stage is recorded; a failure is recorded with the state `failed`,
        the progress it came to and a general text, logged, and raised. Too many files or bytes are one, before any table is
        written. What follows is tried again after errors, but for values that cannot be right. Chunks are made once: what comes after reads them from the
        stored points."""
        id = self.spark.range(1).select(text.repository_id(F.lit(url)).alias("x")).first().x
        known, progress = self.get(id), 0
        self._record(id, url, name, version, "queued")
        try:
            files = files.withColumn("repository_id", F.lit(id))
            progress = lifecycle.PROGRESS["ingesting"]
            self._record(id, url, name, version, "ingesting")
            row = sources.guarded(files, self.ingest).join(lifecycle.merkle_signatures(self._signed(files)), "repository_id").first()
            if row is None:
                raise ValueError("the repository has no files to index")
            same = known is not None and known.status == "ready" and known.content_signature == row.content_signature
            if not same:
                progress = lifecycle.PROGRESS["indexing"]
                self._record(id, url, name, version, "indexing", row=row)
                providers.with_retry(lambda: self._index(files, id), self.retries, self.delay, again=lambda e: not isinstance(e, ValueError))()
            self._record(id, url, name, version, "completed", "ready", row)
            return "unchanged" if same else "completed"
        except Exception:
            log.exception("indexing of %s failed", id)
            self._record(id, url, name, version, "failed", "failed", error=FAILED, progress=progress)
            raise

    @staticmethod
    def _signed(files: DataFrame) -> DataFrame:
        """Files whose contents stand for their metadata too."""
        if payload.NAME not in files.columns:
            return files
        return files.withColumn("content", F.concat("content", F.coalesce(F.concat(F.lit("\0"), F.to_json(payload.NAME)), F.lit(""))))

    def _index(self, files: DataFrame, id: str) -> None:
        """Publishes the repository's files: a layer of those that differ from its last version, or one of all."""
        shots = self.snapshots
        view = shots.view()
        before = shots.layers(id)
        mine = F.col("repository_id") == id
        known = view.table("files", snapshots.FILES).where(F.col("index_part") == snapshots.part_of(id)).where(mine)
        changed, dead = snapshots.difference(files, known)
        changed, dead = stored(changed, "engine-changed"), stored(dead, "engine-dead")
        if before and not changed.limit(1).count() and not dead.limit(1).count():
            return
        made = chunking.chunk_files(changed.drop("digest", payload.NAME), self.chunks).withColumn("vector", providers.embed(F.col("content"), self.embedder))
        if payload.NAME in changed.columns:
            made = made.join(changed.select("repository_id", F.col("path").alias("file_path"), payload.NAME), ["repository_id", "file_path"])
        else:
            made = made.withColumn(payload.NAME, F.lit(None).cast("variant"))
        rows = stored(vectors.prepared(store.points(made)).dropDuplicates(["point_id"]), "engine-points")
        size = None
        if rows.limit(1).count():
            size = store.checked(rows).select(F.size("vector").alias("x")).first().x
            others = shots.live(view.commit).where((F.col("repository_id") != id) & F.col("dimension").isNotNull()).select("dimension").first()
            if before and others is None:
                others = shots.live(view.commit).where(mine & F.col("dimension").isNotNull()).select("dimension").first()
            if others is not None and others.dimension != size:
                raise ValueError(f"vectors have {size} dimensions, those of the table {others.dimension}")
        elif before:
            size = shots.live(view.commit).where(mine).select("dimension").first().dimension
        index = lexical.build_index(rows)
        layer = shots.new_layer()
        lengths = index.lengths
        if before:
            old = self._table("lengths", view).where(mine).join(dead.select("file_path").distinct(), "file_path", "left_anti")
            lengths = old.select(*[c for c in index.lengths.columns if c in old.columns]).unionByName(index.lengths, allowMissingColumns=True)
        tables = {
            "files": changed.select(F.lit(id).alias("repository_id"), F.col("path").alias("file_path"), "digest"),
            "dead": dead.select("repository_id", "file_path", "dead_layer"),
            "points": rows,
            "postings": index.postings,
            "lengths": index.lengths,
            "repositories": lexical.statistics(lengths),
        }
        for table, part in tables.items():
            shots.write(part, table, id, layer)
        shots.commit(id, [*before, layer], before, size)
        if len(before) + 1 >= self.merge_after:
            self.compact(id)

    def compact(self, repository_id: str) -> None:
        """Writes a repository's live rows as one layer and publishes it; nothing is chunked or embedded again."""
        shots = self.snapshots
        view, before = shots.view(), shots.layers(repository_id)
        if len(before) < 2:
            return
        layer, part = shots.new_layer(), snapshots.part_of(repository_id)
        for table in ("files", "points", "postings", "lengths", "repositories"):
            shots.write(view.table(table).where(F.col("index_part") == part).drop("index_part", "index_layer"), table, repository_id, layer)
        size = shots.live(view.commit).where(F.col("repository_id") == repository_id).first().dimension
        shots.commit(repository_id, [layer], before, size)

    def delete(self, repository_id: str, version: int) -> bool:
        """Commits that a repository has no rows, and records it; whether it was there. `snapshots.collect` frees the space."""
        record, layers = self.get(repository_id), self.snapshots.layers(repository_id)
        if layers:
            self.snapshots.commit(repository_id, [], layers)
        if record is not None:
            self._record(repository_id, record.repository_url, record.repository_name, version, "deleted", "deleted")
        return bool(layers) or record is not None

    def lexical_index(self, view: snapshots.View | None = None) -> lexical.LexicalIndex:
        """The stored index; document frequencies are counted at each search, of the terms asked for only."""
        postings = self._table("postings", view)
        terms = postings.groupBy("repository_id", "term").agg(F.count(F.lit(1)).alias("df"))
        return lexical.LexicalIndex(postings, self._table("lengths", view), terms, self._table("repositories", view))

    def search(self, queries: DataFrame, top_k: int | None = None, file_path: str | None = None, symbol: str | None = None, language: str | None = None, threshold: float | None = None, commit: int | None = None, metadata: dict[str, object] | None = None) -> DataFrame:
        """Reranked hybrid results with their chunks, for queries (query_id, repository_id, text); empty filters are none.
        `metadata` filters by keys of the files' metadata, in both legs. All
        tables are read as of one commit, the last by default."""
        view = self.snapshots.view(commit)
        filters = dict(metadata or {}) | {k: v for k, v in (("file_path", file_path), ("symbol_name", symbol), ("language", language)) if v}
        asked = queries.withColumn("vector", providers.embed(F.col("text"), self.embedder))
        points = self._table("points", view)
        found = fusion.retrieve(points, self.lexical_index(view), asked, self.hybrid, self.reranking.candidates, threshold, filters or None)
        found = found.join(queries.select("query_id", "repository_id", F.col("text").alias("question")), "query_id")
        columns = ["repository_id", "chunk_id", "file_path", "start_line", "end_line", "symbol_name", "language", "content"]
        return rerank.rerank(found.join(points.select(*columns), ["repository_id", "chunk_id"]), self.scorer, self.reranking, top_k)

    def answer(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        questions = queries.select("query_id", F.col("text").alias("question"))
        return context.answer(questions, context.pack(self.search(queries, top_k), self.packing), self.generator)

    def explain_file(self, repository_id: str, path: str) -> DataFrame:
        """An answer about one file from all its chunks in order."""
        rows = store.get_file(self._table("points"), repository_id, path)
        rank = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "chunk_id"))
        results = rows.withColumn("query_id", F.lit(1)).withColumn("rank", rank)
        questions = self.spark.createDataFrame([(1, f"Explain the file {path}.")], "query_id int, question string")
        return context.answer(questions, context.pack(results, self.packing), self.generator)

    def chat(self, history: DataFrame, turns: DataFrame, rewriter: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
        """Answers for turns (query_id, repository_id, conversation_id, message), one a conversation, and the messages
        retained with the turns appended. A turn without a conversation_id begins one of its own. Follow-ups are rewritten first; the history keeps what was said."""
        turns = stored(turns.withColumn("conversation_id", F.coalesce("conversation_id", F.expr("uuid()"))), "engine-turns")
        last = history.groupBy("repository_id", "conversation_id").agg(F.max("seq").alias("last"))
        now = turns.join(last, ["repository_id", "conversation_id"], "left").select("repository_id", "conversation_id", (F.coalesce("last", F.lit(0).cast("long")) + 1).alias("seq"), F.lit("user").alias("role"), F.col("message").alias("content"), "query_id")
        everything = history.withColumn("query_id", F.lit(None).cast(turns.schema["query_id"].dataType)).select(now.columns).unionByName(now)
        asked = conversation.standalone(conversation.with_history(everything, self.talking).where("query_id IS NOT NULL"), rewriter or (lambda p: F.lit(None).cast("string")))
        answers = self.answer(asked.select("query_id", "repository_id", F.col("query").alias("text")))
        said = turns.join(answers.select("query_id", "answer"), "query_id").select("repository_id", "conversation_id", "message", "answer")
        return answers, conversation.appended(history, said, self.talking)
