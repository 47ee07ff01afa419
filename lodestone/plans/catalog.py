"""Registered queries over the given tables, and the SQL that must give the same rows.

Documents stand for files and chunks: their source is the repository, doc_id the path and chunk id, lang the language.
Embeddings are vector points of repository `all`, benchmark rows are questions, labels give relevance, conversations are
histories and Markdown transcripts, events are registry records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ChunkConfig, ContextConfig, ConversationConfig, HybridConfig, IngestConfig, RerankConfig
from lodestone.functions import paths, payload, providers, text
from lodestone.operators import chunking, context, conversation, evaluation, fusion, impact, ivf, lexical, lifecycle, moves, rerank, snapshots, store, vectors
from lodestone.plans import sql
from lodestone.sources import files as sources
from lodestone.sources import trees
from lodestone.sources.tables import shared_path, spread, stored

FLAGSHIP = "hybrid_retrieve"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = dict(sql.ORACLE)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: To which the queries below round the scores of both legs, and fused ones, before they rank: so sums in another order, as
#: the SQL's, rank alike.
DIGITS, FUSED_DIGITS = 6, 9


def search_words(*args, **kw) -> DataFrame:
    return lexical.search(*args, digits=DIGITS, **kw)


def search_vectors(*args, **kw) -> DataFrame:
    return vectors.search(*args, digits=DIGITS, **kw)


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def made_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of every shape, made of the ids of parts."""
    k = F.col("p_partkey")
    shapes = ["src/app/file%d.py", "node_modules/x%d/index.js", "build/file%d.ts", "lib/.env", "web/app%d.min.js", "web/style%d.css.map", "docs/page%d.MD", "a/./b//file%d.go", "../up%d.rs", "./here%d.c", "src\\win%d.cpp", "/abs%d.java", "x/.env.local%d", "gen/api.generated.%d.ts", "vendor%d/file.html", "LICENSE%d", "x/vendor/file%d.sql", ".py", ""]
    shape = F.element_at(F.array(*map(F.lit, shapes)), (F.pmod(k, F.lit(len(shapes))) + 1).cast("int"))
    return read(spark, d, "part").select(k.cast("long").alias("id"), F.replace(shape, F.lit("%d"), k.cast("string")).alias("path"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents")).select(F.col("source").alias("repository_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as chunks."""
    rows = read(spark, d, "documents")
    name = F.col("doc_id").cast("string")
    return rows.select(F.col("source").alias("repository_id"), name.alias("chunk_id"), F.concat(F.lit("docs/"), name, F.lit(".md")).alias("file_path"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("symbol_name"), F.lit("fallback").alias("chunk_type"), F.col("text").alias("content"), F.lit(1).alias("start_line"), text.line_count(F.col("text")).alias("end_line"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text asked of one of the twenty sources."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)).cast("string")).alias("repository_id"), "text")


def points(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select(F.lit("all").alias("repository_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return vectors.prepared(rows)


def vector_questions(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings whose id is divisible by 20 as queries."""
    return read(spark, d, "embeddings").where(F.pmod("vec_id", F.lit(20)) == 0).select(F.col("vec_id").alias("query_id"), F.lit("all").alias("repository_id"), F.col("embedding").alias("vector"))


def document_points(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have an embedding, as points of their sources."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    rows = read(spark, d, "documents").join(v, "doc_id").select(F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("chunk_id"), "vector")
    return vectors.prepared(rows)


def hybrid_questions(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return questions(spark, d).join(v, "query_id")


RESULT = ["query_id", "chunk_id", "score"]


# --- ingestion


@query
def url_parse(spark, d):
    url = F.regexp_replace("url", "^http:", "https:")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    rows = read(spark, d, "pages").select(F.col("page_id"), F.explode(F.array(F.col("url"), F.concat(F.lit("https://GitHub.com/o"), F.col("page_id").cast("string"), F.lit("/"), F.translate(host, ".", "-"), F.lit(".git/")), F.concat(F.lit("https://github.com/one"), F.col("page_id").cast("string")), F.concat(F.lit(" https://github.com/o"), F.col("page_id").cast("string"), F.lit("/r?# ")), F.concat(url, F.lit("#x")))).alias("url"))
    x = paths.repository_address(F.col("url"))
    return rows.select("page_id", "url", x["canonical_url"].alias("canonical_url"), x["name"].alias("name"))


@query
def path_filter(spark, d):
    return made_paths(spark, d).select("id", "path", paths.ignored_path(F.col("path")).alias("ignored"))


@query
def language_detect(spark, d):
    return made_paths(spark, d).select("id", "path", paths.language(F.col("path")).alias("language"))


@query
def path_validate(spark, d):
    return made_paths(spark, d).select("id", "path", paths.indexed_path(F.col("path")).alias("normal"))


@query
def size_binary_filter(spark, d):
    nul = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.col("text"), F.lit("\0"))).otherwise(F.col("text"))
    rows = read(spark, d, "documents").select("doc_id", nul.cast("binary").alias("content"))
    kept = rows.where((F.octet_length("content") <= 4000) & (F.position(F.lit(b"\x00"), F.col("content")) == 0))
    return kept.select("doc_id", F.octet_length("content").cast("long").alias("size_bytes"))


@query
def ingest_summary(spark, d):
    rows = sources.guarded(files(spark, d), sources.IngestConfig(max_files=10**9, max_repository_bytes=10**15))
    return rows.select("repository_id", *long("file_count", "total_size_bytes"), F.array_join("languages", ",").alias("languages"))


@query
def repository_tree(spark, d):
    """Every document as a file of a tree with ignored folders, unknown suffixes, binary and large files, read by the data source."""
    k = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".py", ".tar.gz", ".SQL"))), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    folder = F.when(F.pmod(k, F.lit(5)) == 0, "node_modules/x").otherwise(F.concat(F.lit("f"), F.pmod(k, F.lit(40)).cast("string")))
    nul = F.when(F.pmod(k, F.lit(7)) == 0, F.lit("\0")).otherwise(F.lit(""))
    rows = spread(read(spark, d, "documents")).select(F.col("source").alias("repository_id"), F.concat(folder, F.lit("/"), k.cast("string"), suffix).alias("path"), F.concat("text", nul).alias("content"))
    root = shared_path(spark, "tree")
    trees.write_repositories(rows, root)
    found = sources.included(trees.read_repositories(spark, root), IngestConfig(max_file_bytes=4000))
    return found.select("repository_id", "path", "language", *long("size_bytes", "line_count"), F.md5("content").alias("content_md5"))


@query
def line_count(spark, d):
    return read(spark, d, "documents").select("doc_id", text.line_count(F.col("text")).cast("long").alias("line_count"))


# --- chunking


def _chunk_rows(found: DataFrame) -> DataFrame:
    return found.select("file_path", *long("start_line", "end_line", "part", "parts"), "chunk_type", "symbol_name", F.length("content").cast("long").alias("n_chars"), "chunk_id")


@query
def chunk_fallback(spark, d):
    return _chunk_rows(chunking.pieces(chunking.text_sections(files(spark, d))))


@query
def chunk_small_overlap(spark, d):
    return _chunk_rows(chunking.pieces(chunking.text_sections(files(spark, d)), ChunkConfig(max_chars=200, overlap_lines=1)))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown, a heading for each turn."""
    turn = F.struct("turn", "role", "text")
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(F.lit("talks").alias("repository_id"), F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.lit("Markdown").alias("language"), F.when(F.pmod("conv_id", F.lit(2)) == 0, F.concat(F.lit("intro\n"), body)).otherwise(body).alias("content"))


@query
def chunk_markdown(spark, d):
    return _chunk_rows(chunking.pieces(chunking.markdown_sections(transcripts(spark, d)), ChunkConfig(max_chars=10**6)))


@query
def chunk_ids(spark, d):
    rows = chunks(spark, d)
    c = [F.col(x) for x in ("repository_id", "file_path", "start_line", "end_line", "symbol_name", "chunk_type", "content")]
    return rows.select(F.col("chunk_id").alias("doc_id"), text.chunk_id(*c).alias("chunk_id"))


@query
def chunk_python_ast(spark, d):
    body = F.concat(F.lit("import os\n\nLIMIT = 1\n# part "), F.col("p_name"), F.lit("\nclass C"), F.col("p_partkey").cast("string"), F.lit(":\n    def m(self):\n        return 1\n\ndef f():\n    pass\n"))
    made = read(spark, d, "part").select(F.lit("parts").alias("repository_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.lit("Python").alias("language"), body.alias("content"))
    return _chunk_rows(chunking.pieces(chunking.python_sections(made)))


@query
def module_gaps(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_quantity") > 25).alias("covered"))
    return chunking.gaps(rows.distinct())


# --- index tables


@query
def tokenize_code(spark, d):
    name = F.concat(F.initcap("p_name"), F.lit(" getUserById JWT_SECRET __init__ user2Name 2abc HTTPServer "), F.translate(F.initcap("p_name"), " ", ""), F.lit(" "), F.translate("p_name", " ", "_"))
    return read(spark, d, "part").select("p_partkey", F.array_join(text.code_tokens(name), " ").alias("tokens"))


@query
def postings(spark, d):
    return lexical.build_index(chunks(spark, d)).postings.select("repository_id", "term", "chunk_id", *long("tf"))


@query
def term_stats(spark, d):
    return lexical.build_index(chunks(spark, d)).terms.select("repository_id", "term", *long("df"))


@query
def point_ids(spark, d):
    return read(spark, d, "embeddings").select("vec_id", text.point_id(F.col("vec_id").cast("string")).alias("point_id"))


@query
def payload_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


def _stored(spark, d):
    return chunks(spark, d).select("repository_id", "chunk_id", "content")


@query
def repo_replace(spark, d):
    old = _stored(spark, d)
    new = old.where((F.col("repository_id") == "src3") & (F.pmod(F.col("chunk_id").cast("long"), F.lit(2)) == 1)).withColumn("content", F.lit("new"))
    return store.replace_repository(old, new).select("repository_id", "chunk_id", text.content_hash(F.col("content")).alias("hash"))


@query
def repo_delete_status(spark, d):
    rows = _stored(spark, d)
    return store.status(store.delete_repository(rows, "src4"), rows.select("repository_id").distinct())


@query
def upsert_dedupe(spark, d):
    rows = read(spark, d, "embeddings").select(F.pmod("vec_id", F.lit(100)).alias("point_id"), F.col("vec_id").alias("version"), "label")
    half = F.pmod("version", F.lit(2)) == 0
    return store.upsert(rows.where(half), rows.where(~half))


def _pointed(spark, d):
    return chunks(spark, d).withColumn("point_id", text.point_id(F.col("chunk_id")))


@query
def list_files(spark, d):
    return store.list_files(_pointed(spark, d), "src5", None).select("file_path", "language", *long("chunk_count"))


@query
def list_files_truncated(spark, d):
    return store.list_files(_pointed(spark, d), "src0", 20).select("file_path", "language", *long("chunk_count"))


@query
def file_chunks(spark, d):
    return store.get_file(_pointed(spark, d), "src6", "docs//./6.md").select("chunk_id", "file_path", *long("start_line", "end_line"))


@query
def symbol_lookup(spark, d):
    rows = _pointed(spark, d).withColumn("symbol_name", F.concat(F.lit("s"), F.pmod(F.col("chunk_id").cast("long"), F.lit(3)).cast("string")))
    return store.get_symbol(rows, "src7", "s1").select("chunk_id", "symbol_name")


@query
def repo_id(spark, d):
    return read(spark, d, "pages").select("page_id", text.repository_id(F.col("url")).alias("repository_id"))


@query
def content_signature(spark, d):
    return lifecycle.exact_signatures(files(spark, d))


@query
def merkle_signature(spark, d):
    return lifecycle.merkle_signatures(files(spark, d))


@query
def lifecycle_states(spark, d):
    """Events as reports of moves: of each user's state, twelve hours of silence end a busy stage."""
    kinds = {"signup": "queued", "view": "ingesting", "click": "indexing", "purchase": "completed"}
    failed = F.when(F.pmod("event_id", F.lit(4)) == 0, "deleted").otherwise("failed")
    move = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], failed)
    rows = read(spark, d, "events").select(F.col("user_id").alias("repository_id"), "ts", F.col("event_id").alias("seq"), move.alias("move"))
    return moves.states(rows, 12 * 3_600_000_000)


@query
def unchanged_skip(spark, d):
    rows = files(spark, d)
    first = rows.where(F.col("repository_id").isin("src1", "src9")).groupBy("repository_id").agg(F.min("path").alias("first"))
    before = rows.join(first, "repository_id", "left").withColumn("content", F.when(F.col("path") == F.col("first"), F.lit("old")).otherwise(F.col("content")))
    return lifecycle.changed(lifecycle.exact_signatures(rows), lifecycle.exact_signatures(before)).select("repository_id")


@query
def registry_latest(spark, d):
    return lifecycle.latest(read(spark, d, "events"), "user_id").select("user_id", "event_id", "event_type")


# --- retrieval


@query
def bm25_topk(spark, d):
    return search_words(lexical.build_index(chunks(spark, d)), questions(spark, d), 10).select(*RESULT, *long("rank"))


@query
def bm25_filtered_stats_global(spark, d):
    return search_words(lexical.build_index(chunks(spark, d)), questions(spark, d), 10, {"language": "en"}).select(*RESULT, *long("rank"))


@query
def payload_filter_bm25(spark, d):
    """Chunks by a string and a boolean of their open metadata; document frequencies are of all chunks."""
    number = F.col("chunk_id").cast("long")
    held = F.to_json(F.struct(F.col("language").alias("tongue"), (F.pmod(number, F.lit(2)) == 0).alias("even")))
    rows = chunks(spark, d).withColumn("metadata", payload.payload(held)).drop("language")
    return search_words(lexical.build_index(rows), questions(spark, d), 10, {"tongue": "en", "even": True}).select(*RESULT, *long("rank"))


@query
def payload_filter_vector(spark, d):
    """Points by a whole number and a boolean of their open metadata."""
    held = F.to_json(F.struct(F.col("label").alias("kind of point"), (F.pmod(F.col("chunk_id").cast("long"), F.lit(2)) == 0).alias("even")))
    rows = points(spark, d).withColumn("metadata", payload.payload(held)).drop("label")
    return search_vectors(rows, vector_questions(spark, d), 10, filters={"kind of point": 1, "even": True}).select(*RESULT, *long("rank"))


@query
def bm25_impact_topk(spark, d):
    return impact.search(impact.build(chunks(spark, d)), questions(spark, d), 10, digits=DIGITS).select(*RESULT, *long("rank"))


@query
def bm25_multi_repo(spark, d):
    rows = questions(spark, d).select((F.col("query_id") * 20).alias("query_id"), "text", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    asked = rows.select((F.col("query_id") + F.col("k")).alias("query_id"), F.concat(F.lit("src"), F.col("k").cast("string")).alias("repository_id"), "text")
    return search_words(lexical.build_index(chunks(spark, d)), asked, 3).select(*RESULT, *long("rank"))


@query
def vector_topk(spark, d):
    return search_vectors(points(spark, d), vector_questions(spark, d), 10).select(*RESULT, *long("rank"))


@query
def vector_threshold_filter(spark, d):
    return search_vectors(points(spark, d), vector_questions(spark, d), 20, 0.1, {"label": 1}).select(*RESULT, *long("rank"))


@query
def vector_topk_batch(spark, d):
    return search_vectors(points(spark, d), vector_questions(spark, d), 5).select(*RESULT, *long("rank"))


@query
def vector_ivf_topk(spark, d):
    return ivf.search(ivf.build(points(spark, d)), vector_questions(spark, d), 5, digits=DIGITS).select(*RESULT, *long("rank"))


@query
def index_difference(spark, d):
    """What an index of the documents must take in after their numbers are masked: changed files, and those that go."""
    before = files(spark, d)
    known = before.select("repository_id", F.col("path").alias("file_path"), snapshots.file_digest(F.col("content"), F.col("language")).alias("digest"), F.lit("l1").alias("index_layer"))
    changed, dead = snapshots.difference(before.withColumn("content", F.regexp_replace("content", "[0-9]+", "#")), known)
    rows = changed.select("repository_id", F.col("path").alias("file_path"), "digest")
    return rows.join(dead, ["repository_id", "file_path"], "full_outer").select("repository_id", "file_path", "digest", "dead_layer")


def _legs(spark, d, pool: int = 20):
    asked = hybrid_questions(spark, d)
    return search_vectors(document_points(spark, d), asked, pool), search_words(lexical.build_index(chunks(spark, d)), asked, pool)


def _fused(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", "fused_score", *long("vector_rank", "bm25_rank", "rank"))


@query
def rrf_fusion(spark, d):
    return _fused(fusion.fuse(*_legs(spark, d), HybridConfig(), 10, FUSED_DIGITS))


@query
def rrf_weighted(spark, d):
    return _fused(fusion.fuse(*_legs(spark, d), HybridConfig(rrf_k=10, vector_weight=2.0), 10, FUSED_DIGITS))


@query
def hybrid_retrieve(spark, d):
    return _fused(fusion.retrieve(document_points(spark, d), lexical.build_index(chunks(spark, d)), hybrid_questions(spark, d), digits=(DIGITS, FUSED_DIGITS)))


def _candidates(spark, d, k: int = 20) -> DataFrame:
    """Lexical candidates with their question and content, as reranking and packing take them."""
    asked = questions(spark, d)
    found = stored(search_words(lexical.build_index(chunks(spark, d)), asked, k).withColumnRenamed("score", "fused_score"), "candidates")
    content = chunks(spark, d).drop("repository_id")
    return found.join(content, "chunk_id").join(asked.select("query_id", F.col("text").alias("question")), "query_id")


RERANKED = ["query_id", "chunk_id", "relevance_score", "fused_score"]


@query
def rerank_overlap(spark, d):
    return rerank.rerank(_candidates(spark, d)).select(*RERANKED, *long("prior_rank", "rank"))


@query
def rerank_fail_open(spark, d):
    fails = lambda q, c: F.struct(F.lit(0.5).alias("score"), (F.pmod(F.length(c), F.lit(5)) != 0).alias("ok"))
    return rerank.rerank(_candidates(spark, d), fails).select(*RERANKED, *long("prior_rank", "rank"))


@query
def reranked_candidate_cap(spark, d):
    return rerank.rerank(_candidates(spark, d, 30), config=RerankConfig(), final=50).select(*RERANKED, *long("prior_rank", "rank"))


# --- answers


@query
def context_pack(spark, d):
    rows = context.pack(_candidates(spark, d, 12), ContextConfig(max_chars=6000))
    return rows.select("query_id", *long("used_chunk_count", "context_char_count"), F.sha2("content", 256).alias("content_hash"), F.array_join(F.transform("citations", lambda c: c["chunk_id"]), ",").alias("chunk_ids"))


@query
def prompt_build(spark, d):
    rows = context.pack(_candidates(spark, d, 3)).join(questions(spark, d), "query_id")
    return rows.select("query_id", F.sha2(context.prompt(F.col("text"), F.col("content")), 256).alias("prompt_hash"))


def _answers(spark, d) -> DataFrame:
    rows = context.pack(_candidates(spark, d, 4))
    made = F.concat(F.lit("See [2] and [99], then [1]; [[9]1] [01] [2]. "), F.col("query_id").cast("string"))
    return context.validated(rows.withColumn("answer", made))


@query
def citation_validate(spark, d):
    return _answers(spark, d).select("query_id", "answer", F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("source_ids"))


@query
def answer_insufficient(spark, d):
    asked = questions(spark, d)
    few = _candidates(spark, d, 2).where(F.pmod("query_id", F.lit(2)) == 0)
    say = lambda prompt: F.concat(F.lit("[1] "), F.length(prompt).cast("string"))
    rows = context.answer(asked.select("query_id", F.col("text").alias("question")), context.pack(few), say)
    return rows.select("query_id", "answer", *long("used_chunk_count"), F.size("sources").cast("long").alias("n_sources"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.lit("r").alias("repository_id"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


@query
def history_last_n(spark, d):
    return conversation.retained(messages(spark, d), ConversationConfig(history=3)).select("conversation_id", "seq", "role")


@query
def rewrite_window_prompt(spark, d):
    rows = conversation.with_history(messages(spark, d)).where(F.size("history") > 0)
    return rows.select("conversation_id", "seq", F.size("history").cast("long").alias("n_history"), F.sha2(conversation.rewrite_prompt(F.col("content"), F.col("history")), 256).alias("prompt_hash"))


@query
def chat_append(spark, d):
    asked = messages(spark, d).select("repository_id", "conversation_id").distinct().select("*", F.lit("What then?").alias("message"), F.concat(F.lit("No. "), F.col("conversation_id").cast("string")).alias("answer"))
    return conversation.appended(messages(spark, d), asked, ConversationConfig(history=4)).select("conversation_id", "seq", "role", F.length("content").cast("long").alias("n_chars"))


# --- evaluation


def _judged(spark, d) -> DataFrame:
    """Three methods over the questions; a document is expected if its label is of the question's parity."""
    wanted = read(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("src"), F.pmod("doc_id", F.lit(20)).cast("string")).alias("repository_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    expected = wanted.groupBy("repository_id").agg(F.sort_array(F.collect_set("path")).alias("expected_file_paths"))
    cases = questions(spark, d).join(expected, "repository_id", "left").select(F.col("query_id").alias("case_id"), F.coalesce("expected_file_paths", F.array().cast("array<string>")).alias("expected_file_paths"), F.array().cast("array<string>").alias("expected_symbols"))
    semantic, words = (stored(x, "eval-leg") for x in _legs(spark, d, 10))
    both = fusion.fuse(semantic, words, HybridConfig(), 10, FUSED_DIGITS)
    found = [x.select(F.lit(m).alias("method"), F.col("query_id").alias("case_id"), "rank", "chunk_id", F.concat(F.lit("docs/"), F.col("chunk_id"), F.lit(".md")).alias("file_path"), F.lit(None).cast("string").alias("symbol_name")) for m, x in (("bm25", words), ("hybrid", both), ("vector", semantic))]
    return evaluation.judged(found[0].unionByName(found[1]).unionByName(found[2]), cases, ("bm25", "hybrid", "vector"))


@query
def eval_recall_mrr(spark, d):
    return evaluation.metrics(_judged(spark, d)).select("method", *long("case_count"), *[f"recall_at_{k}" for k in evaluation.CUTS], "mrr")


@query
def eval_precision(spark, d):
    return evaluation.metrics(_judged(spark, d)).select("method", *[f"precision_at_{k}" for k in evaluation.CUTS])


@query
def eval_case_detail(spark, d):
    rows = evaluation.case_details(_judged(spark, d))
    return rows.select("method", "case_id", *long("first_relevant_rank"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query
def eval_methods_compare(spark, d):
    return evaluation.markdown_rows(evaluation.metrics(_judged(spark, d)))


@query
def eval_citations(spark, d):
    expected = F.array(F.concat(F.lit("docs/"), F.get("citations.chunk_id", F.lit(0)), F.lit(".md")), F.lit("docs/none.md"))
    rows = _answers(spark, d).select(F.col("query_id").alias("case_id"), "sources", F.when(F.pmod("query_id", F.lit(3)) == 0, F.array().cast("array<string>")).otherwise(expected).alias("expected_file_paths"), F.array().cast("array<string>").alias("expected_symbols"))
    return evaluation.citation_metrics(rows)


@query
def embed_batch(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", "text").withColumn("vector", providers.embed(F.col("text"), providers.hashing_embedder(16)))
    return rows.select("item_id", F.size("vector").cast("long").alias("dimensions"), F.round(vectors.norm(F.col("vector")), 3).alias("norm"))
