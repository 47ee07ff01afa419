"""SQL that must give the rows of the registered queries, for DuckDB; written from the semantics, not from the plans."""

from __future__ import annotations

from lodestone.functions.paths import IGNORED_DIRECTORIES, LANGUAGE_BY_SUFFIX
from lodestone.operators import context, conversation

ORACLE: dict[str, str] = {}


def _text(s: str) -> str:
    """A SQL string, line ends as chr()."""
    return "concat(" + ", ".join("'" + p.replace("'", "''") + "'" + (", chr(10)" if i + 1 < len(s.split("\n")) else "") for i, p in enumerate(s.split("\n"))) + ")"


_SHAPES = ["src/app/file%d.py", "node_modules/x%d/index.js", "build/file%d.ts", "lib/.env", "web/app%d.min.js", "web/style%d.css.map", "docs/page%d.MD", "a/./b//file%d.go", "../up%d.rs", "./here%d.c", "src\\win%d.cpp", "/abs%d.java", "x/.env.local%d", "gen/api.generated.%d.ts", "vendor%d/file.html", "LICENSE%d", "x/vendor/file%d.sql", ".py", ""]
_LIST = "[" + ", ".join(f"'{s}'" for s in _SHAPES) + "]"
_PATHS = f"p AS (SELECT p_partkey::BIGINT AS id, replace({_LIST}[p_partkey % {len(_SHAPES)} + 1], '%d', p_partkey::VARCHAR) AS path FROM part)"

ORACLE["url_parse"] = """
WITH u AS (
  SELECT page_id, unnest([url, 'https://GitHub.com/o' || page_id || '/' || replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', '-') || '.git/',
    'https://github.com/one' || page_id, ' https://github.com/o' || page_id || '/r?# ', regexp_replace(url, '^http:', 'https:') || '#x']) AS url FROM pages),
t AS (SELECT page_id, url AS raw, trim(url) AS url FROM u),
x AS (SELECT *, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS h,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda y: y <> '') AS p FROM t),
n AS (SELECT *, regexp_replace(p[2], '\\.git$', '') AS name, lower(s) = 'https' AND lower(h) = 'github.com' AND len(p) = 2 AND NOT regexp_matches(url, '\\?[^#]|#.|;') AS ok FROM x)
SELECT page_id, raw AS url, CASE WHEN ok AND name <> '' THEN 'https://github.com/' || p[1] || '/' || name || '.git' END AS canonical_url, CASE WHEN ok AND name <> '' THEN name END AS name FROM n
"""
ORACLE["path_filter"] = f"""
WITH {_PATHS}, s AS (SELECT *, string_split(path, '/') AS x FROM p)
SELECT id, path, list_has_any(x[1 : len(x) - 1], {list(IGNORED_DIRECTORIES)}) OR lower(x[-1]) = '.env' OR starts_with(lower(x[-1]), '.env.')
  OR contains(lower(x[-1]), '.min.') OR contains(lower(x[-1]), '.generated.') OR ends_with(lower(x[-1]), '.map') AS ignored FROM s
"""
_CASES = " ".join(f"WHEN suffix = '{k}' THEN '{v}'" for k, v in LANGUAGE_BY_SUFFIX.items())
ORACLE["language_detect"] = f"""
WITH {_PATHS}, s AS (SELECT *, regexp_extract(lower(string_split(path, '/')[-1]), '[^.](\\.[^.]+)$', 1) AS suffix FROM p)
SELECT id, path, CASE {_CASES} END AS language FROM s
"""
ORACLE["path_validate"] = f"""
WITH {_PATHS}, s AS (SELECT *, string_split(path, '/') AS x FROM p),
n AS (SELECT *, array_to_string(list_filter(x, lambda y: y <> '' AND y <> '.'), '/') AS normal FROM s)
SELECT id, path, CASE WHEN trim(path) <> '' AND NOT contains(path, '\\') AND NOT starts_with(path, '/') AND NOT starts_with(path, './') AND NOT list_contains(x, '..') AND normal <> '' THEN normal END AS normal FROM n
"""
ORACLE["size_binary_filter"] = "SELECT doc_id, strlen(text)::BIGINT AS size_bytes FROM documents WHERE strlen(text) <= 4000 AND doc_id % 7 <> 0"
ORACLE["ingest_summary"] = """
SELECT source AS repository_id, count(*)::BIGINT AS file_count, sum(strlen(text))::BIGINT AS total_size_bytes, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages
FROM documents GROUP BY source
"""
_LINES = "list_filter(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'), lambda x: x <> '')"
ORACLE["line_count"] = f"SELECT doc_id, len({_LINES})::BIGINT AS line_count FROM documents"
ORACLE["repository_tree"] = f"""
SELECT source AS repository_id, 'f' || (doc_id % 40) || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' ELSE '.SQL' END AS path,
  CASE doc_id % 4 WHEN 0 THEN 'Markdown' WHEN 1 THEN 'Python' ELSE 'SQL' END AS language, strlen(text)::BIGINT AS size_bytes, len({_LINES})::BIGINT AS line_count, md5(text) AS content_md5
FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 4 <> 2 AND doc_id % 7 <> 0 AND strlen(text) <= 4000
"""


def _pieces(limit: int, overlap: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT source, 'docs/' || doc_id || '.md' AS path, {_LINES} AS lines FROM documents),
l AS (SELECT path, unnest(range(0, len(lines))) AS i, unnest(list_transform(lines, lambda x: length(x))) AS n FROM d),
c AS (SELECT path, i, n, sum(n) OVER (PARTITION BY path ORDER BY i) - n AS before FROM l),
e AS (SELECT path, i, greatest(count(*) OVER (PARTITION BY path ORDER BY before + n RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS later, before, n FROM c),
f AS (SELECT a.path, a.i, greatest(a.i + 1, max(b.i) + 1) AS e FROM c a JOIN c b ON a.path = b.path AND b.i >= a.i AND b.before + b.n - a.before <= {limit} GROUP BY a.path, a.i),
g AS (SELECT c.path, c.i, coalesce(f.e, c.i + 1) AS e FROM c LEFT JOIN f USING (path, i)),
w(path, i, e) AS (
  SELECT path, i, e FROM g WHERE i = 0
  UNION ALL SELECT g.path, g.i, g.e FROM w JOIN g ON g.path = w.path AND g.i = greatest(w.i + 1, w.e - {overlap}) JOIN d ON d.path = w.path WHERE w.e < len(d.lines)),
p AS (SELECT source, path, i + 1 AS start_line, e AS end_line, array_to_string(lines[i + 1 : e], '') AS content,
  row_number() OVER (PARTITION BY path ORDER BY i) AS part, count(*) OVER (PARTITION BY path) AS parts FROM w JOIN d USING (path))
SELECT path AS file_path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, part, parts, 'fallback' AS chunk_type, NULL::VARCHAR AS symbol_name, length(content)::BIGINT AS n_chars,
  sha256(concat(source, chr(31), path, chr(31), start_line, chr(31), end_line, chr(31), '', chr(31), 'fallback', chr(31), content)) AS chunk_id FROM p
"""


ORACLE["chunk_fallback"] = _pieces(4000, 2)
ORACLE["chunk_small_overlap"] = _pieces(200, 1)
ORACLE["chunk_markdown"] = f"""
WITH t AS (
  SELECT 'talk/' || conv_id || '.md' AS path, CASE WHEN conv_id % 2 = 0 THEN 'intro' || chr(10) ELSE '' END
    || string_agg('## ' || role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id),
l AS (SELECT path, unnest(range(1, len({_LINES}) + 1)) AS i, unnest({_LINES}) AS line FROM t),
s AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line), '#') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS section FROM l),
g AS (SELECT path, section, min(i) AS start_line, max(i) AS end_line, string_agg(line, '' ORDER BY i) AS content, arg_min(line, i) AS head FROM s GROUP BY path, section),
c AS (SELECT *, CASE WHEN section = 0 THEN 'fallback' ELSE 'markdown_section' END AS kind, CASE WHEN section > 0 THEN nullif(trim(regexp_replace(head, '^\\s*#*', ''), ' ' || chr(10)), '') END AS symbol FROM g)
SELECT path AS file_path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, 1::BIGINT AS part, 1::BIGINT AS parts, kind AS chunk_type, symbol AS symbol_name, length(content)::BIGINT AS n_chars,
  sha256(concat('talks', chr(31), path, chr(31), start_line, chr(31), end_line, chr(31), coalesce(symbol, ''), chr(31), kind, chr(31), content)) AS chunk_id FROM c
"""
ORACLE["chunk_ids"] = f"""
SELECT doc_id::VARCHAR AS doc_id, sha256(concat(source, chr(31), 'docs/', doc_id, '.md', chr(31), 1, chr(31), len({_LINES}), chr(31), '', chr(31), 'fallback', chr(31), text)) AS chunk_id FROM documents
"""
ORACLE["module_gaps"] = """
WITH r AS (SELECT DISTINCT l_orderkey AS file, l_linenumber::BIGINT AS line, l_quantity > 25 AS covered FROM lineitem),
g AS (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS run FROM r WHERE NOT covered)
SELECT file, min(line) AS start_line, max(line) AS end_line FROM g GROUP BY file, run
"""


def _tokens(e: str) -> str:
    parts = "list_filter(string_split(lower(replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), ' '), lambda x: x <> '' AND x <> lower(w))"
    return f"flatten(list_transform(regexp_extract_all({e}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda w: list_concat([lower(w)], {parts})))"


_CAPS = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
ORACLE["tokenize_code"] = f"""
WITH n AS (SELECT p_partkey, {_CAPS} || ' getUserById JWT_SECRET __init__ user2Name 2abc HTTPServer ' || replace({_CAPS}, ' ', '') || ' ' || replace(p_name, ' ', '_') AS name FROM part)
SELECT p_partkey, array_to_string({_tokens('name')}, ' ') AS tokens FROM n
"""
_DOCS = f"docs AS (SELECT source AS repo, doc_id::VARCHAR AS id, lang, text, {_tokens("'docs/' || doc_id || '.md' || chr(10) || text")} AS tokens FROM documents)"
_POST = "post AS (SELECT repo, id, term, count(*) AS tf FROM (SELECT repo, id, unnest(tokens) AS term FROM docs) GROUP BY ALL)"
_STATS = "df AS (SELECT repo, term, count(*) AS df FROM post GROUP BY ALL), rs AS (SELECT repo, count(*) AS n, avg(len(tokens)) AS avgdl FROM docs GROUP BY repo)"
ORACLE["postings"] = f"WITH {_DOCS}, {_POST} SELECT repo AS repository_id, term, id AS chunk_id, tf::BIGINT AS tf FROM post"
ORACLE["term_stats"] = f"WITH {_DOCS}, {_POST}, {_STATS} SELECT repo AS repository_id, term, df::BIGINT AS df FROM df"
_DIGEST = "sha1(unhex('0de7d8c3591048bbbd81cc78732cc1ad') || vec_id::VARCHAR::BLOB)"
ORACLE["point_ids"] = f"""
WITH h AS (SELECT vec_id, {_DIGEST} AS h FROM embeddings)
SELECT vec_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', ((('0x' || h[17]))::INT % 4) + 1, 1), h[18:20], '-', h[21:32]) AS point_id FROM h
"""
ORACLE["payload_hash"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents"
ORACLE["repo_replace"] = """
SELECT source AS repository_id, doc_id::VARCHAR AS chunk_id, CASE WHEN source = 'src3' THEN sha256('new') ELSE sha256(text) END AS hash
FROM documents WHERE source <> 'src3' OR doc_id % 2 = 1
"""
ORACLE["repo_delete_status"] = "SELECT source AS repository_id, count(*) FILTER (WHERE source <> 'src4')::BIGINT AS indexed_chunk_count FROM documents GROUP BY source"
ORACLE["upsert_dedupe"] = "SELECT vec_id % 100 AS point_id, max(vec_id) AS version, arg_max(label, vec_id) AS label FROM embeddings GROUP BY 1"
ORACLE["list_files"] = "SELECT 'docs/' || doc_id || '.md' AS file_path, lang AS language, count(*)::BIGINT AS chunk_count FROM documents WHERE source = 'src5' GROUP BY ALL"
_POINT = _DIGEST.replace("vec_id", "doc_id")
ORACLE["list_files_truncated"] = f"""
WITH h AS (SELECT *, {_POINT} AS h FROM documents WHERE source = 'src0'),
p AS (SELECT *, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', ((('0x' || h[17]))::INT % 4) + 1, 1), h[18:20], '-', h[21:32]) AS point_id FROM h ORDER BY point_id LIMIT 20)
SELECT 'docs/' || doc_id || '.md' AS file_path, lang AS language, count(*)::BIGINT AS chunk_count FROM p GROUP BY ALL
"""
ORACLE["file_chunks"] = f"SELECT doc_id::VARCHAR AS chunk_id, 'docs/6.md' AS file_path, 1::BIGINT AS start_line, len({_LINES})::BIGINT AS end_line FROM documents WHERE source = 'src6' AND doc_id = 6"
ORACLE["symbol_lookup"] = f"""
WITH h AS (SELECT *, {_POINT} AS h FROM documents WHERE source = 'src7' AND doc_id % 3 = 1),
p AS (SELECT *, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', ((('0x' || h[17]))::INT % 4) + 1, 1), h[18:20], '-', h[21:32]) AS point_id FROM h ORDER BY point_id LIMIT 200)
SELECT doc_id::VARCHAR AS chunk_id, 's1' AS symbol_name FROM p
"""
ORACLE["repo_id"] = "SELECT page_id, 'repo_' || sha256(url)[1:16] AS repository_id FROM pages"
ORACLE["content_signature"] = "SELECT source AS repository_id, sha256(string_agg('docs/' || doc_id || '.md' || chr(0) || text || chr(0), '' ORDER BY 'docs/' || doc_id || '.md')) AS content_signature FROM documents GROUP BY source"
ORACLE["unchanged_skip"] = "SELECT DISTINCT source AS repository_id FROM documents WHERE source IN ('src1', 'src9')"
ORACLE["registry_latest"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"

ORACLE["merkle_signature"] = """
WITH leaf AS (SELECT source AS repo, sha256(sha256('docs/' || doc_id || '.md') || sha256(text)) AS digest, count(*) AS n FROM documents GROUP BY ALL),
a AS (SELECT repo, digest[1:6] AS place, sha256(string_agg(digest || ':' || n, ',' ORDER BY digest)) AS d FROM leaf WHERE digest IS NOT NULL GROUP BY ALL),
b AS (SELECT repo, place[1:3] AS place, sha256(string_agg(place || ':' || d, ',' ORDER BY place)) AS d FROM a GROUP BY ALL)
SELECT source AS repository_id, coalesce(any_value(root), sha256('')) AS content_signature FROM documents
LEFT JOIN (SELECT repo, sha256(string_agg(place || ':' || d, ',' ORDER BY place)) AS root FROM b GROUP BY repo) ON repo IS NOT DISTINCT FROM source GROUP BY source"""
ORACLE["lifecycle_states"] = """
WITH RECURSIVE m AS (
  SELECT user_id, row_number() OVER w AS i, ts - lag(ts) OVER w > INTERVAL 12 HOURS AS late,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'ingesting' WHEN 'click' THEN 'indexing' WHEN 'purchase' THEN 'completed' ELSE if(event_id % 4 = 0, 'deleted', 'failed') END AS move
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 'none' AS stage, 0 AS progress, 0::BIGINT AS rejected, 0::BIGINT AS stuck FROM events
  UNION ALL
  SELECT user_id, i, if(ok, move, was), CASE WHEN NOT ok OR move = 'failed' THEN progress WHEN move = 'ingesting' THEN 15 WHEN move = 'indexing' THEN 45 WHEN move = 'completed' THEN 100 ELSE 0 END,
    rejected + (NOT ok)::BIGINT, stuck + timed::BIGINT
  FROM (
    SELECT *, CASE move WHEN 'queued' THEN true WHEN 'ingesting' THEN was = 'queued' WHEN 'indexing' THEN was = 'ingesting' WHEN 'completed' THEN was IN ('ingesting', 'indexing')
      WHEN 'failed' THEN was IN ('queued', 'ingesting', 'indexing') ELSE was NOT IN ('none', 'deleted') END AS ok
    FROM (
      SELECT m.user_id, m.i, move, coalesce(late, false) AND stage IN ('queued', 'ingesting', 'indexing') AS timed, if(timed, 'failed', stage) AS was, progress, rejected, stuck
      FROM s JOIN m ON m.user_id = s.user_id AND m.i = s.i + 1)))
SELECT user_id AS repository_id, stage, progress, i AS n_moves, rejected AS n_rejected, stuck AS n_stuck FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""

_ASKED = "asked AS (SELECT item_id AS q, 'src' || item_id % 20 AS repo, text FROM benchmark)"
_TERMS = f"terms AS (SELECT q, repo, unnest(list_distinct({_tokens('text')})) AS term FROM asked)"


def _bm25(where: str = "true") -> str:
    return f"""{_DOCS}, {_POST}, {_STATS}, {_TERMS},
bm AS (
  SELECT q, d.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.tokens) / avgdl))), 6) AS score
  FROM terms t JOIN post p USING (repo, term) JOIN df USING (repo, term) JOIN rs USING (repo) JOIN docs d ON d.repo = t.repo AND d.id = p.id WHERE {where} GROUP BY q, d.id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM bm WHERE score > 0)"""


def _top(table: str, k: int) -> str:
    return f"SELECT q AS query_id, id AS chunk_id, score, r::BIGINT AS rank FROM {table} WHERE r <= {k}"


ORACLE["bm25_topk"] = f"WITH {_ASKED}, {_bm25()} {_top('bmr', 10)}"
ORACLE["bm25_impact_topk"] = ORACLE["bm25_topk"]
ORACLE["bm25_filtered_stats_global"] = f"WITH {_ASKED}, {_bm25(chr(39).join(['d.lang = ', 'en', '']))} {_top('bmr', 10)}"
ORACLE["payload_filter_bm25"] = f"WITH {_ASKED}, {_bm25('d.lang = ' + chr(39) + 'en' + chr(39) + ' AND d.id::BIGINT % 2 = 0')} {_top('bmr', 10)}"
ORACLE["bm25_multi_repo"] = f"WITH asked AS (SELECT item_id * 20 + k AS q, 'src' || k AS repo, text FROM benchmark, range(0, 20) x(k)), {_bm25()} {_top('bmr', 3)}"
_COS = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


def _vector(k: int, where: str = "true") -> str:
    return f"""
WITH v AS (SELECT a.vec_id AS q, b.vec_id::VARCHAR AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND {where}),
vr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM v) {_top('vr', k)}"""


ORACLE["vector_topk"] = _vector(10)
ORACLE["vector_threshold_filter"] = _vector(20, "b.label = 1").replace("AS r FROM v)", "AS r FROM v WHERE score >= 0.1)")
ORACLE["payload_filter_vector"] = _vector(10, "b.label = 1 AND b.vec_id % 2 = 0")
ORACLE["vector_topk_batch"] = _vector(5)
ORACLE["vector_ivf_topk"] = _vector(5)
ORACLE["index_difference"] = """
WITH f AS (
  SELECT source AS repository_id, 'docs/' || doc_id || '.md' AS file_path, sha256(coalesce(lang, '') || chr(0) || coalesce(text, '')) AS old,
    sha256(coalesce(lang, '') || chr(0) || coalesce(regexp_replace(text, '[0-9]+', '#', 'g'), '')) AS digest FROM documents)
SELECT repository_id, file_path, digest, 'l1' AS dead_layer FROM f WHERE digest <> old"""


def _fused(pool: int, k: int, rrf: int = 60, weight: float = 1.0) -> str:
    return f"""{_ASKED.replace('FROM benchmark', 'FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)')}, {_bm25()},
v AS (
  SELECT q, d.doc_id::VARCHAR AS id, {_COS} AS score FROM asked JOIN embeddings a ON a.vec_id = q JOIN documents d ON d.source = repo JOIN embeddings b ON b.vec_id = d.doc_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM v),
legs AS (SELECT q, id, r AS vr, NULL AS br FROM vr WHERE r <= {pool} UNION ALL SELECT q, id, NULL, r FROM bmr WHERE r <= {pool}),
m AS (SELECT q, id, min(vr) AS vr, min(br) AS br FROM legs GROUP BY q, id),
f AS (SELECT *, round(coalesce({weight}::DOUBLE / ({rrf}::DOUBLE + vr), 0) + coalesce(1::DOUBLE / ({rrf}::DOUBLE + br), 0), 9) AS score FROM m),
fr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM f QUALIFY r <= {k})"""


_FUSED = "SELECT q AS query_id, id AS chunk_id, score AS fused_score, vr::BIGINT AS vector_rank, br::BIGINT AS bm25_rank, r::BIGINT AS rank FROM fr"
ORACLE["rrf_fusion"] = f"WITH {_fused(20, 10)} {_FUSED}"
ORACLE["rrf_weighted"] = f"WITH {_fused(20, 10, 10, 2.0)} {_FUSED}"
ORACLE["hybrid_retrieve"] = f"WITH {_fused(20, 5)} {_FUSED}"


def _candidates(k: int) -> str:
    return f"""{_ASKED}, {_bm25()},
cand AS (SELECT b.q, b.id, b.score AS fused, b.r, a.text AS question, d.text AS content, d.lang, d.tokens, {_LINES.replace('text', 'd.text')} AS lines, {_tokens('d.text')} AS own, list_distinct({_tokens('a.text')}) AS qt
  FROM bmr b JOIN asked a USING (q) JOIN docs d ON d.repo = a.repo AND d.id = b.id WHERE b.r <= {k})"""


def _rerank(k: int, score: str, final: int) -> str:
    return f"""
WITH {_candidates(k)},
s AS (SELECT *, {score} AS score FROM cand WHERE r <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, r, id) AS n FROM s)
SELECT q AS query_id, id AS chunk_id, score AS relevance_score, fused AS fused_score, r::BIGINT AS prior_rank, n::BIGINT AS rank FROM o WHERE n <= {final}"""


_OVERLAP = "round(len(list_intersect(qt, own))::DOUBLE / greatest(len(qt), 1), 6)"
ORACLE["rerank_overlap"] = _rerank(20, _OVERLAP, 5)
ORACLE["rerank_fail_open"] = _rerank(20, "CASE WHEN bool_and(length(content) % 5 <> 0) OVER (PARTITION BY q) THEN 0.5::DOUBLE ELSE fused END", 5)
ORACLE["reranked_candidate_cap"] = _rerank(30, _OVERLAP, 50)


def _packed(k: int, chars: int) -> str:
    block = "concat('[', n + 1, ']', chr(10), 'File: docs/', c.id, '.md', chr(10), 'Lines: 1-', len(c.lines), chr(10), 'Symbol: <module>', chr(10), 'Language: ', c.lang, chr(10), 'content:', chr(10), c.content, chr(10))"
    return f"""RECURSIVE {_candidates(k)},
walk(q, r, n, size, content, ids) AS (
  SELECT DISTINCT q, 0::BIGINT, 0, 0::BIGINT, NULL::VARCHAR, []::VARCHAR[] FROM cand
  UNION ALL
  SELECT w.q, c.r, CASE WHEN fits THEN n + 1 ELSE n END, CASE WHEN fits THEN size + length(b) ELSE size END, CASE WHEN fits THEN concat(w.content || chr(10), b) ELSE w.content END, CASE WHEN fits THEN list_append(ids, c.id) ELSE ids END
  FROM (SELECT w.*, c.id, c.r AS cr, {block} AS b, w.size + length({block}) <= {chars} AS fits FROM walk w JOIN cand c ON c.q = w.q AND c.r = w.r + 1) w JOIN cand c ON c.q = w.q AND c.r = w.cr),
packed AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY q ORDER BY r DESC) = 1)"""


ORACLE["context_pack"] = f"WITH {_packed(12, 6000)} SELECT q AS query_id, n::BIGINT AS used_chunk_count, length(coalesce(content, ''))::BIGINT AS context_char_count, sha256(coalesce(content, '')) AS content_hash, array_to_string(ids, ',') AS chunk_ids FROM packed"
ORACLE["prompt_build"] = f"""WITH {_packed(3, 20000)}
SELECT q AS query_id, sha256(concat({_text(context.QUESTION + chr(10))}, text, {_text(chr(10) * 2 + context.CONTEXT + chr(10))}, content, {_text(chr(10) * 2 + context.REQUEST)})) AS prompt_hash FROM packed JOIN asked USING (q)"""


def _cite(n: str) -> str:
    two, one = f"CASE WHEN {n} >= 2 THEN '[2]' ELSE '' END", f"CASE WHEN {n} >= 1 THEN '[1]' ELSE '' END"
    return f"concat('See ', {two}, ' and , then ', {one}, '; [1]  ', {two}, '. ', q)"


ORACLE["citation_validate"] = f"WITH {_packed(4, 20000)} SELECT q AS query_id, {_cite('n')} AS answer, array_to_string(CASE WHEN n >= 2 THEN [ids[2], ids[1]] WHEN n = 1 THEN [ids[1]] ELSE [] END, ',') AS source_ids FROM packed"
ORACLE["answer_insufficient"] = f"""WITH {_packed(2, 20000)},
good AS (SELECT q, n, content FROM packed WHERE q % 2 = 0 AND n > 0)
SELECT a.q AS query_id, CASE WHEN g.q IS NULL THEN '{context.INSUFFICIENT}' ELSE concat('[1] ', length(concat({_text(context.QUESTION + chr(10))}, a.text, {_text(chr(10) * 2 + context.CONTEXT + chr(10))}, g.content, {_text(chr(10) * 2 + context.REQUEST)}))) END AS answer,
  coalesce(n, 0)::BIGINT AS used_chunk_count, CASE WHEN g.q IS NULL THEN 0 ELSE 1 END::BIGINT AS n_sources FROM asked a LEFT JOIN good g USING (q)"""
ORACLE["history_last_n"] = "SELECT conv_id AS conversation_id, turn AS seq, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3"
ORACLE["rewrite_window_prompt"] = f"""
WITH h AS (SELECT conv_id, turn, text, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history FROM conversations)
SELECT conv_id AS conversation_id, turn AS seq, len(history)::BIGINT AS n_history, sha256(concat({_text(conversation.REWRITE_HEAD)}, array_to_string(history, chr(10)), {_text(conversation.REWRITE_LATEST)}, text, chr(10))) AS prompt_hash
FROM h WHERE len(history) > 0
"""
ORACLE["chat_append"] = """
WITH m AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'What then?' FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, max(turn) + 2, 'assistant', 'No. ' || conv_id FROM conversations GROUP BY conv_id)
SELECT conv_id AS conversation_id, turn AS seq, role, length(text)::BIGINT AS n_chars FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4
"""
_JUDGED = f"""WITH {_fused(10, 10)},
hit AS (
  SELECT 'bm25' AS method, q, id, r FROM bmr WHERE r <= 10 AND q IN (SELECT q FROM asked) UNION ALL SELECT 'vector', q, id, r FROM vr WHERE r <= 10 UNION ALL SELECT 'hybrid', q, id, r FROM fr),
good AS (SELECT DISTINCT doc_id, 'src' || doc_id % 20 AS repo FROM labels WHERE quality = 1),
j AS (
  SELECT m.method, a.q, h.id, h.r, h.id IS NOT NULL AND EXISTS (SELECT 1 FROM good g WHERE g.doc_id::VARCHAR = h.id AND g.repo = a.repo) AS rel
  FROM (SELECT item_id AS q, 'src' || item_id % 20 AS repo FROM benchmark) a CROSS JOIN (SELECT DISTINCT method FROM hit) m LEFT JOIN hit h ON h.method = m.method AND h.q = a.q),
c AS (SELECT method, q, min(r) FILTER (WHERE rel) AS first, {', '.join(f'count(*) FILTER (WHERE rel AND r <= {k}) AS p{k}' for k in (1, 3, 5, 10))} FROM j GROUP BY method, q),
s AS (SELECT method, count(*) AS case_count, {', '.join(f'round(avg(CASE WHEN first <= {k} THEN 1::DOUBLE ELSE 0 END), 9) AS recall_at_{k}' for k in (1, 3, 5, 10))}, round(avg(coalesce(1::DOUBLE / first, 0)), 9) AS mrr,
  {', '.join(f'round(avg(p{k} / {k}::DOUBLE), 9) AS precision_at_{k}' for k in (1, 3, 5, 10))} FROM c GROUP BY method)"""
ORACLE["eval_recall_mrr"] = f"{_JUDGED} SELECT method, case_count::BIGINT AS case_count, recall_at_1, recall_at_3, recall_at_5, recall_at_10, mrr FROM s"
ORACLE["eval_precision"] = f"{_JUDGED} SELECT method, precision_at_1, precision_at_3, precision_at_5, precision_at_10 FROM s"
ORACLE["eval_case_detail"] = f"{_JUDGED} SELECT method, q AS case_id, (min(r) FILTER (WHERE rel))::BIGINT AS first_relevant_rank, coalesce(string_agg(id, ',' ORDER BY r), '') AS chunk_ids FROM j GROUP BY method, q"
ORACLE["eval_methods_compare"] = f"{_JUDGED} SELECT printf('| %s | %.3f | %.3f | %.3f | %.3f | %.3f | %.3f |', method, recall_at_1, recall_at_3, recall_at_5, recall_at_10, mrr, precision_at_5) AS line FROM s"
ORACLE["eval_citations"] = f"""WITH {_packed(4, 20000)}
SELECT q AS case_id, CASE WHEN n = 0 THEN NULL WHEN q % 3 = 0 THEN 0 ELSE round(1::DOUBLE / least(n, 2), 9) END::DOUBLE AS citation_precision, CASE WHEN q % 3 = 0 THEN NULL WHEN n = 0 THEN 0 ELSE 0.5 END::DOUBLE AS citation_recall FROM packed
"""
