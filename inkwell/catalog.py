"""The ledger queries of this library over the sample tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.validation import payload_error
from .operators import audit, changes, ranking, stats
from .plans import ingest as ing
from .plans import ledger, search
from .schemas import CHUNKS, DOCUMENTS, POOL
from .sources import corpus, index, samples
from .sources import ledger as sinks
from .sources.shared import shared_folder
from .streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


DOCS, MD, EVENTS = (samples.sql(c, t) for c, t in ((samples.DOCUMENTS, "documents"), (samples.MARKDOWN, "documents"), (samples.EVENTS, "events")))
EV = f"WITH e AS (SELECT *, occurred_at + to_seconds(seconds) AS resolved_at FROM ({EVENTS}))"


# --- documents -----------------------------------------------------------------------------------------------------


@_register("SELECT doc_id, CAST(NULL AS VARCHAR) AS error, sha256(text || chr(10)) AS content_hash, CAST(length(text) + 1 AS BIGINT) AS n_chars FROM documents")
def normalize_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("﻿"), F.regexp_replace("text", "\n", "\r\n"), F.lit("\r"))).otherwise(F.concat("text", F.lit("\n")))
    raw = docs.select("doc_id", odd.cast("binary").alias("raw"))
    text = T.normalize_text(F.col("raw").cast("string"))
    return raw.select("doc_id", T.text_error(F.col("raw")).alias("error"), T.content_hash(text).alias("content_hash"), F.length(text).cast("long").alias("n_chars"))


_LISTING = {
    "path": "CASE doc_id % 9 WHEN 0 THEN 'docs/' || cast(doc_id as string) || '.md' WHEN 1 THEN 'adr/' || cast(doc_id as string) || '.txt' WHEN 2 THEN 'readme-' || cast(doc_id as string) || '.md' WHEN 3 THEN 'src/a.md' "
    "WHEN 4 THEN 'docs/node_modules/' || cast(doc_id as string) || '.md' WHEN 5 THEN 'docs' WHEN 6 THEN 'README' ELSE 'docs/x/' || cast(doc_id as string) || '.md' END",
    "kind": "CASE doc_id % 5 WHEN 0 THEN 'link' WHEN 1 THEN 'other' ELSE 'file' END", "exact": "doc_id % 2 = 0",
}
_IN = "(starts_with({0}, 'docs/') OR starts_with({0}, 'adr/') OR regexp_matches({0}, '(?i)^README[^/]*$'))"


@_register(
    f"WITH l AS ({samples.sql(_LISTING, 'documents')}), o AS (SELECT path, exact, CASE WHEN kind = 'link' AND ({_IN.format('path')} OR {_IN.format('(path || chr(47))')}) THEN 'symlink' "
    f"WHEN NOT {_IN.format('path')} OR kind = 'link' THEN NULL WHEN NOT ends_with(path, '.md') THEN 'not-md' WHEN kind <> 'file' THEN 'not-regular' ELSE 'indexed' END AS outcome FROM l WHERE NOT list_has_any(string_split(path, '/'), ['node_modules'])) "
    "SELECT path, outcome, exact FROM o WHERE outcome IS NOT NULL"
)
def index_paths(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*[f"{e} AS {c}" for c, e in _LISTING.items()])
    return corpus.classify_listing(rows)


@_register(
    "SELECT 'docs/' || doc_id || '.md' AS path, CASE WHEN doc_id % 10 = 3 THEN 'Title ' || doc_id ELSE 'Doc ' || doc_id END AS title, "
    f"CASE WHEN doc_id % 10 = 3 THEN 'other' WHEN doc_id % 13 = 0 THEN 'novel' WHEN doc_id % 13 = 1 THEN 'other' ELSE {samples._DOC_TYPE} END AS doc_type, CASE WHEN doc_id % 10 = 3 THEN 'current' ELSE {samples._STATUS} END AS status, "
    "CASE WHEN doc_id % 10 = 3 OR doc_id % 5 IN (0, 1) THEN NULL ELSE lang END AS module FROM documents"
)
def front_matter_meta(spark, sf_dir):
    docs = samples.markdown(spark, sf_dir)
    parsed = ing.parse_documents(docs).select("project", "path", "h1")
    return ing.derive_meta(docs.join(parsed, ["project", "path"])).select("path", "title", "doc_type", "status", "module")


_STORED = (
    "SELECT source AS project, 'docs/' || cast(doc_id as string) || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS rules_version FROM documents WHERE doc_id % 10 <> 0 "
    "UNION ALL SELECT source, 'docs/' || cast(doc_id + 1000000000 as string) || '.md', text, 1 FROM documents WHERE doc_id % 50 = 0"
)
_CHANGES = (
    f"WITH s AS ({DOCS}), t AS ({_STORED}), c AS (SELECT coalesce(s.project, t.project) AS project, coalesce(s.path, t.path) AS path, CASE WHEN s.path IS NULL THEN 'deleted' WHEN t.path IS NULL THEN 'new' "
    "WHEN sha256(s.text) <> sha256(t.text) THEN 'changed' WHEN rules_version <> 1 THEN 'rules_stale' ELSE 'unchanged' END AS change FROM s FULL JOIN t ON s.project = t.project AND s.path = t.path)"
)


def _stored(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = lambda c: F.concat(F.lit("docs/"), c.cast("string"), F.lit(".md"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = d.filter("doc_id % 10 <> 0").select(F.col("source").alias("project"), path(F.col("doc_id")).alias("path"), T.content_hash(text).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, 0).otherwise(1).alias("rules_version"))
    gone = d.filter("doc_id % 50 = 0").select(F.col("source").alias("project"), path(F.col("doc_id") + 1000000000).alias("path"), T.content_hash(F.col("text")).alias("content_hash"), F.lit(1).alias("rules_version"))
    return old.unionByName(gone)


@_register(_CHANGES + " SELECT * FROM c")
def change_detection(spark, sf_dir):
    return changes.changes(samples.documents(spark, sf_dir), _stored(spark, sf_dir))


@_register(
    _CHANGES + ", n AS (SELECT project, path, len(string_split(text, chr(10))) AS chunks FROM s) SELECT project, count(*) FILTER (change <> 'deleted') AS files_seen, count(*) FILTER (change IN ('new', 'changed')) AS files_changed, "
    "count(*) FILTER (change = 'deleted') AS files_deleted, CAST(coalesce(sum(chunks) FILTER (change IN ('new', 'changed', 'rules_stale')), 0) AS BIGINT) AS chunks_upserted FROM c LEFT JOIN n USING (project, path) GROUP BY project"
)
def ingest_counters(spark, sf_dir):
    change = changes.changes(samples.documents(spark, sf_dir), _stored(spark, sf_dir))
    made = samples.documents(spark, sf_dir).select("project", "path", F.explode(F.split("text", "\n", -1)))
    return changes.run_counters(change, made.join(change.filter("change in ('new', 'changed', 'rules_stale')"), ["project", "path"]))


_NESTED = "SELECT source AS project, 'docs/d' || cast(doc_id % 12 as string) || '/' || cast(doc_id as string) || '.md' AS path, doc_id FROM documents"


@_register(f"WITH d AS ({_NESTED}) SELECT project, path FROM d WHERE doc_id % 3 <> 0 AND NOT starts_with(path, 'docs/d1/') AND NOT (starts_with(path, 'docs/d4/') AND project < 'src5')")
def deleted_docs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = d.select(F.col("source").alias("project"), F.concat(F.lit("docs/d"), (F.col("doc_id") % 12).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "doc_id")
    links = d.select("project", F.lit("docs/d1").alias("path")).unionByName(d.filter("project < 'src5'").select("project", F.lit("docs/d4").alias("path"))).distinct()
    return changes.deletable(d, d.filter("doc_id % 3 = 0"), links).select("project", "path")


def _packs(units: str, out: str, most: int, joiner: int) -> str:
    """SQL that gathers units (keys doc, sec, blk; order k; size n) in turn as long as they fit: out has grp for each unit."""
    return f"""{out}(doc, sec, blk, k, n, size, grp) AS (SELECT doc, sec, blk, k, n, n, 0 FROM {units} WHERE k = 1
  UNION ALL SELECT u.doc, u.sec, u.blk, u.k, u.n, CASE WHEN p.size + {joiner} + u.n <= {most} THEN p.size + {joiner} + u.n ELSE u.n END, CASE WHEN p.size + {joiner} + u.n <= {most} THEN p.grp ELSE p.grp + 1 END
  FROM {out} p JOIN {units} u ON u.doc = p.doc AND u.sec = p.sec AND u.blk = p.blk AND u.k = p.k + 1)"""


#: The chunks of the Markdown corpus in SQL, with recursion for fences and for gathering: chunk has doc, project, path, sec and n.
_CHUNKED = rf"""RECURSIVE d AS ({MD}), body AS (SELECT *, regexp_replace(text, '^---[ 	]*
[\s\S]*?
---[ 	]*(
|\z)', '') AS x FROM d),
ln AS (SELECT doc_id AS doc, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS no FROM body),
fl AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY no) AS k FROM (SELECT doc, no, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS mark FROM ln) WHERE mark <> ''),
fs(doc, k, no, state) AS (SELECT doc, k, no, mark FROM fl WHERE k = 1
  UNION ALL SELECT f.doc, f.k, f.no, CASE WHEN s.state = '' THEN f.mark WHEN f.mark[1] = s.state[1] AND len(f.mark) >= len(s.state) THEN '' ELSE s.state END FROM fs s JOIN fl f ON f.doc = s.doc AND f.k = s.k + 1),
st AS (SELECT l.doc, l.no, l.line, fs.k IS NOT NULL AS is_mark, coalesce(last_value(fs.state IGNORE NULLS) OVER (PARTITION BY l.doc ORDER BY l.no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') <> '' AS inside FROM ln l LEFT JOIN fs ON fs.doc = l.doc AND fs.no = l.no),
hd AS (SELECT *, NOT is_mark AND NOT inside AND regexp_matches(line, '^#{{1,6}}\s') AS h, NOT is_mark AND NOT inside AND trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM st),
se AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY doc ORDER BY no) AS sec FROM hd),
bl AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY doc, sec ORDER BY no) AS blk FROM se WHERE NOT h),
kept AS (SELECT doc, sec, blk, no, length(line) AS n FROM bl WHERE NOT blank),
blocks AS (SELECT doc, sec, blk, CAST(sum(n) + count(*) - 1 AS BIGINT) AS n FROM kept GROUP BY ALL),
longs AS (SELECT doc, sec, blk, row_number() OVER (PARTITION BY doc, sec, blk ORDER BY no) AS k, CAST(kept.n AS BIGINT) AS n FROM kept JOIN (SELECT doc, sec, blk FROM blocks WHERE n > 4000) USING (doc, sec, blk)),
{_packs("longs", "cutup", 4000, 1)},
pieces AS (SELECT doc, sec, blk, 0 AS part, n FROM blocks WHERE n <= 4000 UNION ALL SELECT doc, sec, blk, grp, max(size) FROM cutup GROUP BY ALL),
units AS (SELECT doc, sec, 0 AS blk, row_number() OVER (PARTITION BY doc, sec ORDER BY blk, part) AS k, n FROM pieces),
{_packs("units", "packed", 1200, 2)},
chunk AS (SELECT doc, project, path, sec, max(size) AS n FROM packed JOIN d ON d.doc_id = doc GROUP BY doc, project, path, sec, grp)"""


@_register(f"WITH {_CHUNKED} SELECT project, path, count(*) AS chunks, CAST(max(n) AS INTEGER) AS longest, count(*) FILTER (n > 1200) AS over_soft, count(*) FILTER (sec = 0) AS without_heading FROM chunk GROUP BY project, path")
def chunk_profile(spark, sf_dir):
    parsed = ing.parse_documents(samples.markdown(spark, sf_dir))
    return ing.chunk_profile(parsed.select("project", "path", F.explode("chunks").alias("c")).select("project", "path", "c.*"))


def _embed(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service: eight numbers from a hash."""
    import hashlib

    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


@_register(
    f"WITH {_CHUNKED}, bad AS (SELECT project, min(path) AS path FROM d WHERE doc_id % 13 = 0 AND doc_id % 10 <> 3 GROUP BY project), use AS (SELECT d.project, d.doc_id, bad.path AS bad FROM d LEFT JOIN bad USING (project) WHERE bad.path IS NULL OR d.path < bad.path), "
    "c AS (SELECT project, count(*) AS chunks FROM chunk WHERE doc IN (SELECT doc_id FROM use) GROUP BY project) SELECT p.project, coalesce(n, 0) AS files_seen, coalesce(n, 0) AS files_changed, CAST(0 AS BIGINT) AS files_deleted, coalesce(chunks, 0) AS chunks_upserted, "
    "bad.path || ': doc_type must be one of [''adr'', ''api'', ''other'', ''readme'', ''runbook'', ''schema'']' AS error, CASE WHEN bad.path IS NULL THEN 'ok' ELSE 'failed' END AS status "
    "FROM (SELECT DISTINCT project FROM d) p LEFT JOIN (SELECT project, count(*) AS n FROM use GROUP BY project) USING (project) LEFT JOIN c USING (project) LEFT JOIN bad USING (project)"
)
def ingest(spark, sf_dir):
    """A first run over the Markdown corpus with back-fill: counters and status of each project."""
    docs = samples.markdown(spark, sf_dir)
    raw = docs.select("project", "path", F.col("text").cast("binary").alias("content"), F.lit(None).cast("timestamp").alias("mtime"))
    listing = docs.select("project", "path", F.lit("file").alias("kind"), F.lit(True).alias("exact"))
    empty_docs = spark.createDataFrame([], DOCUMENTS)
    empty_chunks = spark.createDataFrame([], CHUNKS)
    return ing.ingest(raw, listing, empty_docs, empty_chunks, _embed).run.drop("run_id", "started_at", "finished_at")


@_register(
    "WITH n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS l FROM documents) SELECT 'a' AS project, n AS files_seen, n AS files_changed, CAST(0 AS BIGINT) AS files_deleted, 'ok' AS status, CAST(0 AS BIGINT) AS links FROM n "
    "UNION ALL SELECT 'b', n - l, n - l, 0, 'ok', l FROM n"
)
def ingest_projects(spark, sf_dir):
    """A run over two projects that name the same paths: every third is a link in the second."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = d.select("doc_id", F.concat(F.lit("# Title\n\n"), F.coalesce("text", F.lit(""))).alias("text"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("project"))
    both = both.select("project", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", ((F.col("project") == "b") & (F.col("doc_id") % 3 == 0)).alias("link"))
    raw = both.filter("not link").select("project", "path", F.col("text").cast("binary").alias("content"), F.lit(None).cast("timestamp").alias("mtime"))
    listing = both.select("project", "path", F.when(F.col("link"), "link").otherwise("file").alias("kind"), F.lit(True).alias("exact"))
    made = ing.ingest(raw, listing, spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS))
    links = made.skipped.filter("reason = 'symlink'").groupBy("project").agg(F.count(F.lit(1)).alias("links"))
    return made.run.join(links, "project", "left").select("project", "files_seen", "files_changed", "files_deleted", "status", F.coalesce("links", F.lit(0)).alias("links"))


@_register(f"WITH {_CHUNKED} SELECT count(*) AS chunks, CAST(min(n) AS INTEGER) AS shortest, quantile_cont(n, 0.5) AS median, avg(n) AS mean, CAST(max(n) AS INTEGER) AS longest, count(*) FILTER (n < 200) AS under_200 FROM chunk")
def chunk_summary(spark, sf_dir):
    parsed = ing.parse_documents(samples.markdown(spark, sf_dir))
    return ing.chunk_summary(parsed.select(F.explode("chunks").alias("c")).select("c.*"))


# --- search --------------------------------------------------------------------------------------------------------

#: Tokens as the library makes them; a mark stands for the hyphen between digits, which this engine's patterns can't look behind.
_TOKENS = r"list_transform(regexp_extract_all(lower(regexp_replace(regexp_replace({0}, '([0-9])-([0-9])', '\1 ¬\2', 'g'), '([0-9])-([0-9])', '\1 ¬\2', 'g')), '¬[0-9]+|[\p{{L}}\p{{N}}]+'), lambda x: replace(x, '¬', '-'))"
_LINES = f"""d AS ({DOCS}), l AS (SELECT *, string_split(text, chr(10)) AS a FROM d), c0 AS (SELECT * EXCLUDE (a, text), unnest(a) AS content, CAST(unnest(range(len(a))) AS INTEGER) AS chunk_idx FROM l),
c AS (SELECT c0.*, regexp_extract(content, '^[^ ]*') AS heading_path, v.embedding FROM c0 LEFT JOIN embeddings v ON v.vec_id = c0.doc_id)"""
_Q = f"q AS (SELECT b.*, e.embedding FROM ({samples.sql(samples.QUERIES, 'benchmark')}) b LEFT JOIN embeddings e USING (vec_id))"
_KEYWORD = rf"""
t AS (SELECT project, repo, path, chunk_idx, module, doc_type, status, {_TOKENS.format("heading_path || ' ' || content")} AS t FROM c),
w AS (SELECT * EXCLUDE (t), len(t) AS n_tokens, unnest(t) AS term, unnest(range(len(t))) AS pos FROM t),
qt AS (SELECT query_id, project, module AS qm, doc_type AS qd, status AS qs, unnest(list_distinct(k)) AS term, len(list_distinct(k)) AS n_terms FROM (SELECT *, {_TOKENS.format("query")} AS k FROM q)),
hit AS (SELECT qt.query_id, w.repo, w.path, w.chunk_idx, w.n_tokens, qt.n_terms, w.term, w.pos FROM w JOIN qt ON w.project = qt.project AND w.term = qt.term
  WHERE (qm IS NULL OR qm = module) AND (qd IS NULL OR qd = doc_type) AND (qs IS NULL OR qs = status)),
al AS (SELECT query_id, repo, path, chunk_idx, n_tokens, n_terms, count(*) AS n FROM hit GROUP BY ALL HAVING count(DISTINCT term) = n_terms),
near AS (SELECT a.query_id, a.repo, a.path, a.chunk_idx, product(1 - sqrt(0.1 * 0.1 * CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END)) AS miss
  FROM hit a JOIN hit b ON a.query_id = b.query_id AND a.repo = b.repo AND a.path = b.path AND a.chunk_idx = b.chunk_idx AND a.term < b.term GROUP BY ALL),
ranked AS (SELECT al.*, round(CASE WHEN n_terms = 1 THEN 0.1 * list_sum([1.0 / (j * j) FOR j IN range(1, least(n, 255) + 1)]) / 1.64493406685 ELSE greatest(1 - coalesce(miss, 1.0), 1e-20) END / log2(n_tokens + 1), 12) AS ts_rank
  FROM al LEFT JOIN near USING (query_id, repo, path, chunk_idx)),
kw AS (SELECT query_id, repo, path, chunk_idx, ts_rank, CAST(rank() OVER (PARTITION BY query_id ORDER BY ts_rank DESC) AS INTEGER) AS rank FROM ranked
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts_rank DESC, repo, path, chunk_idx) <= {POOL})"""
_VECTOR = f"""
dist AS (SELECT q.query_id, c.repo, c.path, c.chunk_idx, round(1 - list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 9) AS distance
  FROM c JOIN q ON c.project = q.project WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL AND (q.module IS NULL OR q.module = c.module) AND (q.doc_type IS NULL OR q.doc_type = c.doc_type) AND (q.status IS NULL OR q.status = c.status)),
vec AS (SELECT query_id, repo, path, chunk_idx, distance, CAST(rank() OVER (PARTITION BY query_id ORDER BY distance) AS INTEGER) AS rank FROM dist
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, repo, path, chunk_idx) <= {POOL})"""
_FUSED = """
both_arms AS (SELECT query_id, repo, path, chunk_idx, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, repo, path, chunk_idx, rank FROM kw UNION ALL SELECT query_id, repo, path, chunk_idx, rank FROM vec) GROUP BY ALL),
capped AS (SELECT * FROM both_arms QUALIFY row_number() OVER (PARTITION BY query_id, repo, path ORDER BY score DESC, chunk_idx) <= 2),
picked AS (SELECT capped.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, path, chunk_idx) AS INTEGER) AS position FROM capped)"""


def _arms(spark, sf_dir):
    """Documents, chunks, queries and the queries' postings of the stored index."""
    root, asked = samples.line_index(spark, sf_dir), samples.doc_queries(spark, sf_dir)
    documents, chunks = index.read_index(spark, root)
    return documents, chunks, asked, index.read_postings(spark, root, ranking.asked_terms(asked))


@_register(f"WITH {_LINES}, t AS (SELECT project, {_TOKENS.format("heading_path || ' ' || content")} AS t FROM c), w AS (SELECT project, unnest(t) AS term FROM t) SELECT project, term, count(*) AS n FROM w GROUP BY ALL")
def token_stats(spark, sf_dir):
    return ranking.token_table(samples.line_chunks(spark, sf_dir)).groupBy("project", "term").agg(F.count(F.lit(1)).alias("n"))


def _described(docs, chunks):
    return chunks.join(docs.select("project", "repo", "path", "module", "doc_type", "status"), ["project", "repo", "path"])


@_register(f"WITH {_LINES}, {_Q}, {_KEYWORD} SELECT * FROM kw")
def keyword_arm(spark, sf_dir):
    docs, _, asked, found = _arms(spark, sf_dir)
    return ranking.keyword_arm(found, docs, asked)


@_register(f"WITH {_LINES}, {_Q}, {_VECTOR} SELECT * FROM vec")
def vector_arm(spark, sf_dir):
    docs, chunks, asked, _ = _arms(spark, sf_dir)
    return ranking.vector_arm(_described(docs, chunks), asked)


@_register(
    f"WITH {_LINES}, {_Q}, {_KEYWORD}, {_VECTOR}, {_FUSED} SELECT query_id, position, repo, path, chunk_idx, round(score, 6) AS score FROM picked JOIN (SELECT query_id, coalesce(top_k, 8) AS k FROM q) USING (query_id) WHERE position <= k"
)
def hybrid_search(spark, sf_dir):
    docs, chunks, asked, found = _arms(spark, sf_dir)
    accepted, _ = search.checked_doc_queries(asked)
    picked = ranking.fused(ranking.keyword_arm(found, docs, accepted), ranking.vector_arm(_described(docs, chunks), accepted), accepted)
    return picked.select("query_id", "position", *ranking.KEY, F.round("score", 6).alias("score"))


@_register()
def search_excerpts(spark, sf_dir):
    return search.search_index(samples.doc_queries(spark, sf_dir), samples.line_index(spark, sf_dir))


_EQ = f"""q AS (SELECT *, CASE WHEN query_id % 2 = 1 THEN TIMESTAMP '2024-01-02' END AS since, CASE WHEN query_id % 10 = 3 THEN TIMESTAMP '2024-01-20' END AS until FROM ({samples.sql(samples.EVENT_QUERIES, "benchmark")})),
f AS (SELECT q.query_id, q.query, e.* FROM e JOIN q ON e.project = q.project WHERE (q.kind IS NULL OR q.kind = e.kind) AND (q.module IS NULL OR q.module = e.module) AND (since IS NULL OR occurred_at >= since) AND (until IS NULL OR occurred_at < until))"""
_EOUT = "strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(occurred_at) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(occurred_at) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"
#: The three shapes of the sample queries spelled out: a word; a word or a phrase; two words without a third.
_EMATCH = rf"""
tok AS (SELECT query_id, id, {_TOKENS.format("title || ' ' || summary || ' ' || coalesce(root_cause, '') || ' ' || coalesce(resolution, '')")} AS t FROM f WHERE query IS NOT NULL),
cnt AS (SELECT query_id, id, len(t) AS n, len(list_filter(t, lambda x: x = 'error')) AS a, len(list_filter(t, lambda x: x = 'click')) AS b, len(list_filter(t, lambda x: x = 'k')) AS k, len(list_filter(t, lambda x: x = 'purchase')) AS p,
  list_contains(t, CAST(query_id + 7 AS VARCHAR)) AS banned, len([i FOR i IN range(1, len(t)) IF t[i] = 'k' AND t[i + 1] = CAST(query_id AS VARCHAR)]) AS ph FROM tok),
tw AS (SELECT *, [0.1 * coalesce(list_sum([1.0 / (j * j) FOR j IN range(1, x + 1)]), 0) / 1.64493406685 FOR x IN [a, b, k, p, ph]] AS w FROM cnt),
m AS (SELECT query_id, id, round(CASE query_id % 4 WHEN 0 THEN CASE WHEN a > 0 THEN w[1] END WHEN 1 THEN greatest(CASE WHEN b > 0 THEN w[2] END, CASE WHEN ph > 0 THEN w[5] END) ELSE CASE WHEN k > 0 AND p > 0 AND NOT banned THEN (w[3] + w[4]) / 2 END END / log2(n + 1), 12) AS ts_rank FROM tw)"""


@_register(
    f"{EV}, {_EQ}, {_EMATCH}, r AS (SELECT f.*, m.ts_rank, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY m.ts_rank DESC, occurred_at DESC, f.id DESC) AS INTEGER) AS position FROM f JOIN m ON f.query_id = m.query_id AND f.id = m.id WHERE m.ts_rank IS NOT NULL) "
    f"SELECT query_id, position, id, title, summary, kind, result, module, {_EOUT} AS occurred_at, round(1.0::DOUBLE / (60 + position), 6) AS score FROM r WHERE position <= 8"
)
def event_search(spark, sf_dir):
    return search.search_events(samples.event_queries(spark, sf_dir).filter("query is not null"), root=samples.event_store(spark, sf_dir))


@_register(
    f"{EV}, {_EQ}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY occurred_at DESC, id DESC) AS INTEGER) AS position FROM f WHERE query IS NULL) "
    f"SELECT query_id, position, id, title, summary, kind, result, module, {_EOUT} AS occurred_at, CAST(NULL AS DOUBLE) AS score FROM r WHERE position <= 8"
)
def event_search_filters(spark, sf_dir):
    return search.search_events(samples.event_queries(spark, sf_dir).filter("query is null"), root=samples.event_store(spark, sf_dir))


@_register(
    f"SELECT item_id AS query_id, CASE WHEN item_id % 8 = 0 THEN 'query is empty' WHEN item_id % 8 = 1 THEN 'top_k must be between 1 and 12' WHEN item_id % 8 = 2 THEN 'doc_type must be one of [''adr'', ''api'', ''other'', ''readme'', ''runbook'', ''schema'']' "
    "WHEN item_id % 8 = 3 THEN 'project must not contain whitespace' END AS error FROM benchmark"
)
def validate_queries(spark, sf_dir):
    q = samples.doc_queries(spark, sf_dir)
    k = F.col("query_id") % 8
    q = q.withColumns({"query": F.when(k == 0, "  ").otherwise(F.col("query")), "top_k": F.when(k == 1, 13).otherwise(F.col("top_k")), "doc_type": F.when(k == 2, "poem").when(k == 4, " ").otherwise(F.col("doc_type")), "project": F.when(k == 3, "a b").otherwise(F.concat(F.lit(" "), "project"))})
    good, bad = search.checked_doc_queries(q)
    return good.select("query_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("query_id", "error"))


# --- events --------------------------------------------------------------------------------------------------------

_SUBMITTED = {
    "event_id": "event_id", "project": "CASE WHEN event_id % 17 = 1 THEN 'a b' ELSE ' p' || cast(user_id % 5 as string) END", "kind": "CASE WHEN event_id % 17 = 2 THEN 'typo' ELSE 'failure' END", "title": "CASE WHEN event_id % 17 = 3 THEN '  ' WHEN event_id % 17 = 4 THEN repeat('x', 201) ELSE event_type END",
    "summary": "CASE WHEN event_id % 17 = 3 THEN '' ELSE props END", "occurred_at": "CASE event_id % 17 WHEN 5 THEN '2024-01-01' WHEN 6 THEN '2024-01-01T00:00:00' WHEN 7 THEN '2024-13-01T00:00:00Z' ELSE '2024-01-05T09:00:00+09:00' END",
    "resolved_at": "CASE event_id % 17 WHEN 8 THEN '2024-01-04T23:59:59Z' WHEN 9 THEN '2024-01-05T00:00:00Z' END", "result": "'failure'", "severity": "CASE WHEN event_id % 17 = 10 THEN 'dire' ELSE 'low' END", "payload": "CASE event_id % 17 WHEN 11 THEN '[1]' WHEN 12 THEN '{' || chr(34) || 'a' || chr(34) || ':' || chr(34) || repeat('y', 2000) || chr(34) || '}' ELSE props END",
    "extra": "CASE WHEN event_id % 17 = 13 THEN 'x' END",
}


@_register(
    "SELECT event_id, CASE event_id % 17 WHEN 1 THEN 'project must not contain whitespace' WHEN 2 THEN 'kind must be one of [''decision'', ''failure'', ''incident'', ''success'']' WHEN 3 THEN 'missing required field: title, summary' WHEN 4 THEN 'title longer than 200' "
    "WHEN 5 THEN 'occurred_at needs a UTC offset' WHEN 6 THEN 'occurred_at needs a UTC offset' WHEN 7 THEN 'occurred_at is not ISO-8601' WHEN 8 THEN 'resolved_at is before occurred_at' WHEN 10 THEN 'severity must be one of [''critical'', ''high'', ''low'', ''medium'']' "
    "WHEN 11 THEN 'payload must be an object' WHEN 12 THEN 'payload longer than 2000' WHEN 13 THEN 'unknown field: extra' END AS error FROM events"
)
def validate_events(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} AS {c}" for c, e in _SUBMITTED.items()])
    for k in ("module", "root_cause", "resolution", "source", "related_doc_path", "created_by"):
        rows = rows.withColumn(k, F.lit(None).cast("string"))
    from .functions.validation import event_error

    keys = F.concat(F.array(*[F.lit(k) for k in ("project", "kind", "title", "summary", "occurred_at", "result", "severity", "payload")]), F.when(F.col("extra").isNotNull(), F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>")))
    return rows.select("event_id", event_error(keys).alias("error"))


@_register(f"{EV} SELECT project, count(*) AS total, CAST(round(avg(seconds)) AS BIGINT) AS avg_resolution_seconds FROM e WHERE occurred_at >= TIMESTAMP '2024-01-03' GROUP BY project")
def event_stats_head(spark, sf_dir):
    import datetime

    return stats.stats_head(stats.in_scope(samples.events(spark, sf_dir), " ", datetime.datetime(2024, 1, 3)))


@_register(f"{EV} SELECT project, 'kind' AS field, kind AS value, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT project, 'result', result, count(*) FROM e GROUP BY ALL")
def event_counts(spark, sf_dir):
    e = samples.events(spark, sf_dir)
    one = lambda f: stats.counts_by(e, f).select("project", F.lit(f).alias("field"), "value", "n")
    return one("kind").unionByName(one("result"))


@_register(
    f"{EV}, n AS (SELECT project, module AS value, count(*) AS n FROM e WHERE module IS NOT NULL GROUP BY ALL), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY n DESC, value) AS INTEGER) AS position, greatest(count(*) OVER (PARTITION BY project) - 12, 0) AS omitted FROM n) SELECT * FROM p WHERE position <= 12"
)
def module_counts(spark, sf_dir):
    return stats.module_counts(samples.events(spark, sf_dir))


_REPEATS = f"{EV}, n AS (SELECT project, module, root_cause, count(*) AS n FROM e WHERE root_cause IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"


@_register(f"{_REPEATS} SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY n DESC, root_cause, module NULLS LAST) AS INTEGER) AS position FROM n QUALIFY position <= 12")
def repeat_causes(spark, sf_dir):
    return stats.repeat_causes(samples.events(spark, sf_dir))


@_register(f"{_REPEATS} SELECT * FROM n")
def promotion_candidates(spark, sf_dir):
    return stats.repeat_causes(samples.events(spark, sf_dir), limit=None)


_STATS = """,
h AS (SELECT project, count(*) AS total, CAST(round(avg(seconds)) AS BIGINT) AS avg_resolution_seconds FROM e GROUP BY project),
k AS (SELECT project, '{' || string_agg('"' || kind || '":' || c, ',' ORDER BY kind) || '}' AS by_kind FROM (SELECT project, kind, count(*) AS c FROM e GROUP BY ALL) GROUP BY project),
r AS (SELECT project, '{' || string_agg('"' || result || '":' || c, ',' ORDER BY result) || '}' AS by_result FROM (SELECT project, result, count(*) AS c FROM e GROUP BY ALL) GROUP BY project),
m1 AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY c DESC, module) AS place FROM (SELECT project, module, count(*) AS c FROM e WHERE module IS NOT NULL GROUP BY ALL)),
m AS (SELECT project, '[' || string_agg('{"position":' || place || ',"value":"' || module || '","n":' || c || '}', ',' ORDER BY place) FILTER (place <= 12) || ']' AS by_module, greatest(count(*) - 12, 0) AS omitted FROM m1 GROUP BY project),
c1 AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, root_cause, module NULLS LAST) AS place FROM n),
c AS (SELECT project, '[' || string_agg('{"position":' || place || ',"root_cause":' || CAST(to_json(root_cause) AS VARCHAR) || coalesce(',"module":"' || module || '"', '') || ',"n":' || n || '}', ',' ORDER BY place) FILTER (place <= 12) || ']' AS repeat_causes FROM c1 GROUP BY project)
SELECT h.*, by_kind, by_result, by_module, coalesce(omitted, 0) AS by_module_omitted, repeat_causes FROM h LEFT JOIN k USING (project) LEFT JOIN r USING (project) LEFT JOIN m USING (project) LEFT JOIN c USING (project)"""


@_register(_REPEATS + _STATS)
def event_stats(spark, sf_dir):
    """The statistics of each project, nested columns as JSON."""
    out = stats.event_stats(samples.events(spark, sf_dir))
    return out.withColumns({c: F.to_json(c) for c in ("by_kind", "by_result", "by_module", "repeat_causes")})


@_register(
    f"WITH {_LINES}, e AS ({EVENTS}), p AS (SELECT DISTINCT project FROM d UNION SELECT 'p1' UNION SELECT 'nobody') SELECT project, (SELECT count(*) FROM d WHERE d.project = p.project) AS documents, (SELECT count(*) FROM c WHERE c.project = p.project) AS chunks, "
    "(SELECT count(*) FROM c WHERE c.project = p.project AND embedding IS NULL) AS chunks_without_embedding, (SELECT count(*) FROM e WHERE e.project = p.project) AS events, (SELECT max(occurred_at) FROM e WHERE e.project = p.project AND kind IN ('success')) AS last_ingest_at, "
    "(SELECT count(*) FROM e WHERE e.project = p.project AND kind = 'failure') AS zero_hit_queries FROM p"
)
def kb_status(spark, sf_dir):
    docs, e = samples.documents(spark, sf_dir), samples.events(spark, sf_dir)
    projects = docs.select("project").distinct().unionByName(spark.createDataFrame([("p1 ",), ("nobody",)], "project string"))
    # Runs and logs as the events would have left them: successes are runs, failures searches without a hit.
    runs = e.select("project", F.when(F.col("kind") == "success", "ok").otherwise("failed").alias("status"), F.col("occurred_at").alias("finished_at"))
    logs = e.select("project", F.when(F.col("kind") == "failure", 0).otherwise(1).alias("hit_count"))
    return stats.kb_status(projects, docs, samples.line_chunks(spark, sf_dir), e, runs, logs)


@_register(
    f"WITH {_LINES}, {_Q}, {_KEYWORD}, h AS (SELECT query_id, list(path ORDER BY ts_rank DESC, repo, path, chunk_idx) AS paths FROM kw GROUP BY query_id) SELECT q.query_id, project, 'batch' AS client, 'search_docs' AS tool, query, "
    "'{' || array_to_string([x FOR x IN ['\"doc_type\":\"' || doc_type || '\"', '\"module\":\"' || module || '\"', '\"status\":\"' || status || '\"'] IF x IS NOT NULL], ',') || '}' AS filters, array_to_string(coalesce(paths, []), ' ') AS hit_paths, coalesce(len(paths), 0) AS hit_count FROM q LEFT JOIN h USING (query_id)"
)
def query_log(spark, sf_dir):
    docs, _, asked, found = _arms(spark, sf_dir)
    hits = ranking.keyword_arm(found, docs, asked)
    from pyspark.sql import Window

    hits = hits.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ts_rank"), *ranking.KEY)))
    log = ledger.query_log(asked, hits, "search_docs", "batch", ("module", "doc_type", "status"))
    return log.withColumn("hit_paths", F.array_join("hit_paths", " "))


@_register(f"WITH e AS ({EVENTS}), r AS (SELECT item_id * 37 AS id, 'p' || CAST(item_id % 5 AS VARCHAR) AS project FROM benchmark) SELECT r.id, r.project, e.id IS NOT NULL AS found, e.title, e.kind FROM r LEFT JOIN e ON e.id = r.id AND e.project = r.project")
def event_lookup(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((F.col("item_id") * 37).alias("id"), F.concat(F.lit("p"), (F.col("item_id") % 5).cast("string")).alias("project"))
    return ledger.event_lookup(asked, samples.events(spark, sf_dir)).select("id", "project", "found", "title", "kind")


@_register(
    f"WITH d AS ({DOCS}), n AS (SELECT *, greatest(1, CAST(ceil(length(text) / 4000.0) AS INTEGER)) AS k FROM d), w AS (SELECT *, CAST(unnest(range(k)) AS INTEGER) AS no FROM n), p AS (SELECT project, path, no, substr(text, no * 4000 + 1, 4000) AS t, CAST(strlen(substr(text, 1, no * 4000)) AS BIGINT) AS off, CAST(strlen(text) AS BIGINT) AS total FROM w) "
    'SELECT project, path, no, t AS text, off AS "offset", off + strlen(t) AS next_offset, total AS total_bytes, off + strlen(t) < total AS truncated FROM p'
)
def file_windows(spark, sf_dir):
    return ledger.file_windows(samples.documents(spark, sf_dir))


@_register(
    f"WITH d AS ({DOCS}) SELECT project, path, CASE WHEN doc_id % 6 = 0 THEN 'validation' WHEN doc_id % 6 = 1 THEN 'conflict' ELSE 'ok' END AS outcome, doc_id % 6 NOT IN (0, 1) AND doc_id % 2 = 0 AS changes_nothing FROM d "
    "UNION ALL SELECT project, 'docs/none-' || doc_id || '.md', 'not_found', false FROM d WHERE doc_id % 40 = 0"
)
def proposals(spark, sf_dir):
    d = samples.documents(spark, sf_dir)
    right = F.concat(F.lit("sha256:"), F.sha2("text", 256))
    body = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "\n", "\r\n")).otherwise(F.concat("text", F.lit("\nmore\n")))
    base = F.when(F.col("doc_id") % 6 == 0, "md5:0").when(F.col("doc_id") % 6 == 1, F.concat(F.lit("sha256:"), F.sha2(F.concat("text", F.lit("?")), 256))).when(F.col("doc_id") % 6 == 2, None).otherwise(right)
    asked = d.select("project", "path", body.alias("body"), base.alias("base_hash"))
    none = d.filter("doc_id % 40 = 0").select("project", F.concat(F.lit("docs/none-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("x").alias("body"), F.lit(None).cast("string").alias("base_hash"))
    out = ledger.propose_docs(asked.unionByName(none), d, d.select("project", "path", "text"))
    return out.select("project", "path", "outcome", F.coalesce(F.col("diff") == "", F.lit(False)).alias("changes_nothing"))


@_register(f"WITH {EV[5:]}, {_EQ}, {_EMATCH}, n AS (SELECT query_id, least(count(*) FILTER (ts_rank IS NOT NULL), 8) AS hits FROM m GROUP BY query_id) SELECT q.query_id, project, 'search_events' AS tool, query, coalesce(kind, '') AS kind, since IS NOT NULL AS has_since, CAST(coalesce(hits, 0) AS INTEGER) AS hit_count FROM q LEFT JOIN n USING (query_id) WHERE query IS NOT NULL")
def search_log(spark, sf_dir):
    """What a batch of event searches leaves in the log, searches without a hit too."""
    path = f"{shared_folder(spark)}/log"
    search.search_events(samples.event_queries(spark, sf_dir).filter("query is not null"), root=samples.event_store(spark, sf_dir), log=path)
    log = spark.read.parquet(path)
    told = F.from_json("filters", "kind string, since string")
    return log.select("query_id", "project", "tool", "query", F.coalesce(told["kind"], F.lit("")).alias("kind"), told["since"].isNotNull().alias("has_since"), F.col("hit_count").cast("int").alias("hit_count"))


_SHAPES = {  # how a secret may stand, and what is left of it; {} is a number
    " amqp://ann:x@y{}@box/v": " amqp://ann:***@box/v", " amqp://ann@box/v?a=1&pass%77ord=x#{}&b=2": " amqp://ann@box/v?a=1&pass%77ord=***&b=2", " server=box password='x y{}' user=ann": " server=box password=*** user=ann",
    " server=box password='x y{} user=ann": " server=box password=***", ' password="x y{}" user=ann': " password=*** user=ann", " password=x\\ y{} user=ann": " password=*** user=ann", " sslpassword = x&y{} z": " sslpassword = *** z",
    " amqp://box:{}/v: write to ann@box": " amqp://box:{}/v: write to ann@box",
}
_QUOTED = [(a.replace("'", "''"), b.replace("'", "''")) for a, b in _SHAPES.items()]


@_register("SELECT event_id, props || CASE " + " ".join(f"WHEN event_id % {len(_SHAPES)} = {k} THEN replace('{b}', '{{}}', CAST(event_id AS VARCHAR))" for k, (_, b) in enumerate(_QUOTED)) + " END AS redacted FROM events")
def redaction_shapes(spark, sf_dir):
    """The events' own texts, each with a secret in one of several shapes at its end."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    added = F.expr("CASE " + " ".join(f"WHEN event_id % {len(_SHAPES)} = {k} THEN r'{a}'" for k, a in enumerate(x.replace("'", "\x01") for x in _SHAPES)) + " END")
    added = F.replace(F.translate(added, "\x01", "'"), F.lit("{}"), F.col("event_id").cast("string"))
    return e.select("event_id", T.redact(F.concat("props", added)).alias("redacted"))


_PAYLOADS = [  # JSON around a text (@), and what is wrong with it
    ('{"a":"@"}', None), ('{"a":["@",{"b":null}]}', None), ('{"a":"@\\\\u0000"}', None), ('{"a":"@\\u0000"}', "payload must not contain NUL"), ('{"@\\u0000":1}', "payload must not contain NUL"), ('{"@":NaN}', "payload must not contain NaN or Infinity"),
    ('{"@":-1e999}', "payload must not contain NaN or Infinity"), ('["@"]', "payload must be an object"), ('"@"', "payload must be an object"), ('{"@"', "payload is not JSON"), ('{"@":"' + "x" * 2000 + '"}', "payload longer than 2000"), ('{"@":' + "[" * 1100 + "]" * 1100 + "}", "payload longer than 2000"),
]


@_register(f"SELECT event_id, CASE event_id % {len(_PAYLOADS)} " + " ".join(f"WHEN {k} THEN '{e}'" for k, (_, e) in enumerate(_PAYLOADS) if e) + " END AS error FROM events")
def payload_checks(spark, sf_dir):
    """Payloads around the events' types, good and bad ones."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    shapes = F.array(*[F.lit(p) for p, _ in _PAYLOADS])
    shape = F.element_at(shapes, (F.col("event_id") % len(_PAYLOADS) + 1).cast("int"))
    return e.select("event_id", payload_error(F.replace(shape, F.lit("@"), F.col("event_type"))).alias("error"))


@_register("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'not UTF-8' WHEN 2 THEN 'contains NUL' END AS error, CASE WHEN doc_id % 4 IN (0, 3) THEN CAST(length(text) AS BIGINT) END AS n_chars FROM documents")
def text_bytes(spark, sf_dir):
    """Whole texts as bytes, some with a stray byte or a NUL at the end: what can't be a document's text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id") % 4
    raw = F.concat(F.col("text").cast("binary"), F.when(k == 1, F.lit(b"\xc3")).when(k == 2, F.lit(b"\x00")).otherwise(F.lit(b"")))
    rows = d.select("doc_id", raw.alias("content"))
    error = T.text_error(F.col("content"))
    return rows.select("doc_id", error.alias("error"), F.when(error.isNull(), F.length(F.col("content").cast("string")).cast("long")).alias("n_chars"))


@_register(f"WITH e AS ({EVENTS}) SELECT project, count(*) AS n, count(*) FILTER (id % 50 = 0) AS blank, count(root_cause) AS causes, count(*) * 8 AS keys FROM e GROUP BY project")
def read_events(spark, sf_dir):
    """Submissions read in a batch from lines of JSON."""
    folder = shared_folder(spark)
    _submitted_lines(spark, sf_dir).write.text(f"{folder}/in")
    rows = sinks.read_events(spark, f"{folder}/in")
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("title") == " ", 1)).alias("blank"), F.count("root_cause").alias("causes"), F.sum(F.greatest(F.size("keys"), F.lit(8))).alias("keys"))


@_register(
    f"WITH d AS ({MD}), bad AS (SELECT project, min(path) AS path FROM d WHERE doc_id % 13 = 0 AND doc_id % 10 <> 3 GROUP BY project), n AS (SELECT d.project, count(*) FILTER (bad.path IS NULL OR d.path < bad.path) AS n, any_value(bad.path) AS bad FROM d LEFT JOIN bad USING (project) GROUP BY d.project) "
    "SELECT project, CASE WHEN bad IS NULL THEN 'ok' ELSE 'failed' END AS status, bad || ': doc_type must be one of [''adr'', ''api'', ''other'', ''readme'', ''runbook'', ''schema'']' AS error, n AS files_seen, n AS documents FROM n"
)
def ingest_taxonomy(spark, sf_dir):
    """A run over documents of which some are outside the taxonomy: each project stops at its first one by bytes."""
    docs = samples.markdown(spark, sf_dir)
    raw = docs.select("project", "path", F.col("text").cast("binary").alias("content"), F.lit(None).cast("timestamp").alias("mtime"))
    listing = docs.select("project", "path", F.lit("file").alias("kind"), F.lit(True).alias("exact"))
    made = ing.ingest(raw, listing, spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS))
    n = made.documents.groupBy("project").agg(F.count(F.lit(1)).alias("documents"))
    return made.run.join(n, "project", "left").select("project", "status", "error", "files_seen", F.coalesce("documents", F.lit(0)).alias("documents"))


@_register(f"WITH {_LINES} SELECT project, count(*) AS chunks, CAST(count(*) AS BIGINT) AS filled FROM c GROUP BY project")
def backfill(spark, sf_dir):
    filled, _ = ing.backfill_embeddings(samples.line_chunks(spark, sf_dir).select("project", "repo", "path", "chunk_idx", "heading_path", "content", "embedding"), _embed)
    return filled.groupBy("project").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("filled"))


# --- audit ---------------------------------------------------------------------------------------------------------


@_register(
    r"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(props || ' dsn postgres://app:p@ss' || user_id || '@db/x and password=top' || event_id || ' key sk-abcdefgh' || event_id,
    '([A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]*):[^\s]*@', '\1:***@', 'g'), '(?i)\b((?:ssl)?password\s*=\s*)(''(?:[^''\\]|\\.)*''|[^\s&''][^\s&]*)', '\1***', 'g'), '\bsk-[A-Za-z0-9_-]{8,}', 'sk-***', 'g') AS redacted,
    CASE WHEN event_id % 2 = 0 THEN 'failed: ' ELSE 'failed' END AS clipped FROM events"""
)
def redaction(spark, sf_dir):
    """The events' own texts with a sample secret of each kind at their ends."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.col("props"), F.lit(" dsn postgres://app:p@ss"), F.col("user_id").cast("string"), F.lit("@db/x and password=top"), F.col("event_id").cast("string"), F.lit(" key sk-abcdefgh"), F.col("event_id").cast("string"))
    error = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("failed: "), F.lit('{"'), "props")).otherwise(F.concat(F.lit("failed\n"), "props"))
    return e.select("event_id", T.redact(line).alias("redacted"), T.clip_error(error).alias("clipped"))


@_register(
    f"WITH d AS ({samples.sql({'path': samples._PATH, 'doc_id': 'doc_id', 'lang': 'lang'}, 'documents')}) SELECT path, 'no front matter' AS problem FROM d WHERE doc_id % 10 = 3 UNION ALL SELECT path, 'no doc_type' FROM d WHERE doc_id % 10 <> 3 AND doc_id % 13 = 1 "
    "UNION ALL SELECT path, 'no module key' FROM d WHERE doc_id % 10 <> 3 AND doc_id % 5 = 0 UNION ALL SELECT path, 'doc_type outside the taxonomy' FROM d WHERE doc_id % 10 <> 3 AND doc_id % 13 = 0"
)
def doc_lint(spark, sf_dir):
    return audit.front_matter_problems(samples.markdown(spark, sf_dir))


@_register(f"WITH d AS ({DOCS}) SELECT 'doc_type' AS field, doc_type AS value, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM d GROUP BY ALL")
def taxonomy(spark, sf_dir):
    return audit.taxonomy(samples.documents(spark, sf_dir))


_LINKS = "l AS (SELECT 'docs/' || doc_id || '.md' AS src, 'docs/' || (doc_id + 1) || '.md' AS dst FROM documents UNION ALL SELECT 'docs/' || doc_id || '.md', 'docs/' || (doc_id * 2) || '.md' FROM documents)"


@_register(f"WITH {_LINKS} SELECT src, dst FROM l WHERE dst NOT IN (SELECT 'docs/' || doc_id || '.md' FROM documents)")
def broken_links(spark, sf_dir):
    return audit.broken_links(samples.markdown(spark, sf_dir))


@_register("WITH RECURSIVE r AS (SELECT 64 AS id UNION SELECT x FROM (SELECT id * 2 AS x FROM r UNION SELECT id + 64 FROM r) WHERE x < (SELECT count(*) FROM documents)) SELECT 'docs/' || doc_id || '.md' AS path FROM documents WHERE doc_id NOT IN (SELECT id FROM r)")
def orphans(spark, sf_dir):
    """Reached from document 64 by links of the texts and, at their ends, links that lead 64 further or to the double."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    added = F.concat(F.lit("[a]("), (F.col("doc_id") + 64).cast("string"), F.lit(".md) ![b](../docs/"), (F.col("doc_id") * 2).cast("string"), F.lit(".md#x)"))
    return audit.orphans(d.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat_ws("\n", "text", added).alias("text")), "docs/64.md")


@_register("SELECT 'docs/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 9 = 0 AND doc_id % 18 <> 0")
def unclosed_fences(spark, sf_dir):
    return audit.unclosed_fences(samples.markdown(spark, sf_dir))


@_register(f"WITH d AS ({DOCS}), p AS (SELECT unnest(['All rights reserved', 'MIT License', 'Creative']) AS phrase) SELECT path, phrase FROM d JOIN p ON contains(text, phrase) WHERE NOT contains(text, '`') UNION ALL SELECT path, phrase FROM d JOIN p ON contains(text, phrase) WHERE contains(text, '`')")
def phrase_scan(spark, sf_dir):
    return audit.phrase_hits(samples.documents(spark, sf_dir), ["All rights reserved", "MIT License", "Creative"])


_SCANNED = """t AS (SELECT 'docs/' || doc_id || '.md' AS path, text || chr(10) || CASE doc_id % 20 WHEN 1 THEN 'x sk-abcdefghijklmnop0 y' WHEN 2 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 3 THEN 'pg://user:secret@h' WHEN 4 THEN 'pg://user:***@h' WHEN 5 THEN 'pg://user:${PW}@h' ELSE 'plain' END AS x FROM documents)"""


@_register(
    rf"WITH {_SCANNED}, f AS (SELECT path, 'key' AS kind, unnest(regexp_extract_all(x, 'sk-[A-Za-z0-9_-]{{16,}}')) AS hit FROM t UNION ALL SELECT path, 'private key', unnest(regexp_extract_all(x, '-----BEGIN [A-Z ]*PRIVATE KEY-----')) FROM t "
    r"UNION ALL SELECT path, 'dsn', unnest(list_filter(regexp_extract_all(x, '[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]*:[^\s]+@'), lambda h: NOT regexp_matches(h, ':(\*+|\$\{[^}]*\}|)@$'))) FROM t) SELECT path, kind, hit[1:12] AS head FROM f"
)
def secret_scan(spark, sf_dir):
    """The secrets of the texts and of the sample lines at their ends."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id") % 20
    added = F.when(k == 1, "x sk-abcdefghijklmnop0 y").when(k == 2, "-----BEGIN RSA PRIVATE KEY-----").when(k == 3, "pg://user:secret@h").when(k == 4, "pg://user:***@h").when(k == 5, "pg://user:${PW}@h").otherwise("plain")
    return audit.secrets(d.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat_ws("\n", "text", added).alias("text")))


@_register(
    "WITH d AS (SELECT doc_id, 'docs/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 10 <> 3) SELECT path, CASE WHEN doc_id % 4 = 2 AND doc_id % 8 <> 2 THEN 'no superseded_by' WHEN doc_id % 4 = 2 AND doc_id * 3 NOT IN (SELECT doc_id FROM documents) THEN 'superseded by an unknown document' "
    "WHEN doc_id % 4 = 3 AND doc_id % 8 <> 3 THEN 'no stale_since' WHEN doc_id % 4 = 3 AND doc_id % 9 + 1 > 5 THEN 'stale_since is in the future' END AS problem FROM d WHERE problem IS NOT NULL"
)
def lifecycle(spark, sf_dir):
    return audit.lifecycle_problems(samples.markdown(spark, sf_dir), F.to_date(F.lit("2024-01-05")))


@_register(
    f"WITH d AS ({MD}), s AS (SELECT doc_id, path, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^##\\s'))) AS h2, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^###\\s'))) AS h3, doc_id % 9 <> 0 AS t, doc_id % 9 = 0 AND doc_id % 18 <> 0 AS f, "
    "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|'))) AS r FROM d) SELECT a.path AS left, b.path AS right, a.h2 = b.h2 AND a.h3 = b.h3 AND a.t = b.t AND a.r = b.r AND a.f = b.f AS same FROM s a JOIN s b ON b.doc_id = a.doc_id + 9"
)
def structure_parity(spark, sf_dir):
    md = samples.markdown(spark, sf_dir)
    pairs = md.select(F.col("path").alias("left"), F.concat(F.lit("docs/"), (F.col("doc_id") + 9).cast("string"), F.lit(".md")).alias("right"))
    return audit.structure_parity(md, pairs)


@_register("SELECT 'docs/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN 'right' ELSE 'left' END AS side FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 4 = 0)")
def path_parity(spark, sf_dir):
    d = samples.documents(spark, sf_dir)
    return audit.path_parity(d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 4 <> 0"))


# --- sinks and streams ---------------------------------------------------------------------------------------------


@_register(f"WITH e AS ({EVENTS}) SELECT project, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM e GROUP BY project")
def backup_roundtrip(spark, sf_dir):
    folder = shared_folder(spark)
    sinks.append(samples.events(spark, sf_dir), f"{folder}/events")
    sinks.backup_events(spark.read.parquet(f"{folder}/events"), f"{folder}/backup")
    sinks.restore_events(spark, f"{folder}/backup", f"{folder}/restored")
    return spark.read.parquet(f"{folder}/restored").groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def _submitted_lines(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{x} AS {c}" for c, x in samples.EVENTS.items()])
    return e.select(F.to_json(F.struct("project", "module", "kind", F.when(F.col("id") % 50 == 0, " ").otherwise(F.col("title")).alias("title"), "summary", "root_cause", "result", F.lit("2024-01-05T09:00:00Z").alias("occurred_at"))).alias("value"))


@_register(f"WITH e AS ({EVENTS}) SELECT project, 2 * count(*) FILTER (id % 50 <> 0) AS accepted, 2 * count(*) FILTER (id % 50 <> 0) AS ids, 2 * count(*) FILTER (id % 50 = 0) AS rejected FROM e GROUP BY project")
def stream_intake(spark, sf_dir):
    folder = shared_folder(spark)
    _submitted_lines(spark, sf_dir).write.text(f"{folder}/in")
    intake.intake(sinks.stream_events(spark, f"{folder}/in"), f"{folder}/accepted", f"{folder}/rejected", f"{folder}/state").awaitTermination()
    _submitted_lines(spark, sf_dir).write.mode("append").text(f"{folder}/in")  # a second batch: equal submissions are events of their own
    intake.intake(sinks.stream_events(spark, f"{folder}/in"), f"{folder}/accepted", f"{folder}/rejected", f"{folder}/state").awaitTermination()
    good = spark.read.parquet(f"{folder}/accepted").groupBy("project").agg(F.count(F.lit(1)).alias("accepted"), F.count_distinct("id").alias("ids"))
    bad = spark.read.parquet(f"{folder}/rejected").groupBy("project").agg(F.count(F.lit(1)).alias("rejected"))
    return good.join(bad, "project", "full_outer").fillna(0)


_MD_RIGHT = f"SELECT project, path, replace(text, 'doc_type: novel', 'doc_type: other') AS text, doc_id FROM ({MD})"


@_register(f"WITH d AS ({_MD_RIGHT}) SELECT project, path, CASE WHEN doc_id % 4 = 0 THEN sha256(text || chr(10) || 'more' || chr(10)) ELSE sha256(text) END AS content_hash, CASE WHEN doc_id % 10 = 3 THEN 'Title ' || doc_id ELSE 'Doc ' || doc_id END AS title FROM d")
def stream_ingest(spark, sf_dir):
    """The index after two batches: all files, then new versions of every fourth beside files that haven't changed."""
    folder = shared_folder(spark)
    d = samples.markdown(spark, sf_dir).withColumn("text", F.regexp_replace("text", "doc_type: novel", "doc_type: other"))
    newer = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\nmore\n"))).otherwise(F.col("text"))
    for text, at in ((F.col("text"), "2024-01-01"), (newer, "2024-01-02")):
        rows = d.select("project", "path", text.cast("binary").alias("content"), F.to_timestamp(F.lit(at)).alias("mtime"))
        rows.write.mode("append").parquet(f"{folder}/files")
        intake.incremental(spark.readStream.schema(rows.schema).parquet(f"{folder}/files"), f"{folder}/index", f"{folder}/state").awaitTermination()
    documents, _ = index.read_index(spark, f"{folder}/index")
    return documents.select("project", "path", "content_hash", "title")


@_register(
    f"WITH d AS ({_MD_RIGHT}), n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 5 = 0) AS five, count(*) FILTER (doc_id % 7 = 0) AS seven, count(*) FILTER (doc_id % 5 = 0 AND doc_id % 7 <> 0) AS changed FROM d) "
    "SELECT 1 AS version, 1 AS segments, n AS written, n AS touched, n AS documents FROM n UNION ALL SELECT 2, 2, changed, changed + seven, n - seven FROM n "
    "UNION ALL SELECT 3, 1, n - seven, 0, n - seven FROM n UNION ALL SELECT 4, 2, seven, seven, n FROM n"
)
def index_versions(spark, sf_dir):
    """What each version of a stored index holds and wrote: a first run, one that changes and deletes, a compaction, a partial run."""
    root = f"{shared_folder(spark)}/index"
    d = samples.markdown(spark, sf_dir).withColumn("text", F.regexp_replace("text", "doc_type: novel", "doc_type: other"))
    five, seven = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0

    def run(rows, whole):
        raw = rows.select("project", "path", F.col("text").cast("binary").alias("content"), F.lit(None).cast("timestamp").alias("mtime"))
        ing.ingest_into(root, raw, rows.select("project", "path", F.lit("file").alias("kind"), F.lit(True).alias("exact")), f"{root}/runs", whole=whole)

    run(d, True)
    run(d.filter(~seven).withColumn("text", F.when(five, F.concat("text", F.lit("\nmore\n"))).otherwise(F.col("text"))), True)
    index.compact(spark, root)
    run(d.filter(seven), False)
    told = []
    for version in index.versions(spark, root):
        head = index.manifest(spark, root, version)
        told.append((version, len(head["segments"]), head["segments"][-1]["documents"], head["segments"][-1]["touched"], index.read_index(spark, root, version)[0].count()))
    return spark.createDataFrame(told, "version int, segments int, written bigint, touched bigint, documents bigint")


@_register(f"WITH e AS ({EVENTS}) SELECT project, count(*) FILTER (kind = 'success') AS ok, count(*) FILTER (kind <> 'success') AS running FROM e GROUP BY project")
def run_ledger(spark, sf_dir):
    """A run for each event; those of successes have ended."""
    e, path = samples.events(spark, sf_dir), f"{shared_folder(spark)}/runs"
    runs = e.select("project", F.concat(F.lit("r"), F.col("id").cast("string")).alias("run_id"), F.col("occurred_at").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"))
    sinks.append_run(runs, path)
    sinks.append_run(e.filter("kind = 'success'").select("project", F.concat(F.lit("r"), F.col("id").cast("string")).alias("run_id"), F.col("occurred_at").alias("started_at"), F.timestamp_micros(F.unix_micros("occurred_at") + 1).alias("finished_at"), F.lit("ok").alias("status")), path)
    count = lambda status: F.count(F.when(F.col("status") == status, 1)).alias(status)
    return sinks.latest_runs(spark.read.parquet(path)).groupBy("project").agg(count("ok"), count("running"))


@_register(f"{_REPEATS} SELECT * FROM n")
def stream_repeats(spark, sf_dir):
    folder = shared_folder(spark)
    events = samples.events(spark, sf_dir)
    for part in (0, 1):  # two batches, the second of which adds to the first one's causes
        events.filter(F.col("id") % 2 == part).write.mode("append").parquet(f"{folder}/events")
        intake.repeats_sink(spark.readStream.schema(events.schema).parquet(f"{folder}/events"), f"{folder}/repeats", f"{folder}/state").awaitTermination()
    return intake.current_repeats(spark, f"{folder}/repeats")
