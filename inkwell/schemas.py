"""Table schemas (as DDL, for readers and createDataFrame) and fixed values of the ledger."""

from __future__ import annotations

DOCUMENTS = (
    "project string not null, repo string not null, path string not null, doc_type string not null, module string, status string not null, "
    "title string, commit_sha string not null, content_hash string not null, source_mtime timestamp, indexed_at timestamp, token_count int, rules_version int not null"
)
CHUNKS = "project string not null, repo string not null, path string not null, chunk_idx int not null, heading_path string, content string not null, embedding array<float>, token_count int"
EVENTS = (
    "id bigint not null, project string not null, module string, kind string not null, title string not null, summary string not null, root_cause string, resolution string, "
    "result string not null, severity string, occurred_at timestamp not null, resolved_at timestamp, source string not null, related_doc_path string, payload string not null, "
    "created_at timestamp not null, created_by string"
)
INGEST_RUNS = (
    "id bigint, project string, started_at timestamp, finished_at timestamp, commit_sha string, files_seen bigint, files_changed bigint, files_deleted bigint, chunks_upserted bigint, status string, error string"
)
QUERY_LOGS = "id bigint, created_at timestamp, project string, client string, tool string, query string, filters string, hit_paths array<string>, hit_count int, latency_ms bigint"
LISTING = "path string not null, kind string not null, exact boolean not null"
DOC_QUERIES = "query_id bigint not null, project string not null, query string not null, module string, doc_type string, status string, top_k int, embedding array<float>"
EVENT_QUERIES = "query_id bigint not null, project string not null, query string, kind string, module string, since timestamp, until timestamp, top_k int"

# Fixed values of the ledger's contract.
KINDS = ("decision", "failure", "incident", "success")
RESULTS = ("failure", "partial", "success", "unknown")
SEVERITIES = ("critical", "high", "low", "medium")
SOURCES = ("agent", "github_issue", "manual", "markdown")
DOC_TYPES = ("adr", "api", "other", "readme", "runbook", "schema")
STATUSES = ("current", "draft", "stale", "superseded")
REQUIRED = ("project", "kind", "title", "summary", "occurred_at", "result")
EVENT_KEYS = (*REQUIRED, "module", "root_cause", "resolution", "severity", "resolved_at", "source", "related_doc_path", "payload", "created_by")
OPTIONAL_TEXTS = {"module": 200, "root_cause": 2000, "resolution": 2000, "related_doc_path": 200, "created_by": 200}
PROJECT_MAX, TITLE_MAX, SUMMARY_MAX, QUERY_MAX, PAYLOAD_MAX = 64, 200, 2000, 2000, 2000
RRF_K, POOL, PER_DOCUMENT, TOP_K, TOP_K_MAX = 60, 60, 2, 8, 12
EXCERPT_MAX, EXCERPT_WORDS, SCORE_DIGITS = 800, 60, 6
SOFT_LIMIT, HARD_LIMIT, HEADING_SEPARATOR, RULES_VERSION = 1200, 4000, " > ", 1
REPEAT_MIN, REPEAT_LIMIT, MODULE_LIMIT = 2, 12, 12
WINDOW_CHARS = 4000
SKIPPED_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__", ".pytest_cache")
#: White space as Python's str.isspace has it, as a Java character class.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
#: Marks that change the order in which characters are shown, as a Java character class.
BIDIRECTIONAL = r"\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069"
#: Levels of nesting that a payload can't have without being too long.
PAYLOAD_DEPTH = PAYLOAD_MAX
