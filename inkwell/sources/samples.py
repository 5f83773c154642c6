"""The sample tables as ledger tables: column expressions that Spark SQL and DuckDB read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHUNKS, RULES_VERSION
from ..schemas import DOCUMENTS as INDEXED
from . import events as stored_events
from . import index
from .shared import shared_folder

_DOC_TYPE = "CASE doc_id % 6 WHEN 0 THEN 'adr' WHEN 1 THEN 'api' WHEN 2 THEN 'runbook' WHEN 3 THEN 'readme' WHEN 4 THEN 'schema' ELSE 'other' END"
_STATUS = "CASE doc_id % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'draft' WHEN 2 THEN 'superseded' ELSE 'stale' END"
_PATH = "'docs/' || cast(doc_id as string) || '.md'"
DOCUMENTS = {"project": "source", "repo": "''", "path": _PATH, "module": "lang", "doc_type": _DOC_TYPE, "status": _STATUS, "text": "text", "doc_id": "doc_id"}

_BODY = (
    "replace(text, '.' || chr(10), '.' || chr(10) || chr(10) || '## ') || chr(10) || chr(10) || '[next](./' || cast(doc_id + 1 as string) || '.md#top) [far](../docs/' || cast(doc_id * 2 as string) || '.md) "
    "[out](https://example.com/x)' || chr(10) || CASE WHEN doc_id % 9 = 0 THEN '```' || chr(10) || 'code' || CASE WHEN doc_id % 18 = 0 THEN chr(10) || '```' ELSE '' END ELSE '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' END"
)
_FRONT = (
    "'---' || chr(10) || 'title: Doc ' || cast(doc_id as string) || CASE WHEN doc_id % 7 = 1 THEN '  # note' ELSE '' END || chr(10) || 'doc_type: ' || CASE WHEN doc_id % 13 = 0 THEN 'novel' WHEN doc_id % 13 = 1 THEN '' ELSE " + _DOC_TYPE + " END || chr(10) "
    "|| 'status: ' || " + _STATUS + " || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'module: null' || chr(10) ELSE 'module: ' || lang || chr(10) END "
    "|| CASE WHEN doc_id % 8 = 2 THEN 'superseded_by: docs/' || cast(doc_id * 3 as string) || '.md' || chr(10) WHEN doc_id % 8 = 3 THEN 'stale_since: 2024-01-0' || cast(doc_id % 9 + 1 as string) || chr(10) ELSE '' END || '---' || chr(10) || chr(10)"
)
MARKDOWN = {"project": "source", "path": _PATH, "text": f"CASE WHEN doc_id % 10 = 3 THEN '# Title *' || cast(doc_id as string) || '*' || chr(10) || chr(10) ELSE {_FRONT} END || {_BODY}", "doc_id": "doc_id"}

EVENTS = {
    "id": "event_id", "project": "'p' || cast(user_id % 5 as string)", "module": "CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'm' || cast(user_id % 23 as string) END",
    "kind": "CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'decision' WHEN 'signup' THEN 'incident' ELSE 'success' END", "title": "event_type", "summary": "props",
    "root_cause": "CASE WHEN event_type = 'error' THEN props END", "resolution": "CASE WHEN event_type = 'purchase' THEN 'done by user ' || cast(user_id as string) END",
    "result": "CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'partial' ELSE 'success' END", "severity": "CASE WHEN event_type = 'error' THEN 'high' END",
    "occurred_at": "cast(ts as timestamp)", "seconds": "CASE WHEN event_type <> 'view' THEN cast(floor(value) as bigint) END",
}


def sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table}"


def _load(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "documents", DOCUMENTS)
    return rows.withColumns({"title": F.col("path"), "commit_sha": F.lit(""), "content_hash": F.sha2("text", 256), "rules_version": F.lit(RULES_VERSION)})


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "documents", MARKDOWN)


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a line; chunks of document i have the vector i where there is one."""
    rows = _load(spark, sf_dir, "documents", DOCUMENTS).select("project", "repo", "path", "module", "doc_type", "status", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "content"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows.join(vectors, "doc_id", "left").withColumn("heading_path", F.regexp_extract("content", "^[^ ]*", 0)).drop("doc_id")


_stores: dict[tuple[str, str, str], str] = {}


def _store(spark: SparkSession, sf_dir: str, name: str, made: Callable[[str], bool]) -> tuple[str, bool]:
    """The folder of what a session stores once of a folder of tables, and whether it is to be filled (it may have been cleared)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    new = key not in _stores or not made(_stores[key])
    if new:
        _stores[key] = f"{shared_folder(spark)}/{name}"
    return _stores[key], new


def line_index(spark: SparkSession, sf_dir: str) -> str:
    """Documents and line chunks as a stored index, written at the session's first use of the tables."""
    root, new = _store(spark, sf_dir, "index", lambda at: bool(index.versions(spark, at)))
    if new:
        docs = documents(spark, sf_dir)
        none = {f.name: F.lit(None).cast(f.dataType) for f in spark.createDataFrame([], INDEXED).schema if f.name not in docs.columns}
        columns = [f.split(" ")[0] for f in INDEXED.split(", ")]
        chunks = line_chunks(spark, sf_dir).withColumn("token_count", F.lit(None).cast("int"))
        index.write_index(docs.withColumns(none).select(*columns), chunks.select(*[f.split(" ")[0] for f in CHUNKS.split(", ")]), root)
    return root


def event_store(spark: SparkSession, sf_dir: str) -> str:
    """The events as a store, written at the session's first use of the table."""
    root, new = _store(spark, sf_dir, "events", lambda at: stored_events.is_stored(spark, at))
    if new:
        stored_events.append_events(events(spark, sf_dir), root)
    return root


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "events", EVENTS)
    done = F.timestamp_micros(F.unix_micros("occurred_at") + F.col("seconds") * 1_000_000)
    return rows.withColumns({"resolved_at": done, "source": F.lit("agent"), "related_doc_path": F.lit(None).cast("string"), "payload": F.lit("{}"), "created_at": F.col("occurred_at"), "created_by": F.lit(None).cast("string")}).drop("seconds")


QUERIES = {
    "query_id": "item_id", "project": "'src' || cast(item_id % 20 as string)", "query": "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)", "module": "CASE WHEN item_id % 3 = 0 THEN 'en' END",
    "doc_type": "CASE WHEN item_id % 5 = 0 THEN 'api' END", "status": "CASE WHEN item_id % 7 = 0 THEN 'current' END", "top_k": "cast(CASE WHEN item_id % 2 = 0 THEN 12 END as int)", "vec_id": "50 * (item_id % 10)",
}


def doc_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return _load(spark, sf_dir, "benchmark", QUERIES).join(vectors, "vec_id", "left").drop("vec_id")


EVENT_QUERIES = {
    "query_id": "item_id", "project": "'p' || cast(item_id % 5 as string)", "query": "CASE item_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'click OR ' || chr(34) || 'k ' || cast(item_id as string) || chr(34) WHEN 2 THEN 'k -' || cast(item_id + 7 as string) || ' purchase' END",
    "kind": "CASE WHEN item_id % 6 = 5 THEN 'success' END", "module": "CASE WHEN item_id % 9 = 8 THEN 'm3' END", "top_k": "cast(8 as int)",
}


def event_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "benchmark", EVENT_QUERIES)
    day = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    return rows.withColumns({"since": F.when(F.col("query_id") % 2 == 1, day), "until": F.when(F.col("query_id") % 10 == 3, F.to_timestamp(F.lit("2024-01-20 00:00:00")))})
