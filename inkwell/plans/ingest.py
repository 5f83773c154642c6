"""Incremental ingest of a Markdown corpus and back-fill of embeddings."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.markdown import FRONT, chunks, first_h1
from ..functions.text import clip_error, content_hash, front_matter, normalize_text, search_text, text_error
from ..functions.validation import closed_set_error
from ..operators.changes import changes, deletable, run_counters
from ..schemas import DOC_TYPES, RULES_VERSION, STATUSES
from ..sources.corpus import classify_listing
from ..sources.index import append_changes, read_index
from ..sources.ledger import append_run, start_runs
from ..sources.shared import held

KEY = ["project", "repo", "path"]


def read_texts(raw: DataFrame) -> DataFrame:
    """project, path, mtime, text, content_hash, error of raw files (project, path, content, mtime)."""
    text = F.when(text_error(F.col("content")).isNull(), normalize_text(F.col("content").cast("string")))
    rows = raw.select("project", "path", "mtime", text.alias("text"), text_error(F.col("content")).alias("error"))
    return rows.withColumn("content_hash", content_hash(F.col("text")))


def parse_documents(texts: DataFrame) -> DataFrame:
    """texts with h1 (outside front matter) and chunks, in one pass over each; other columns go along."""
    chunk = StructType([StructField("chunk_idx", IntegerType()), StructField("heading_path", StringType()), StructField("content", StringType())])
    shape = StructType([*texts.schema.fields, StructField("h1", StringType()), StructField("chunks", ArrayType(chunk))])
    at = texts.columns.index("text")
    kind = pa.list_(pa.struct([("chunk_idx", pa.int32()), ("heading_path", pa.string()), ("content", pa.string())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [t[m.end() :] if (m := FRONT.match(t)) else t for t in batch.column(at).to_pylist()]
            made = [[{"chunk_idx": i, "heading_path": p, "content": c} for i, (p, c) in enumerate(chunks(b))] for b in bodies]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first_h1(b) for b in bodies], pa.string()), pa.array(made, kind)], names=shape.names)

    return texts.mapInArrow(task, shape)


def derive_meta(rows: DataFrame) -> DataFrame:
    """rows (path, text, h1) with title, doc_type, status, module: a root README's are fixed, others' come from front matter.

    A title comes from the first heading only where there is no front matter.
    """
    m, readme = F.col("__m"), F.col("path").rlike("(?i)^README[^/]*$")
    value = lambda k: F.when(~m[k].isin("", "null"), m[k])
    return (
        rows.withColumn("__m", front_matter(F.col("text")))
        .withColumns({
            "title": F.when(readme | m.isNull(), F.col("h1")).otherwise(value("title")),
            "doc_type": F.when(readme, "readme").otherwise(F.coalesce(value("doc_type"), F.lit("other"))),
            "status": F.when(readme, "current").otherwise(F.coalesce(value("status"), F.lit("current"))),
            "module": F.when(~readme, value("module")),
        })
        .drop("__m")
    )


@dataclass
class IngestResult:
    """The whole index after a run (documents, chunks: not computed unless asked for), and what the run changes in it."""

    documents: DataFrame
    chunks: DataFrame
    rebuilt: DataFrame
    fresh: DataFrame
    gone: DataFrame
    run: DataFrame
    skipped: DataFrame


def ingest(raw: DataFrame, listing: DataFrame, stored_docs: DataFrame, stored_chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None = None, whole: bool = True, run_id: str | None = None) -> IngestResult:
    """The index after one run over raw files (project, path, content, mtime) and their listing (project, path, kind, exact).

    Only new, changed or rule-stale documents are parsed. A project whose listing has no Markdown, or a file that can't
    be text or is outside the taxonomy, fails: paths below the first bad one are applied, nothing is deleted. A listing
    that isn't the whole corpus (whole=False) deletes nothing and says nothing of projects that it doesn't name. The run
    table has a row a project: run_id, started_at, finished_at, counters, status and error. With an embedder, documents that
    have chunks without a vector are rebuilt with the vectors that they lack.
    """
    began = datetime.datetime.now(datetime.timezone.utc)
    named = classify_listing(listing.select("project", "path", "kind", "exact")).distinct()
    skipped = named.filter("outcome <> 'indexed'").select("project", "path", F.col("outcome").alias("reason"), "exact")

    # The files are read once for their hashes, and those that changed once more for their texts.
    listed = raw.join(named.filter("outcome = 'indexed'").select("project", "path"), ["project", "path"], "left_semi")
    scan = held(read_texts(listed).select("project", "path", "content_hash", "error"))
    change = changes(scan, stored_docs)
    if not whole:
        change = change.filter("change <> 'deleted'")
    change = held(change)
    wanted = listed.join(scan.filter("error is not null").select("project", "path"), ["project", "path"], "left_anti")
    wanted = read_texts(wanted.join(change.filter("change in ('new', 'changed', 'rules_stale')").select("project", "path"), ["project", "path"], "left_semi")).drop("error")
    parsed = derive_meta(parse_documents(wanted)).drop("text")
    bad_value = F.coalesce(closed_set_error(F.col("doc_type"), DOC_TYPES, "doc_type"), closed_set_error(F.col("status"), STATUSES, "status"))
    parsed = held(parsed.withColumn("bad", bad_value)).join(change, ["project", "path"])

    problems = scan.filter("error is not null").select("project", "path", "error").unionByName(parsed.filter("bad is not null").select("project", "path", F.col("bad").alias("error")))
    # The failing path of a project is its first by bytes: a small aggregate.
    first = problems.groupBy("project").agg(F.min(F.struct("path", "error")).alias("p")).select("project", F.col("p.path").alias("bad_path"), F.concat_ws(": ", "p.path", "p.error").alias("error"))
    known = raw.select("project").unionByName(listing.select("project"))
    empty = (known.unionByName(stored_docs.select("project")) if whole else known).distinct()
    empty = empty.join(named.filter("outcome = 'indexed'").select("project").distinct(), "project", "left_anti").select("project", F.lit("").alias("bad_path"), F.lit("no Markdown was found").alias("error"))
    failed = held(first.join(empty.select("project"), "project", "left_anti").unionByName(empty))

    usable = parsed.join(failed.select("project", "bad_path"), "project", "left").filter(F.col("bad_path").isNull() | (F.col("path") < F.col("bad_path")))
    now = F.current_timestamp()
    old = stored_docs.select("project", "path", F.col("indexed_at").alias("old_at"), F.col("source_mtime").alias("old_mtime"))
    same_body = F.col("change") == "rules_stale"
    rebuilt = usable.join(old, ["project", "path"], "left").select(
        "project", F.lit("").alias("repo"), "path", "doc_type", "module", "status", "title", F.lit("").alias("commit_sha"), "content_hash",
        F.when(same_body, F.col("old_mtime")).otherwise(F.col("mtime")).alias("source_mtime"), F.when(same_body, F.col("old_at")).otherwise(now).alias("indexed_at"),
        F.lit(None).cast("int").alias("token_count"), F.lit(RULES_VERSION).alias("rules_version"),
    )
    fresh = usable.select("project", F.lit("").alias("repo"), "path", F.explode("chunks").alias("c")).select("project", "repo", "path", "c.chunk_idx", "c.heading_path", "c.content", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("int").alias("token_count"))

    keep = named.filter("outcome = 'indexed' or exact").select("project", "path")
    gone = held((deletable(stored_docs, keep, skipped.filter("reason = 'symlink'").select("project", "path")).join(failed.select("project"), "project", "left_anti")).filter(F.lit(whole)).select(*KEY))
    rebuilt, made = held(rebuilt), fresh

    applied = change.filter("change <> 'deleted'").join(failed.select("project", "bad_path"), "project", "left").filter(F.col("bad_path").isNull() | (F.col("path") < F.col("bad_path"))).select("project", "path", "change")
    counted = applied.unionByName(gone.select("project", "path", F.lit("deleted").alias("change")))
    run = run_counters(counted, made).join(failed.select("project", "error"), "project", "full_outer").fillna(0, ["files_seen", "files_changed", "files_deleted", "chunks_upserted"])
    run = run.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
    if embedder is not None:
        touched = rebuilt.select(*KEY).unionByName(gone)
        lacking = stored_chunks.filter("embedding is null").select(*KEY).distinct().join(touched, KEY, "left_anti")
        lacking = held(lacking)
        rebuilt = rebuilt.unionByName(stored_docs.join(lacking, KEY, "left_semi"))
        fresh, missing = backfill_embeddings(fresh.unionByName(stored_chunks.join(lacking, KEY, "left_semi")), embedder)
        run = run.join(missing, "project", "left").withColumn("status", F.when((F.col("status") == "ok") & (F.coalesce("missing", F.lit(0)) > 0), "partial").otherwise(F.col("status"))).drop("missing")
    run = run.select("project", F.lit(run_id or uuid.uuid4().hex).alias("run_id"), F.lit(began).alias("started_at"), F.current_timestamp().alias("finished_at"), *[c for c in run.columns if c != "project"])
    touched = rebuilt.select(*KEY).unionByName(gone)
    documents = stored_docs.join(touched, KEY, "left_anti").unionByName(rebuilt)
    chunks_ = stored_chunks.join(touched, KEY, "left_anti").unionByName(fresh)
    return IngestResult(documents, chunks_, rebuilt, fresh, gone, run, skipped)


def ingest_into(root: str, raw: DataFrame, listing: DataFrame, runs: str | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None, whole: bool = True) -> tuple[dict, IngestResult]:
    """One run into the index stored at root: the manifest after it, and the result.

    What the run writes grows with its changes, not with the index. With a folder for runs, each project has a row
    `running` before anything is read, and its finished row after the commit; a run that dies leaves `running`, one that
    raises is logged as failed for all its projects.
    """
    spark = raw.sparkSession
    run_id = uuid.uuid4().hex
    stored_docs, stored_chunks = read_index(spark, root)
    projects = raw.select("project").unionByName(listing.select("project"))
    projects = (projects.unionByName(stored_docs.select("project")) if whole else projects).distinct()
    if runs:
        start_runs(projects, run_id, runs)
    try:
        made = ingest(raw, listing, stored_docs, stored_chunks, embedder, whole, run_id)
        head = append_changes(made.rebuilt, made.fresh, made.gone, root)
    except Exception as e:
        if runs:
            error = clip_error(F.lit(str(e)))
            append_run(projects.select("project", F.lit(run_id).alias("run_id"), F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"), error.alias("error"), F.lit("failed").alias("status")), runs)
        raise
    if runs:
        append_run(made.run, runs)
    return head, made


def backfill_embeddings(chunks_: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """Chunks with missing vectors filled, and how many a project still lacks; a partition stops at its first failure."""
    shape = chunks_.schema
    columns = chunks_.columns

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = False
        for f in frames:
            vectors: list = []
            for k in range(0, len(f), batch):
                if not failed:
                    try:
                        vectors += embedder(f["__text"].iloc[k : k + batch].tolist())
                        continue
                    except Exception:  # the service's own errors, whatever they are: the run ends partial
                        failed = True
                vectors += [None] * len(f.iloc[k : k + batch])
            yield f.assign(embedding=vectors)[columns]

    lacking = chunks_.filter("embedding is null").withColumn("__text", search_text(F.col("heading_path"), F.col("content")))
    filled = held(chunks_.filter("embedding is not null").unionByName(lacking.mapInPandas(task, shape)))
    return filled, filled.filter("embedding is null").groupBy("project").agg(F.count(F.lit(1)).alias("missing"))


def chunk_summary(chunks_: DataFrame) -> DataFrame:
    """One row over all chunks: chunks, shortest, median, mean and longest length, and how many are under 200."""
    n = F.length("content")
    return chunks_.agg(
        F.count(F.lit(1)).alias("chunks"), F.min(n).alias("shortest"), F.percentile(n, F.lit(0.5)).alias("median"), F.avg(n).alias("mean"), F.max(n).alias("longest"), F.count(F.when(n < 200, 1)).alias("under_200")
    )


def chunk_profile(chunks_: DataFrame) -> DataFrame:
    """Per document: chunks, longest, over the soft limit, without heading."""
    n = F.length("content")
    return chunks_.groupBy("project", "path").agg(F.count(F.lit(1)).alias("chunks"), F.max(n).alias("longest"), F.count(F.when(n > 1200, 1)).alias("over_soft"), F.count(F.when(F.col("heading_path").isNull(), 1)).alias("without_heading"))
