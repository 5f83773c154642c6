"""Event intake, query log, lookups, file windows and proposals."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, iso, normalize_text, strip, windows
from ..functions.validation import base_hash_error, event_error, timestamp
from ..schemas import EVENT_KEYS

EVENT_FIELDS = ["id", "project", "module", "kind", "title", "summary", "root_cause", "resolution", "result", "severity", "occurred_at", "resolved_at", "source", "related_doc_path", "payload", "created_at", "created_by"]


def validate_events(submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted as events without id, rejected with error) of submissions; the first failing rule gives the message."""
    rows = submitted.withColumn("error", event_error(F.col("keys")))
    good = rows.filter("error is null").select(
        strip(F.col("project")).alias("project"), "module", "kind", "title", "summary", "root_cause", "resolution", "result", "severity",
        timestamp(F.col("occurred_at")).alias("occurred_at"), timestamp(F.col("resolved_at")).alias("resolved_at"), F.coalesce("source", F.lit("agent")).alias("source"),
        "related_doc_path", F.coalesce("payload", F.lit("{}")).alias("payload"), F.current_timestamp().alias("created_at"), "created_by",
    )
    return good, rows.filter("error is not null").select(*EVENT_KEYS, "error")


def with_ids(events: DataFrame, after: int = 0) -> DataFrame:
    """Unique ids above `after`, without ordering all rows: they grow within a partition and differ between partitions."""
    return events.withColumn("id", F.monotonically_increasing_id() + F.lit(after + 1)).select(*EVENT_FIELDS)


def event_lookup(requests: DataFrame, events: DataFrame) -> DataFrame:
    """requests (id, project) with found and the event's fields; both must match."""
    rows = events.select(*[c for c in EVENT_FIELDS if c in events.columns], F.lit(True).alias("found"))
    return requests.join(rows, ["id", "project"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def applied_filters(*names: str) -> Column:
    """JSON of the filters that were given, keys sorted, times as ISO."""
    value = lambda n: iso(F.col(n)) if n in ("since", "until") else F.col(n)
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in sorted(names)]), F.array(*[value(n) for n in sorted(names)]))
    return F.to_json(F.map_filter(pairs, lambda _, v: v.isNotNull()))


def query_log(queries: DataFrame, results: DataFrame, tool: str, client: str, filters: tuple[str, ...], paths: bool = True) -> DataFrame:
    """A row for each answered query: its filters, hit paths in order (null for events) and hit count, zero included."""
    hits = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("hit_count"), *([F.array_sort(F.collect_list(F.struct("position", "path"))).alias("p")] if paths else []))
    rows = queries.join(hits, "query_id", "left")
    hit_paths = F.transform(F.coalesce("p", F.array().cast("array<struct<position: int, path: string>>")), lambda x: x["path"]) if paths else F.lit(None).cast("array<string>")
    return rows.select("query_id", "project", F.lit(client).alias("client"), F.lit(tool).alias("tool"), "query", applied_filters(*filters).alias("filters"), hit_paths.alias("hit_paths"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


def file_windows(texts: DataFrame) -> DataFrame:
    """project, path, no, text, offset, next_offset, total_bytes, truncated: windows that tile each file."""
    return texts.select("project", "path", F.explode(windows(F.col("text"))).alias("w")).select("project", "path", "w.*")


def get_files(requests: DataFrame, texts: DataFrame, documents: DataFrame) -> DataFrame:
    """requests (project, path, offset) with outcome and the window there; only indexed paths answer."""
    from ..schemas import WINDOW_CHARS

    known = documents.select("project", "path").distinct().withColumn("known", F.lit(True))
    rows = requests.join(known, ["project", "path"], "left").join(texts.select("project", "path", F.col("text").alias("full")), ["project", "path"], "left")
    raw = F.encode("full", "UTF-8")
    # A text has fewer bytes than an int counts; offsets past its end needn't fit.
    cut = F.expr("substring(encode(full, 'UTF-8'), cast(least(offset, octet_length(full)) as int) + 1)")
    outcome = (
        F.when(F.col("known").isNull() | F.col("full").isNull(), "not_found")
        .when(F.col("offset") > F.octet_length(raw), "offset past the end")
        .when(~F.is_valid_utf8(cut.cast("string")), "offset inside a character")
        .otherwise("ok")
    )
    window = F.substring(cut.cast("string"), 1, WINDOW_CHARS)
    rows = rows.withColumn("outcome", outcome).withColumn("text", F.when(F.col("outcome") == "ok", window))
    return rows.select("project", "path", "offset", "outcome", "text", (F.col("offset") + F.octet_length("text")).alias("next_offset"), F.when(F.col("outcome") == "ok", F.octet_length(raw)).alias("total_bytes"))


def propose_docs(proposals: DataFrame, documents: DataFrame, texts: DataFrame) -> DataFrame:
    """project, path, outcome (ok, not_found, conflict, validation), exists, diff, body of proposals (project, path, body, base_hash).

    base_hash is compared with the current normalized text; both sides of the diff are normalized; equal texts, by
    hash, aren't compared line by line.
    """
    known = documents.select("project", "path").distinct().withColumn("known", F.lit(True))
    now = texts.select("project", "path", normalize_text(F.col("text")).alias("current"))
    rows = proposals.join(known, ["project", "path"], "left").join(now, ["project", "path"], "left").withColumn("body", normalize_text(F.col("body")))
    current_hash = F.concat(F.lit("sha256:"), content_hash(F.col("current")))
    outcome = (
        F.when(base_hash_error(F.col("base_hash")).isNotNull() | F.col("body").isNull(), "validation")
        .when(F.col("known").isNull(), "not_found")
        .when(F.col("base_hash").isNotNull() & ~current_hash.eqNullSafe(F.col("base_hash")), "conflict")
        .otherwise("ok")
    )
    rows = rows.select("project", "path", "body", "current", outcome.alias("outcome"), F.col("current").isNotNull().alias("exists"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            diffs = []
            for path, body, current, outcome in zip(f["path"], f["body"], f["current"], f["outcome"], strict=True):
                if outcome != "ok":
                    diffs.append(None)
                elif body == current:
                    diffs.append("")
                else:
                    source = "/dev/null" if current is None else f"a/{path}"
                    diffs.append("".join(difflib.unified_diff((current or "").splitlines(True), body.splitlines(True), source, f"b/{path}")))
            yield f.assign(diff=diffs)[["project", "path", "outcome", "exists", "diff", "body"]]

    return rows.mapInPandas(task, "project string, path string, outcome string, exists boolean, diff string, body string")


def interrupted_runs(runs: DataFrame) -> DataFrame:
    """Runs with those still running before a project's last one set to failed."""
    last = F.max("id").over(Window.partitionBy("project"))
    stale = (F.col("status") == "running") & (F.col("id") < last)
    return runs.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "error": F.when(stale, "interrupted").otherwise(F.col("error"))})
