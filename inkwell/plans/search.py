"""Document and event search for batches of queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clip, iso, search_text, strip
from ..functions.tokens import length_norm, parse_web_query, term_weight, tokenize
from ..functions.validation import closed_set_error, project_error, query_error
from ..operators.ranking import KEY, asked_terms, chunk_postings, fused, keyword_arm, sent, vector_arm
from ..schemas import DOC_TYPES, EXCERPT_MAX, EXCERPT_WORDS, KINDS, RRF_K, SCORE_DIGITS, STATUSES, TOP_K, TOP_K_MAX
from ..sources import events as stored_events
from ..sources.index import manifest, read_index, read_postings
from ..sources.ledger import append
from ..sources.shared import held, shared_folder
from .ledger import query_log

#: Segments of stored events that a scan is told by name.
MOST_NAMED = 1000


def checked_doc_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with error): filters stripped, blank filters null, closed sets and sizes checked."""
    rows = queries.withColumns({"project": strip(F.col("project")), "query": strip(F.col("query"))} | {f: blank_to_null(F.col(f)) for f in ("module", "doc_type", "status")})
    error = F.coalesce(
        project_error(F.col("project")), query_error(F.col("query"), F.col("top_k"), True), closed_set_error(F.col("doc_type"), DOC_TYPES, "doc_type"), closed_set_error(F.col("status"), STATUSES, "status")
    )
    rows = rows.withColumn("error", error)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null")


def fragment(text: str, terms: set[str]) -> str:
    """At most EXCERPT_WORDS words of the text around the smallest stretch that has all the terms found in it."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    holds = [{t for t in re.findall(r"[^\W_]+", text[a:b].lower()) if t in terms} for a, b in words]
    want, best, low, count = set().union(*holds) if holds else set(), (len(words) + 1, 0), 0, {}
    for high, own in enumerate(holds):
        for t in own:
            count[t] = count.get(t, 0) + 1
        while want and len(count) == len(want):
            best = min(best, (high - low, low))
            for t in holds[low]:
                count[t] -= 1
                if not count[t]:
                    del count[t]
            low += 1
    size, at = best if want else (0, 0)
    start = max(0, at - max(0, EXCERPT_WORDS - size - 1) // 2)
    part = words[start : start + EXCERPT_WORDS]
    return text[part[0][0] : part[-1][1]] if part else ""


def excerpts(picked: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """picked rows with heading_path and excerpt: a fragment for rows that keywords found, else the chunk's head; clipped.

    Picked are at most TOP_K_MAX rows a query; they are sent to the chunks, whose texts don't move.
    """
    rows = picked.join(queries.select("query_id", "project", tokenize(F.col("query")).alias("terms")), "query_id")
    rows = chunks.select("project", *KEY, "heading_path", "content").join(sent(rows), ["project", *KEY])
    wanted = rows.withColumn("full", F.when(F.col("by_keyword"), search_text(F.col("heading_path"), F.col("content"))))
    names = [c for c in picked.columns if c != "by_keyword"]
    shape = picked.select(*names).schema.add("heading_path", "string").add("excerpt", "string")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for full, content, terms in zip(f["full"], f["content"], f["terms"], strict=True):
                part = content if full is None else fragment(full, set(terms) & set(re.findall(r"[^\W_]+", full.lower())))
                out.append(part if len(part) <= EXCERPT_MAX else part[: EXCERPT_MAX - 1] + "…")
            yield f.assign(excerpt=out)[[*names, "heading_path", "excerpt"]]

    return wanted.select(*names, "heading_path", "content", "full", "terms").mapInPandas(task, shape)


def _logged(results: DataFrame, accepted: DataFrame, tool: str, client: str, filters: tuple[str, ...], log: str | None, paths: bool) -> DataFrame:
    """The results, after a row for each accepted query in the log, if there is one; rejected queries leave none."""
    if not log:
        return results
    results = held(results)
    append(query_log(accepted, results, tool, client, filters, paths).withColumn("created_at", F.current_timestamp()), log)
    return results


def search_docs(queries: DataFrame, documents: DataFrame, chunks: DataFrame, found: DataFrame | None = None, log: str | None = None, client: str = "batch") -> DataFrame:
    """query_id, position, repo, path, chunk_idx, heading_path, excerpt, commit_sha, status, score (six digits).

    found: stored postings of the chunks; without any the chunks are tokenized for this batch.
    """
    accepted, _ = checked_doc_queries(queries)
    described = chunks.join(documents.select("project", "repo", "path", "module", "doc_type", "status"), ["project", "repo", "path"])
    found = chunk_postings(chunks) if found is None else found
    picked = held(fused(keyword_arm(found, documents, accepted), vector_arm(described, accepted), accepted))
    # Rows without a body any more drop out silently.
    rows = excerpts(picked, chunks, accepted)
    rows = rows.join(accepted.select("query_id", "project"), "query_id").join(documents.select("project", "repo", "path", "commit_sha", F.col("status").alias("doc_status")), ["project", "repo", "path"])
    rows = rows.select("query_id", "position", *KEY, "heading_path", "excerpt", "commit_sha", F.col("doc_status").alias("status"), F.round("score", SCORE_DIGITS).alias("score"))
    return _logged(rows, accepted, "search_docs", client, ("module", "doc_type", "status"), log, True)


def search_index(queries: DataFrame, root: str, log: str | None = None, client: str = "batch") -> DataFrame:
    """search_docs over the last version of the index stored at root: of its postings, the buckets of the queries' terms."""
    spark = queries.sparkSession
    version = manifest(spark, root)["version"]
    documents, chunks = read_index(spark, root, version)
    accepted, _ = checked_doc_queries(queries)
    return search_docs(queries, documents, chunks, read_postings(spark, root, asked_terms(accepted), version), log, client)


def checked_event_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = queries.withColumns({"project": strip(F.col("project")), "query": blank_to_null(F.col("query")), "kind": blank_to_null(F.col("kind")), "module": blank_to_null(F.col("module"))})
    period = F.when(F.col("since") >= F.col("until"), "since must be before until")
    error = F.coalesce(project_error(F.col("project")), query_error(F.col("query"), F.col("top_k"), False), closed_set_error(F.col("kind"), KINDS, "kind"), period)
    rows = rows.withColumn("error", error)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null")


def _fits() -> Column:
    """Whether an event passes a query's filters: kind, module and the half-open period."""
    fits = (F.col("q_kind").isNull() | (F.col("q_kind") == F.col("kind"))) & (F.col("q_module").isNull() | (F.col("q_module") == F.col("module")))
    return fits & (F.col("since").isNull() | (F.col("occurred_at") >= F.col("since"))) & (F.col("until").isNull() | (F.col("occurred_at") < F.col("until")))


def _first_events(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each query by rank, time and id with their position, in two steps: no task sorts a whole query."""
    order = [F.desc_nulls_last("ts_rank"), F.desc("occurred_at"), F.desc("id")]
    part = F.pmod(F.xxhash64("id"), F.lit(32))
    local = rows.withColumn("__part", part).withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__part").orderBy(*order))).filter(F.col("__n") <= n)
    return local.drop("__n", "__part").withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("position") <= n)


def parsed(queries: DataFrame) -> DataFrame:
    """A row for each word of each web-style query: its group (of those joined by OR), part (a term or phrase) and place there.

    negative parts exclude; size is the part's words, needed the group's parts that must be found.
    """
    shape = "query_id bigint, grp int, needed int, part int, negative boolean, at int, term string, size int"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, query in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g, group in enumerate(parse_web_query(query)):
                    needed = len({tuple(p) for p in group["all"]})
                    for negative, kind in ((False, "all"), (True, "none")):
                        for k, phrase in enumerate(dict.fromkeys(map(tuple, group[kind]))):
                            rows += [(name, g, needed, k, negative, i, term, len(phrase)) for i, term in enumerate(phrase)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int32())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "grp", "needed", "part", "negative", "at", "term", "size"])

    return queries.filter("query is not null").select("query_id", "query").mapInArrow(task, shape)


def event_words(queries: DataFrame) -> DataFrame:
    """parsed(queries) with their project and filters."""
    return parsed(queries).join(queries.select("query_id", "project", F.col("kind").alias("q_kind"), F.col("module").alias("q_module"), "since", "until"), "query_id")


def event_matches(found: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, id, occurred_at, ts_rank of the events that match web-style queries; found: postings of events, words: event_words.

    A phrase holds where its words' positions, each less its place in the phrase, have a common one. A group holds where
    all its parts are found and none that it excludes. The rank is the mean of the parts' weights over their
    occurrences, normed by length, of the best group. An event's hits for a query meet once, in one shuffle.
    """
    hit = found.join(sent(words), ["project", "term"]).filter(_fits()).repartition("query_id", "id")
    event = ["query_id", "id", "occurred_at", "n_tokens"]
    starts = F.transform("positions", lambda p: p - F.col("at"))
    part = hit.withColumn("starts", starts).groupBy(*event, "grp", "needed", "part", "negative", "size").agg(F.collect_list("starts").alias("lists"))
    common = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.col("lists")[0], lambda acc, x: F.array_intersect(acc, x))
    part = part.filter(F.size("lists") == F.col("size")).withColumn("times", F.size(common)).filter("times > 0")
    wanted = F.when(~F.col("negative"), 1)
    group = part.groupBy(*event, "grp", "needed").agg(F.count(wanted).alias("got"), F.count(F.when(F.col("negative"), 1)).alias("banned"), F.sum(F.when(~F.col("negative"), term_weight(F.col("times")))).alias("weight"))
    good = group.filter("got = needed and banned = 0")
    rank = F.round(F.max(F.col("weight") / F.col("needed")) / length_norm(F.col("n_tokens")), 12)
    return good.groupBy(*event).agg(rank.alias("ts_rank")).drop("n_tokens")


def newest_events(queries: DataFrame, root: str) -> DataFrame:
    """query_id, id, occurred_at, ts_rank (null) of the events that can be among the newest of queries without a text.

    The store's zones say which segments to read; each meets only the queries that need it.
    """
    spark = queries.sparkSession
    asked = queries.filter("query is null").select("query_id", "project", F.col("kind").alias("q_kind"), F.col("module").alias("q_module"), "since", "until")
    fits = (F.col("q_kind").isNull() | (F.col("q_kind") == F.col("kind"))) & (F.col("q_module").isNull() | (F.col("q_module") == F.col("module")))
    needed = held(stored_events.holding(stored_events.read_zones(spark, root), sent(asked), fits, TOP_K_MAX))
    few = [(r["batch"], r["segment"]) for r in needed.select("batch", "segment").distinct().limit(MOST_NAMED + 1).collect()]
    rows = stored_events.read_events(spark, root).select("batch", "segment", *stored_events.KEY)
    if len(few) <= MOST_NAMED:  # a hint to the reader, which the join makes exact
        rows = rows.filter(F.col("batch").isin([b for b, _ in few]) & F.col("segment").isin([s for _, s in few]))
    met = rows.join(sent(needed.join(asked, "query_id")), ["batch", "segment", "project"]).filter(_fits())
    return met.select("query_id", "id", "occurred_at", F.lit(None).cast("double").alias("ts_rank"))


def search_events(queries: DataFrame, events: DataFrame | None = None, root: str | None = None, log: str | None = None, client: str = "batch") -> DataFrame:
    """query_id, position, id, title, summary, kind, result, module, occurred_at (ISO), score: best first, newest first without a query.

    root: the events' store (sources.events); events that aren't stored are put into one for this batch.
    """
    spark = queries.sparkSession
    if root is None:
        root = shared_folder(spark)
        stored_events.append_events(events, root)
    accepted, _ = checked_event_queries(queries)
    words = held(event_words(accepted))
    matched = event_matches(stored_events.read_postings(spark, root, words), words)
    every = matched.unionByName(newest_events(accepted, root))
    limits = accepted.select("query_id", "project", F.coalesce("top_k", F.lit(TOP_K)).alias("k"))
    first = held(_first_events(every, TOP_K_MAX).join(limits, "query_id").filter("position <= k").select("query_id", "project", "id", "ts_rank", "position"))
    # At most TOP_K_MAX rows a query: the events are read once more for their texts and don't move.
    rows = stored_events.read_events(spark, root).join(sent(first), ["project", "id"])
    score = F.when(F.col("ts_rank").isNotNull(), F.round(1.0 / (RRF_K + F.col("position")), SCORE_DIGITS))
    rows = rows.select("query_id", "position", "id", "title", clip(F.col("summary")).alias("summary"), "kind", "result", "module", iso(F.col("occurred_at")).alias("occurred_at"), score.alias("score"))
    return _logged(rows, accepted, "search_events", client, ("kind", "module", "since", "until"), log, False)
