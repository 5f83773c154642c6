"""Event statistics and index status."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..schemas import MODULE_LIMIT, REPEAT_LIMIT, REPEAT_MIN


def in_scope(events: DataFrame, module: str | None = None, since: datetime.datetime | None = None) -> DataFrame:
    """Events of a module (blank: all) from `since` on."""
    if module and module.strip():
        events = events.filter(F.col("module") == module.strip())
    return events.filter(F.col("occurred_at") >= F.lit(since)) if since else events


def stats_head(events: DataFrame) -> DataFrame:
    """project, total, avg_resolution_seconds: half away from zero; null where nothing is resolved."""
    took = F.unix_micros("resolved_at") - F.unix_micros("occurred_at")
    return events.groupBy("project").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(took) / 1e6).cast("long").alias("avg_resolution_seconds"))


def counts_by(events: DataFrame, field: str) -> DataFrame:
    """project, value, n."""
    return events.groupBy("project", F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def module_counts(events: DataFrame, limit: int = MODULE_LIMIT) -> DataFrame:
    """project, value, n, position, omitted: the most frequent modules, and how many are left out."""
    n = counts_by(events.filter("module is not null"), "module")
    of = Window.partitionBy("project")
    n = n.withColumns({"position": F.row_number().over(of.orderBy(F.desc("n"), "value")), "omitted": F.greatest(F.count(F.lit(1)).over(of) - limit, F.lit(0))})
    return n.filter(F.col("position") <= limit)


def repeat_causes(events: DataFrame, least: int = REPEAT_MIN, limit: int | None = REPEAT_LIMIT) -> DataFrame:
    """project, module, root_cause, n, position: causes that recur in a module (null is one); limit None gives all candidates."""
    n = events.filter("root_cause is not null").groupBy("project", "module", "root_cause").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    if limit is None:
        return n
    order = Window.partitionBy("project").orderBy(F.desc("n"), "root_cause", F.col("module").asc_nulls_last())
    return n.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def event_stats(events: DataFrame, module: str | None = None, since: datetime.datetime | None = None) -> DataFrame:
    """One row a project: head, by_kind, by_result, by_module (ordered), by_module_omitted, repeat_causes (ordered)."""
    e = in_scope(events, module, since)
    as_map = lambda f, name: counts_by(e, f).groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(name))
    modules = module_counts(e).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("position", "value", "n"))).alias("by_module"), F.max("omitted").alias("by_module_omitted"))
    causes = repeat_causes(e).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("position", "root_cause", "module", "n"))).alias("repeat_causes"))
    out = stats_head(e)
    for part in (as_map("kind", "by_kind"), as_map("result", "by_result"), modules, causes):
        out = out.join(part, "project", "left")
    return out.withColumn("by_module_omitted", F.coalesce("by_module_omitted", F.lit(0)))


def kb_status(projects: DataFrame, documents: DataFrame, chunks: DataFrame, events: DataFrame, runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Six figures for each requested project; zeros (and no time) for an unknown one."""
    n = lambda df, name: df.groupBy("project").agg(F.count(F.lit(1)).alias(name))
    vectors = chunks.groupBy("project").agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("chunks_without_embedding"))
    last = runs.filter(F.col("status").isin("ok", "partial")).groupBy("project").agg(F.max("finished_at").alias("last_ingest_at"))
    zero = logs.filter("hit_count = 0")
    out = projects.select(blank_to_null(F.col("project")).alias("project")).distinct()
    for part in (n(documents, "documents"), vectors, n(events, "events"), last, n(zero, "zero_hit_queries")):
        out = out.join(part, "project", "left")
    return out.fillna(0, ["documents", "chunks", "chunks_without_embedding", "events", "zero_hit_queries"])
