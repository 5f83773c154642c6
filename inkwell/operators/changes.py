"""Change detection between a scan and the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RULES_VERSION


def changes(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """project, path, change: new, changed, rules_stale, unchanged or deleted.

    scan: project, path, content_hash; stored: also rules_version. Only these narrow columns are joined.
    """
    s = stored.select("project", "path", F.col("content_hash").alias("stored_hash"), "rules_version")
    rows = scan.select("project", "path", "content_hash").join(s, ["project", "path"], "full_outer")
    change = (
        F.when(F.col("content_hash").isNull(), "deleted")
        .when(F.col("stored_hash").isNull(), "new")
        .when(F.col("content_hash") != F.col("stored_hash"), "changed")
        .when(F.col("rules_version") != RULES_VERSION, "rules_stale")
        .otherwise("unchanged")
    )
    return rows.select("project", "path", change.alias("change"))


def deletable(stored: DataFrame, keep: DataFrame, links: DataFrame) -> DataFrame:
    """Stored rows whose path is neither kept (indexed, or skipped by its exact name) nor below a link.

    A path is below a link if one of its directories is one, so the test is an equality join on its prefixes.
    """
    gone = stored.join(keep.select("project", "path").distinct(), ["project", "path"], "left_anti")
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = gone.select("project", "path", F.explode(up).alias("__dir")).join(links.select("project", F.col("path").alias("__dir")), ["project", "__dir"], "left_semi")
    return gone.join(below.select("project", "path").distinct(), ["project", "path"], "left_anti")


def run_counters(change: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """project, files_seen, files_changed, files_deleted, chunks_upserted; a rebuild for new rules counts chunks, not files."""
    is_a = lambda *k: F.count(F.when(F.col("change").isin(*k), 1))
    files = change.groupBy("project").agg(is_a("new", "changed", "rules_stale", "unchanged").alias("files_seen"), is_a("new", "changed").alias("files_changed"), is_a("deleted").alias("files_deleted"))
    made = new_chunks.groupBy("project").agg(F.count(F.lit(1)).alias("chunks_upserted"))
    return files.join(made, "project", "left").withColumn("chunks_upserted", F.coalesce("chunks_upserted", F.lit(0)))
