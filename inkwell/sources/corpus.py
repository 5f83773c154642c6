"""Corpus sources: Markdown trees, listings and which of their paths are indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SKIPPED_DIRS


def in_index_paths(path: Column) -> Column:
    return path.startswith("docs/") | path.startswith("adr/") | path.rlike("(?i)^README[^/]*$")


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, mtime of the Markdown files below root that belong to the index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    # Spark reports qualified locations; what follows the qualified root is the path, whatever names recur in it.
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    qualified = str(top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()).rstrip("/")
    path = F.substring(F.col("path"), F.lit(len(qualified) + 2), F.length("path"))
    rows = files.select(path.alias("path"), "content", F.col("modificationTime").alias("mtime"))
    return rows.filter(in_index_paths(F.col("path")) & ~in_skipped_dir(F.col("path")))


def classify_listing(listing: DataFrame) -> DataFrame:
    """listing with an outcome in place of its kind: `indexed`, or why a path is skipped; paths outside the index are left out.

    A link is judged first, as itself or as a directory, so that what stood below it is kept.
    """
    path, kind = F.col("path"), F.col("kind")
    link = (kind == "link") & (in_index_paths(path) | in_index_paths(F.concat(path, F.lit("/"))))
    outcome = F.when(link, "symlink").when(~in_index_paths(path) | (kind == "link"), None).when(~path.endswith(".md"), "not-md").when(kind != "file", "not-regular").otherwise("indexed")
    return listing.filter(~in_skipped_dir(path)).withColumn("outcome", outcome).drop("kind").filter("outcome is not null")
