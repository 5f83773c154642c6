"""The stored index: immutable segments of what a batch changed, and numbered manifests that name the segments in force.

A segment holds whole documents, their chunks, their chunks' postings, and the keys of all documents that it writes or
deletes. A document's rows in a segment are void if a later segment names its key; readers leave them out (merge on read)
until a compaction does so for good. A manifest is created under its number or not at all, so a reader sees one whole
version, whatever is being written, and of two writers at once the later follows the earlier.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_text
from ..operators.postings import asked_buckets, postings, write_postings
from ..schemas import CHUNKS, DOCUMENTS

KEY = ["project", "repo", "path"]
TOUCHED = "project string, repo string, path string"
POSTINGS = "project string, repo string, path string, chunk_idx int, n_tokens int, term string, positions array<int>, bucket int"
SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS, "postings": POSTINGS, "touched": TOUCHED}
EMPTY = {"version": 0, "segments": []}


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list:
    p, fs = _path(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """The file with its whole text; False where it exists already. The rename is what makes it, so nobody sees a part."""
    target, fs = _path(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    whole = fs.makeQualified(target)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        context.rename(fs.makeQualified(draft), whole, how)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def versions(spark: SparkSession, root: str) -> list[int]:
    names = [str(s.getPath().getName()) for s in _children(spark, f"{root}/log")]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The last version of the index, or a stated one; version 0 has no segments."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if not version:
        return EMPTY
    p, fs = _path(spark, f"{root}/log/{version:020d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, segments: Callable[[dict, int], list[dict] | None]) -> dict:
    """The next manifest, of the segments that follow from the last one; tried again where another writer was faster.

    Where none follow, the last one stands.
    """
    while True:
        head = manifest(spark, root)
        following = segments(head, head["version"] + 1)
        if following is None:
            return head
        new = {"version": head["version"] + 1, "segments": following}
        if _create(spark, f"{root}/log/{new['version']:020d}.json", json.dumps(new)):
            return new


def _written(root: str, documents: DataFrame, chunks: DataFrame, touched: DataFrame, found: DataFrame | None = None) -> dict:
    """A segment's tables, and how many rows each has (from the files' footers)."""
    spark = documents.sparkSession
    name = uuid.uuid4().hex
    folder = f"{root}/segments/{name}"
    for table, rows in (("documents", documents), ("chunks", chunks)):
        rows.write.partitionBy("project").parquet(f"{folder}/{table}")
    touched.write.parquet(f"{folder}/touched")
    if found is None:
        stored = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
        found = postings(stored, search_text(F.col("heading_path"), F.col("content")), [*KEY, "chunk_idx"])
    write_postings(found, f"{folder}/postings")
    return {"name": name} | {t: spark.read.schema(s).parquet(f"{folder}/{t}").count() for t, s in SCHEMAS.items()}


def append_changes(documents: DataFrame, chunks: DataFrame, gone: DataFrame, root: str) -> dict:
    """A new version with these documents (each whole, with all its chunks) in place of their former state, without those gone.

    Written are these rows alone, whatever the index holds; no change makes no version. Returns the manifest.
    """
    spark = documents.sparkSession
    if documents.isEmpty() and gone.isEmpty():
        return manifest(spark, root)
    touched = documents.select(*KEY).unionByName(gone.select(*KEY)).distinct()
    segment = _written(root, documents, chunks, touched)
    return _commit(spark, root, lambda head, version: [*head["segments"], segment | {"version": version}])


def write_index(documents: DataFrame, chunks: DataFrame, root: str) -> dict:
    """A new version that holds these rows alone."""
    spark = documents.sparkSession
    segment = _written(root, documents, chunks, spark.createDataFrame([], TOUCHED))
    return _commit(spark, root, lambda _, version: [segment | {"version": version}])


def _table(spark: SparkSession, root: str, head: dict, table: str) -> DataFrame:
    """A table's rows of all segments, less those of documents that a later segment names."""
    read = lambda s, t: spark.read.schema(SCHEMAS[t]).parquet(f"{root}/segments/{s['name']}/{t}").withColumn("__version", F.lit(s["version"]).cast("long"))
    segments = head["segments"]
    if not segments:
        return spark.createDataFrame([], SCHEMAS[table])
    rows = reduce(DataFrame.unionByName, [read(s, table) for s in segments])
    if len(segments) == 1:
        return rows.drop("__version")
    # Keys of changes since the last compaction: few, next to the index; Spark broadcasts them where they are small.
    later = reduce(DataFrame.unionByName, [read(s, "touched") for s in segments[1:]]).groupBy(*KEY).agg(F.max("__version").alias("__last"))
    later = later.withColumnsRenamed({k: f"__{k}" for k in KEY})
    void = F.col("__last") > F.col("__version")
    for k in KEY:
        void = void & (F.col(k) == F.col(f"__{k}"))
    return rows.join(later, void, "left_anti").drop("__version")


def read_index(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of one version, the last if none is stated, whatever is written meanwhile."""
    head = manifest(spark, root, version)
    return _table(spark, root, head, "documents"), _table(spark, root, head, "chunks")


def read_postings(spark: SparkSession, root: str, asked: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """Postings of one version; with asked terms (project, term) only the folders that hold them are read."""
    rows = _table(spark, root, manifest(spark, root, version), "postings")
    return rows if asked is None else rows.filter(F.col("bucket").isin(asked_buckets(asked)))


def compact(spark: SparkSession, root: str) -> dict:
    """A version of one segment, without void rows, and what others append meanwhile. Old files stay for their readers.

    Where another compaction or write_index came first, its version stands.
    """
    head = manifest(spark, root)
    if len(head["segments"]) < 2:
        return head
    documents, chunks, found = (_table(spark, root, head, t) for t in ("documents", "chunks", "postings"))
    segment = _written(root, documents, chunks, spark.createDataFrame([], TOUCHED), found.drop("bucket")) | {"version": head["version"]}
    n = len(head["segments"])
    return _commit(spark, root, lambda now, _: [segment, *now["segments"][n:]] if now["segments"][:n] == head["segments"] else None)


def vacuum(spark: SparkSession, root: str, keep: int = 1, hours: float = 24.0) -> int:
    """Deletes segments that none of the last `keep` versions names and that are older than `hours`; returns how many."""
    known = versions(spark, root)
    used = {s["name"] for v in known[-keep:] for s in manifest(spark, root, v)["segments"]}
    before = (time.time() - hours * 3600) * 1000
    dead = [s.getPath() for s in _children(spark, f"{root}/segments") if s.getPath().getName() not in used and s.getModificationTime() < before]
    for path in dead:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    lost = {path.getName() for path in dead}
    for v in known[:-keep]:
        if any(s["name"] in lost for s in manifest(spark, root, v)["segments"]):
            p, fs = _path(spark, f"{root}/log/{v:020d}.json")
            fs.delete(p, False)  # a version whose segments are gone can't be read any more
    return len(dead)
