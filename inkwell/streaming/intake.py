"""Streams of the ledger: event intake, running repeat causes, incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest_into
from ..plans.ledger import EVENT_FIELDS, validate_events
from ..schemas import REPEAT_MIN
from ..sources.index import compact


#: Bits of an event's number within its batch; the batch's number stands above them.
ROW_BITS = 40


def numbered(rows: DataFrame, batch: int) -> DataFrame:
    """rows with an id that no other row of any batch has: the batch's number, then the row's place in the batch.

    The places run on from partition to partition by the partitions' sizes, of which there are as many as partitions.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())
    upto, starts = batch << ROW_BITS, []
    for part, n in sizes:
        starts.append((part, upto))
        upto += n
    offsets = spark.createDataFrame(starts, "__part int, __start bigint")
    return rows.join(F.broadcast(offsets), "__part").withColumn("id", F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def intake(submitted: DataFrame, accepted: str, rejected: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream of submissions into two tables. A batch that runs again overwrites its own folder, so no row comes twice;
    equal submissions stay separate events with ids of their own (numbered)."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, bad = validate_events(batch)
        good = numbered(good, number).select(*EVENT_FIELDS)
        good.write.mode("overwrite").parquet(f"{accepted}/batch_id={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch_id={number}")
        batch.unpersist()

    writer = submitted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def repeat_counts(events: DataFrame) -> DataFrame:
    """Running counts by cause for update mode; the state is one number a distinct cause, without lateness."""
    return events.filter("root_cause is not null").groupBy("project", "module", "root_cause").agg(F.count(F.lit(1)).alias("n"))


def repeats_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The causes that have recurred, a folder a batch: those whose count the batch changed, from the second event on.

    Nothing that is written is written again; a batch that runs again replaces its own folder. See current_repeats.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.filter(F.col("n") >= REPEAT_MIN).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return repeat_counts(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_repeats(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The causes that have recurred so far, or up to a batch, with their counts: of each the greatest, as counts only grow."""
    rows = spark.read.schema("project string, module string, root_cause string, n bigint, batch_id bigint").parquet(path)
    rows = rows if upto is None else rows.filter(F.col("batch_id") <= upto)
    return rows.groupBy("project", "module", "root_cause").agg(F.max("n").alias("n"))


def compact_repeats(spark: SparkSession, path: str, target: str) -> None:
    """The current counts as the first folder of a new table, which takes the place of one with very many batches."""
    current_repeats(spark, path).write.parquet(f"{target}/batch_id=-1")


def incremental(files: DataFrame, root: str, checkpoint: str, segments: int = 16) -> StreamingQuery:
    """New and changed files (project, path, content, mtime) into the index at root, a version a batch.

    A batch writes what it changes; where more than `segments` have gathered, they are made one. The stored hashes are
    the state: a batch that runs again changes nothing, and files whose text is as stored aren't parsed. Nothing is
    deleted, as a batch is a partial list.
    """

    def write(batch: DataFrame, _: int) -> None:
        # Of several versions of a file in one batch the latest counts.
        latest = batch.groupBy("project", "path").agg(F.max(F.struct("mtime", "content")).alias("v")).select("project", "path", "v.content", "v.mtime")
        listing = latest.select("project", "path", F.lit("file").alias("kind"), F.lit(True).alias("exact"))
        head, _ = ingest_into(root, latest, listing, whole=False)
        if len(head["segments"]) > segments:
            compact(batch.sparkSession, root)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
