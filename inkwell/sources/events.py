"""The stored events: segments in order of time with zones that say what each holds, and postings of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import event_text
from ..operators.postings import asked_buckets, postings, write_postings

#: Events of a segment.
SEGMENT = 4096
#: What a posting of an event has beside its term: all that filters look at.
KEY = ["project", "id", "occurred_at", "kind", "module"]
ZONES = "batch int, segment bigint, project string, kind string, module string, first timestamp, last timestamp, n bigint"


def event_postings(events: DataFrame) -> DataFrame:
    return postings(events, event_text(F.col("title"), F.col("summary"), F.col("root_cause"), F.col("resolution")), KEY)


def append_events(events: DataFrame, root: str, batch: int = 0) -> None:
    """A batch of events (with ids) into the store; a batch that runs again replaces itself.

    The batch is dealt by ranges of project and time and cut into segments of SEGMENT rows; a zone is a segment's events
    of one project, kind and module, with their number and first and last time.
    """
    spark = events.sparkSession
    order = [F.col("project"), F.col("occurred_at"), F.col("id")]
    rows = events.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = rows.withColumn("__at", at).withColumn("segment", F.shiftleft(F.shiftright("__at", 33), 20) + F.floor(F.col("__at").bitwiseAND((1 << 33) - 1) / SEGMENT)).drop("__at")
    rows.write.mode("overwrite").parquet(f"{root}/segments/batch={batch}")
    held = spark.read.parquet(f"{root}/segments/batch={batch}")
    zones = held.groupBy("segment", "project", "kind", "module").agg(F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"), F.count(F.lit(1)).alias("n"))
    zones.write.mode("overwrite").parquet(f"{root}/zones/batch={batch}")
    write_postings(event_postings(held), f"{root}/postings/batch={batch}", overwrite=True)


def is_stored(spark: SparkSession, root: str) -> bool:
    """Whether a whole batch is there: its postings are written last."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/postings/batch=0/_SUCCESS")
    return bool(done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done))


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """All events, with the batch and segment that they are in."""
    return spark.read.parquet(f"{root}/segments")


def read_zones(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(ZONES).parquet(f"{root}/zones")


def read_postings(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """Postings from the folders that hold asked terms (project, term)."""
    return spark.read.parquet(f"{root}/postings").filter(F.col("bucket").isin(asked_buckets(asked)))


def holding(zones: DataFrame, asked: DataFrame, fits: Column, k: int) -> DataFrame:
    """query_id, batch, segment: the segments that can hold one of the newest k events of each query (query_id, project, since, until).

    Of zones that lie within the query's period all events count. Taken from the latest first time on, they have k
    events at some time; no event before it is among the newest k, so segments that end before it are left alone.
    """
    since, until = F.col("since"), F.col("until")
    met = zones.join(asked, "project").filter(fits & (since.isNull() | (F.col("last") >= since)) & (until.isNull() | (F.col("first") < until)))
    sure = F.when((since.isNull() | (F.col("first") >= since)) & (until.isNull() | (F.col("last") < until)), F.col("n")).otherwise(0)
    so_far = F.sum(sure).over(Window.partitionBy("query_id").orderBy(F.desc("first"), "batch", "segment", "kind", "module").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    enough = F.max(F.when(so_far >= k, F.col("first"))).over(Window.partitionBy("query_id"))
    return met.withColumn("enough", enough).filter(F.col("enough").isNull() | (F.col("last") >= F.col("enough"))).select("query_id", "batch", "segment").distinct()
