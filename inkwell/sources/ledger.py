"""Ledger sources and sinks: event submissions, appended tables, runs, backup."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import EVENT_KEYS

#: What a run has only when it has ended.
RUN_RESULTS = {"finished_at": "timestamp", "files_seen": "bigint", "files_changed": "bigint", "files_deleted": "bigint", "chunks_upserted": "bigint", "error": "string"}


def _text(value: object, name: str) -> str | None:
    """A field of a submission as text: strings as they are, anything else, and any payload, as compact JSON."""
    if value is None:
        return None
    if isinstance(value, str) and name != "payload":
        return value.encode("utf-8", "replace").decode()
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text if text.isascii() or text.encode("utf-8", "ignore").decode() == text else json.dumps(value, separators=(",", ":"))


def submissions(lines: DataFrame) -> DataFrame:
    """Event fields as strings, and keys, of JSON objects in column `value`; what isn't an object has a single key ''.

    NaN and Infinity are read, for the checks to find; a line that is nested too deep to be read isn't an object.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                try:
                    body = json.loads(line) if line is not None else None
                    fields = [_text(body.get(k), k) for k in EVENT_KEYS] if isinstance(body, dict) else None
                except (ValueError, RecursionError):
                    fields = None
                known = fields is not None
                rows.append((*(fields if known else [None] * len(EVENT_KEYS)), [k.encode("utf-8", "replace").decode() for k in body] if known else [""]))
            columns = [pa.array(list(c), pa.string()) for c in list(zip(*rows, strict=True))[:-1]] if rows else [pa.array([], pa.string())] * len(EVENT_KEYS)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.list_(pa.string()))], names=[*EVENT_KEYS, "keys"])

    return lines.select("value").mapInArrow(task, ", ".join(f"{k} string" for k in EVENT_KEYS) + ", keys array<string>")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A batch of submissions, one JSON object a line."""
    return submissions(spark.read.text(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return submissions(spark.readStream.text(path))


def append(df: DataFrame, path: str, partition: str = "project") -> None:
    """Rows added to a table; repeated rows stay repeated."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def start_runs(projects: DataFrame, run_id: str, path: str) -> None:
    """A row `running` for each project, without counters; a run that dies leaves it as it is."""
    unknown = [F.lit(None).cast(kind).alias(name) for name, kind in RUN_RESULTS.items()]
    rows = projects.select("project", F.lit(run_id).alias("run_id"), F.current_timestamp().alias("started_at"), *unknown)
    append(rows.withColumn("status", F.lit("running")), path)


def append_run(run: DataFrame, path: str) -> None:
    """The finished rows of a run beside those that started it, in the same columns."""
    missing = {name: F.lit(None).cast(kind) for name, kind in RUN_RESULTS.items() if name not in run.columns}
    append(run.withColumns(missing).select("project", "run_id", "started_at", *RUN_RESULTS, "status"), path)


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row a project and run: the finished one, else the one that says it is running."""
    last = runs.withColumn("__n", F.row_number().over(Window.partitionBy("project", "run_id").orderBy(F.col("finished_at").desc_nulls_last())))
    return last.filter("__n = 1").drop("__n")


def backup_events(events: DataFrame, path: str) -> None:
    events.write.mode("errorifexists").parquet(path)


def restore_events(spark: SparkSession, backup: str, path: str) -> int:
    """The ledger from its backup into a new place, and its row count; an empty backup is refused."""
    events = spark.read.parquet(backup)
    if events.isEmpty():
        raise ValueError("the backup is empty")
    events.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).count()
