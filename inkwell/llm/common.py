"""What the training-data operators share: word pattern, durable tables, salted joins."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator here: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_held: dict[Hashable, Any] = {}


def worker_held(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one object; asking for another lets go of the one before."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its worker gives free memory back: workers outlive tasks and share an executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A session that names none gets a fresh local folder if it runs in one process, as in tests; a cluster's raises
    ValueError, as a folder of one machine is lost to the others.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df behind a checkpoint: computed once, its lineage cut, lost executors harmless."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_count(df: DataFrame, such: Column | None = None) -> tuple[DataFrame, int]:
    """durable(df), and how many of its rows are `such`, counted on the way; after a lost executor it may be more."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1) if such is None else F.when(such, 1)).alias("n")))
    return out, seen.get["n"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed Parquet table in the shared folder, read again.

    For wide tables that later steps read in part: a checkpoint would hold whole rows uncompressed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_count(df: DataFrame, name: str, such: Column | None = None) -> tuple[DataFrame, int]:
    """stored(df, name), and how many of its rows are `such`, counted on the way; after a lost executor it may be more.

    For tables that loops join again and again: a checkpoint keeps its plan's estimated size, which joins multiply, so its
    digits would double with every turn and fill the driver. A table that is read again has its own.
    """
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1) if such is None else F.when(such, 1)).alias("n")), name)
    return out, seen.get["n"]


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column, salts: int = 32) -> DataFrame:
    """rows left-joined with facts (one row a key), null keys equal, a hot key dealt over `salts` partitions.

    facts is repeated once a salt, so it should be small next to rows; it needn't fit in memory.
    spread is any well-mixed integer column of rows.
    """
    salt, held = "__salt", [f"__k{i}" for i in range(len(keys))]
    left = rows.withColumn(salt, F.pmod(spread, F.lit(salts)).cast("int"))
    right = facts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.withColumnsRenamed(dict(zip(keys, held, strict=True))).withColumnRenamed(salt, "__s")
    on = left[salt] == right["__s"]
    for key, own in zip(keys, held, strict=True):
        on = on & left[key].eqNullSafe(right[own])
    return left.join(right, on, "left").drop(salt, "__s", *held)


def unit_hash(*cols: Column) -> Column:
    """A repeatable number in (0, 1) from the columns' text, the same in any engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
