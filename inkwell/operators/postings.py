"""Postings: for each term the rows that hold it, with its positions; stored in buckets, so that a batch of queries reads few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions.tokens import tokenize

#: Folders of a stored table of postings. A term of a project is in one of them.
BUCKETS = 32


def bucket() -> Column:
    return F.pmod(F.xxhash64("project", "term"), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """keys, n_tokens, term, positions (ascending, from 0): a row for each distinct token of each row; nothing moves."""
    shape = rows.select(*keys).schema.add("n_tokens", IntegerType()).add("term", StringType()).add("positions", ArrayType(IntegerType()))
    width = len(keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(width)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            key = row * max(1, len(coded.dictionary)) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]])) if len(key) else np.zeros(0, np.int64)
            at = order[first]
            spots = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(width)], pa.array(lengths[row[at]], pa.int32()), coded.dictionary.take(pa.array(code[at])), spots], names=shape.names)

    return rows.select(*keys, tokenize(text).alias("__t")).mapInArrow(task, shape)


def write_postings(found: DataFrame, path: str, overwrite: bool = False) -> None:
    """Postings (with project and term) by bucket, sorted by term; the rows of a hot bucket are split by size."""
    rows = found.withColumn("bucket", bucket()).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", "project", "term").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("bucket").parquet(path)


def asked_buckets(terms: DataFrame) -> list[int]:
    """The buckets that hold any of the terms (project, term): at most BUCKETS numbers."""
    return sorted(r["b"] for r in terms.select(bucket().alias("b")).distinct().collect())
