"""Ranked lexical search in reverse: documents stream through an inverted index over the items' terms."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, tidy
from .words import SQL_WORDS, raw_texts, slices, words

#: Hits that an item gets.
BEST = 10
#: (item, term) pairs of the index that a pass broadcasts (some 100 MB at most); further items take further passes.
PAIRS = 1 << 20
#: Sums that a task forms at once.
SUMS = 1 << 21
#: Bytes of text whose terms a task counts at once.
TEXT = 1 << 23


@dataclass
class Index:
    """Inverted index over a block of items: terms numbered from 0, for each the items that hold it."""

    items: list
    terms: dict[bytes, int]
    starts: np.ndarray
    held_by: np.ndarray


def blocks(items: DataFrame, item: str, text: str, most: int = PAIRS) -> Iterator[Index]:
    """Indexes over all items, each of at most `most` (item, term) pairs, or one item; rows with the same id are one item.

    Pairs come to the driver in the items' order, a block at a time.
    """
    shape = items.select(F.col(item).alias("item")).schema.add("term", "binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, TEXT):
                own = [list(set().union(*words(raw))) for raw in raw_texts(part, 1)]
                take = np.repeat(np.arange(len(own)), [len(t) for t in own])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take)), pa.array([t for ts in own for t in ts], pa.binary())], names=["item", "term"])

    pairs = items.select(F.col(item).alias("item"), F.col(text)).mapInArrow(tidy(task), shape).distinct().orderBy("item", "term")
    ids: list = []
    terms: dict[bytes, int] = {}
    rows: list[tuple[int, int]] = []

    def made() -> Index:
        at = np.array(rows, np.int64).reshape(-1, 2)
        at = at[np.lexsort((at[:, 1], at[:, 0]))]
        return Index(list(ids), dict(terms), np.searchsorted(at[:, 0], np.arange(len(terms) + 1)), at[:, 1])

    for row in pairs.toLocalIterator():
        if not ids or row["item"] != ids[-1]:
            if len(rows) >= most:
                yield made()
                ids, terms, rows = [], {}, []
            ids.append(row["item"])
        rows.append((terms.setdefault(bytes(row["term"]), len(terms)), len(ids) - 1))
    if rows:
        yield made()


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc, n (its terms with repeats), and the numbers and counts of its terms in the vocabulary; docs: doc, raw."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for part in slices(batch, 1, TEXT):
                n, at, count, ends = [], [], [], [0]
                for raw in raw_texts(part, 1):
                    total, own = 0, []
                    for piece in words(raw):
                        total += len(piece)
                        ids = np.fromiter(map(get, piece, repeat(-1)), np.int32, len(piece))
                        own.append(ids[ids >= 0])
                    ids, times = np.unique(np.concatenate(own) if own else np.zeros(0, np.int32), return_counts=True)
                    n.append(total)
                    at.append(ids)
                    count.append(times)
                    ends.append(ends[-1] + len(ids))
                flat = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(np.int32))) for x in (at, count)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *flat], names=["doc", "n", "terms", "times"])

    return docs.mapInArrow(tidy(task), "doc bigint, n bigint, terms array<int>, times array<int>")


def _searched(docs: DataFrame, index: Index, kind: pa.DataType, shape, best: int) -> DataFrame:
    """item, doc, score: for each item of the index the best documents of every task."""
    counts = stored(term_counts(docs, index.terms), "term-counts")
    n_docs, length = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).head()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most a row a term
    df = np.zeros(len(index.terms), np.int64)
    df[held["term"].to_numpy()] = held["count"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((index.items, index.starts, index.held_by, weight))
    last = np.iinfo(np.int64).max

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, held_by, w = shared.value
        n_items, fan = len(items), np.diff(starts)
        heaps: list[list[tuple]] = [[] for _ in items]
        least, least_doc = np.ones(n_items, np.int64), np.full(n_items, last)
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            term, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            ends = ends - ends[0]
            m = np.array([10 + 90 * n * n_docs // length if length else 10 for n in batch.column(1).to_pylist()], np.int64)
            adds = w[term] * (10**9 * tf // (1000 * tf + 8 * m[row]))
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(0).fill_null(last).to_numpy(zero_copy_only=False)
            work = np.cumsum(np.bincount(row, fan[term], len(batch)).astype(np.int64) + n_items)
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + SUMS, "right")))
                pairs = slice(ends[a], ends[b])
                # Every shared term of these documents, once for each item that holds it.
                own = fan[term[pairs]]
                first = np.cumsum(own) - own
                at = np.repeat(starts[term[pairs]] - first, own) + np.arange(own.sum())
                sums = np.zeros((n_items, b - a), np.int64)
                np.add.at(sums, (held_by[at], np.repeat(row[pairs] - a, own)), np.repeat(adds[pairs], own))
                better = (sums > least[:, None]) | ((sums == least[:, None]) & (doc[a:b] <= least_doc[:, None]))
                for i in np.flatnonzero(better.any(axis=1)).tolist():
                    who = np.flatnonzero(better[i])
                    who = who[np.lexsort((doc[a:b][who], nulls[a:b][who], -sums[i, who]))[:best]]
                    for score, d, null in zip(sums[i, who].tolist(), doc[a:b][who].tolist(), nulls[a:b][who].tolist(), strict=True):
                        entry = (score, not null, -d)
                        if len(heaps[i]) < best:
                            heapq.heappush(heaps[i], entry)
                        elif entry > heaps[i][0]:
                            heapq.heapreplace(heaps[i], entry)
                        else:
                            break
                    if len(heaps[i]) == best:
                        least[i], least_doc[i] = heaps[i][0][0], -heaps[i][0][2]
                a = b
        rows = [(items[i], -d if known else None, score) for i, heap in enumerate(heaps) for score, known, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.int64()), strict=True)], names=["item", "doc", "score"])

    return counts.mapInArrow(tidy(task), shape)


def best_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = BEST, pairs: int = PAIRS) -> DataFrame:
    """item, rank, key, score: for each item the `best` documents by a saturating weight of shared terms, whole texts on both sides.

    Every document's term counts go once through an inverted index over the items' terms, which is broadcast in blocks of
    bounded size; each task keeps a heap of bounded size for each item, and the heaps are merged in two steps. Ranks run
    from 1; equal scores come by ascending key, null keys last. Scores of 0 have no rank.

    key is an integer column (else ValueError). Documents without terms (null, empty) count nowhere; repeated rows are
    documents of their own. Items without terms have no rows; rows with the same item id, null too, are one item with
    the terms of all. Empty tables give an empty result. Other columns, whatever their names, are not looked at.
    """
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer column")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("raw"))
    shape = items.select(F.col(item).alias("item")).schema.add("doc", "long").add("score", "long")
    kind = to_arrow_type(shape["item"].dataType)
    found = docs.sparkSession.createDataFrame([], shape)
    for index in blocks(items, item, item_text, pairs):
        found = found.unionByName(_searched(rows, index, kind, shape, best))
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    local = F.row_number().over(Window.partitionBy("item", "__part").orderBy(*order))
    first = found.withColumn("__part", F.pmod(F.xxhash64("doc"), F.lit(64))).withColumn("__n", local).filter(F.col("__n") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return best_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL = f"""
WITH words AS (
  SELECT doc_id, unnest({SQL_WORDS.format("text")}) AS t FROM documents
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths
), counts AS (
  SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL
), asked AS (
  SELECT DISTINCT item_id, unnest({SQL_WORDS.format("text")}) AS t FROM benchmark
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY t, big_n
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id), totals GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {BEST}
"""
