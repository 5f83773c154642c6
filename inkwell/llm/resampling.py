"""Importance resampling towards a target: bucketed feature odds, Gumbel scores, an exact cut-off by bisection."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, tidy, worker_held
from .words import SQL_WORDS, raw_texts, slices, words

#: Features are runs of 1 to so many words, counted in so many buckets.
NGRAMS, BUCKETS = 1, 10_000
#: Of the documents with so many words or more, so many per cent are drawn, by this seed.
LEAST_WORDS, SHARE, SEED = 20, 10, 2024
#: Thresholds that one counting job tries: four halvings.
PROBES = 15
#: Bytes of text that a task holds as words at once.
TEXT = 1 << 23
#: Words whose buckets a worker remembers.
REMEMBERED = 1 << 18
ADDED = ("n_features", "weight", "score", "rank")


class _Buckets(dict):
    """Feature -> bucket: its crc32 modulo the buckets."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        at = zlib.crc32(feature) % self.n
        if len(self) < REMEMBERED:
            self[feature] = at
        return at


def features(raw: bytes | None, most: int) -> Iterator[list[bytes]]:
    """All runs of 1 to `most` consecutive words of a text, joined by a blank; single words come first in each round."""
    tail: list[bytes] = []
    for piece in words(raw):
        yield piece
        for k in range(2, most + 1):
            run = tail[max(0, len(tail) - k + 1) :] + piece
            yield [b" ".join(run[i : i + k]) for i in range(len(run) - k + 1)]
        tail = (tail + piece)[-most + 1 :] if most > 1 else []


def bucket_counts(docs: DataFrame, text: str, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; every task hands on at most one row a bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = worker_held(("buckets", buckets), lambda: _Buckets(buckets)).__getitem__
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0, TEXT):
                for raw in raw_texts(part, 0):
                    for found in features(raw, ngrams):
                        total += np.bincount(np.fromiter(map(bucket, found), np.int64, len(found)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(tidy(task), "bucket int, n bigint")
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log odds of each bucket, smoothed by one, in floored thousandths."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """The document's Gumbel noise in floored thousandths, by its id alone; a null id is named null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, key: str, text: str, gains: np.ndarray, ngrams: int = NGRAMS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, n_features, weight, score, and whether the document has words enough to be drawn."""
    n_buckets = len(gains)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = worker_held(("buckets", n_buckets), lambda: _Buckets(n_buckets)).__getitem__
        for batch in batches:
            for part in slices(batch, 1, TEXT):
                n, weight, enough = [], [], []
                for raw in raw_texts(part, 1):
                    count = total = single = 0
                    for k, found in enumerate(features(raw, ngrams)):
                        count += len(found)
                        single += len(found) if k % ngrams == 0 else 0
                        total += int(gains[np.fromiter(map(bucket, found), np.int64, len(found))].sum())
                    n.append(count)
                    weight.append(total // count if count else 0)
                    enough.append(single >= least_words)
                score = [w + noise(d, seed) for w, d in zip(weight, part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in (n, weight, score)), pa.array(enough, pa.bool_())], names=["doc", "n_features", "weight", "score", "enough"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("raw"))
    return rows.mapInArrow(tidy(task), "doc bigint, n_features bigint, weight bigint, score bigint, enough boolean")


def threshold(rows: DataFrame, value: Column, wanted: int, lo: int, hi: int) -> tuple[int, int]:
    """The greatest x with at least `wanted` rows of value >= x, and how many rows lie above x.

    By bisection: each job counts exactly, at several thresholds between the bounds. At least `wanted` rows are >= lo,
    none is > hi.
    """
    above = 0
    while lo < hi:
        tried = sorted({lo + -(-(hi - lo) * i // (PROBES + 1)) for i in range(1, PROBES + 1)})
        counts = list(rows.agg(*[F.count(F.when(value >= x, 1)) for x in tried]).head())
        enough = [n >= wanted for n in counts]
        k = sum(enough)  # counts fall as thresholds rise
        if k < len(tried):
            hi, above = tried[k] - 1, counts[k]
        if k:
            lo = tried[k - 1]
    return lo, above


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `rank` from 1 in a total order: dealt by ranges, sorted there, each range counting on from those before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = stored(held, "ranges")  # so that ranges and numbers are those of one run
    part, no = F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(held.groupBy(part).count().collect())  # a row a range
    before, starts = 0, []
    for r, n in sizes:
        starts.append((r, before))
        before += n
    # A range's start comes from a literal map of as many entries as there are ranges.
    base = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.shiftright("__at", 33)] if starts else F.lit(0)
    return held.withColumn("rank", (base + no + 1).cast("long")).drop("__at")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """key, n_features, weight, score, rank of every document: rank 1, 2, 3, ... for the `share` per cent drawn, else null.

    A document's weight is the floored mean of its features' gains, which compare the bucket's share among the target's
    features with its share among all documents'. Its score adds Gumbel noise, so that the highest scores are a draw
    without replacement in proportion to the weights' odds. Scores are stored once; exact counts at bisected thresholds find
    the score that the last drawn document has, and among those of this score the last doc_id. Only drawn rows are sorted.

    key is an integer column (else ValueError). Null and empty texts have no features, weight 0 and can't be drawn;
    ties go to the smaller key, nulls last; repeated rows are each drawn or not, and rows equal in all are
    interchangeable. An empty table gives an empty result; without target or features gains come from the smoothing
    alone. Other columns, whatever their names, are not looked at.
    """
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer column")
    gains = gains_of(bucket_counts(docs, text, ngrams, buckets), bucket_counts(target, target_text, ngrams, buckets))
    rows = scored(docs, key, text, gains, ngrams, seed, least_words).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "scores")
    able = rows.filter("enough")
    n, lo, hi = able.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).head()
    wanted = share * n // 100
    names = [F.col("doc").alias(key), *ADDED]
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*names)
    cut, above = threshold(able, F.col("score"), wanted, lo, hi)
    drawn = F.col("enough") & (F.col("score") > cut)
    tied = able.filter(F.col("score") == cut)
    # Descending by the bits turned round: no overflow at either end.
    some, first, last = tied.agg(F.count("doc"), F.min("doc"), F.max("doc")).head()
    level = F.col("enough") & (F.col("score") == cut)
    if some >= wanted - above:
        end, _ = threshold(tied.filter("doc is not null"), F.bitwise_not("doc"), wanted - above, ~last, ~first)
        drawn = drawn | (level & F.coalesce(F.col("doc") <= ~end, F.lit(False)))
    else:
        drawn = drawn | level
    # Only rows with the last doc_id itself can be too many; their ranks say so.
    best = ranked(rows.filter(drawn), [F.desc("score"), F.asc_nulls_last("doc"), F.asc("n_features"), F.asc("row")])
    best = best.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return best.unionByName(rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))).select(*names)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them drawn towards the benchmark's words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_HALVED = "list_transform({0}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_TABLE = "range(256)"
for _ in range(8):
    _TABLE = _HALVED.format(_TABLE)
#: The same in DuckDB; crc32 by a table of 256 remainders, over the distinct words' hexadecimal bytes.
SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest({SQL_WORDS.format("text")}) AS w FROM documents
), wanted AS (
  SELECT unnest({SQL_WORDS.format("text")}) AS w FROM benchmark
), remainders AS (
  SELECT {_TABLE} AS t
), bytes AS (
  SELECT w, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: CAST(strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17 AS BIGINT)) AS b
  FROM (SELECT w FROM words UNION SELECT w FROM wanted)
), crc AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket FROM bytes, remainders
), s AS (
  SELECT bucket, count(*) AS n FROM words JOIN crc USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM wanted JOIN crc USING (w) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM words) AS big_s, (SELECT count(*) FROM wanted) AS big_t
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (big_s + {BUCKETS}.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * (big_t + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), sums AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM words JOIN crc USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), weights AS (
  SELECT doc_id, coalesce(n, 0) AS n, coalesce(CAST(floor(total / n) AS BIGINT), 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN sums USING (doc_id)
), scores AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weights
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, {SHARE} * count(*) OVER () // 100 AS k FROM scores WHERE n >= {LEAST_WORDS}
)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN r <= k THEN CAST(r AS BIGINT) END AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""
