"""Benchmark decontamination by suffix arrays of the training documents, in shards that every test suffix is looked up in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, tidy
from .words import SQL_WORDS, raw_texts, slices, words

#: Words of a window: a document's match with an item counts from so many words on, or the whole of a shorter item.
WINDOW = 10
#: Words of items that one pass broadcasts (some 100 MB at most); further items take further passes.
BLOCK = 1 << 20
#: Bytes of text in a shard, or one document.
SHARD = 1 << 22
#: Matching places that a task holds at once, or those of one item in a shard.
PLACES = 1 << 21
ADDED = ("n_words", "matches", "n_hit", "n_items", "items_sha256", "contaminated")
MATCHES = "array<struct<item:string,item_start:bigint,start:bigint,length:bigint>>"


@dataclass
class Tests:
    """A block of test items: words numbered from 1, all items' words with a 0 after each, and what starts a window."""

    items: list[str]
    numbers: dict[bytes, int]
    words: np.ndarray
    pairs: np.ndarray  # which words follow which, as first * (count + 1) + second, in order
    starts: np.ndarray
    sizes: np.ndarray
    item: np.ndarray
    item_start: np.ndarray


def tests_of(rows: Iterator[tuple[str, bytes | None]], window: int, most: int) -> Iterator[Tests]:
    """The items (name, text) in blocks of about `most` words."""
    items: list[str] = []
    numbers: dict[bytes, int] = {}
    texts: list[np.ndarray] = []

    def made() -> Tests:
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([np.append(t, np.int32(0)) for t in texts]).astype(np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        size = np.minimum(lengths, window)
        count = lengths - size + 1
        item = np.repeat(np.arange(len(texts)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.unique((flat[:-1] * (len(numbers) + 1) + flat[1:])[(flat[:-1] > 0) & (flat[1:] > 0)])
        return Tests(list(items), dict(numbers), flat, pairs, first[item] + at, size[item], item, at)

    held = 0
    for name, raw in rows:
        own = [numbers.setdefault(w, len(numbers) + 1) for piece in words(raw) for w in piece]
        if own:
            items.append(name)
            texts.append(np.array(own, np.int32))
            held += len(own)
        if held >= most:
            yield made()
            items, numbers, texts, held = [], {}, [], 0
    if texts:
        yield made()


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of text that don't hold 0, ordered by the words that follow, to `depth` words at least.

    Prefix doubling: ranks of twice as many words from pairs of ranks. A 0 comes before all else.
    """
    at = np.flatnonzero(text)
    rank, order, known = text.astype(np.int64), np.argsort(text[at], kind="stable"), 1
    while known < depth and len(at):
        after = np.zeros(len(text), np.int64)
        after[: max(0, len(text) - known)] = rank[known:]
        key = rank[at] * (int(rank.max()) + 1) + after[at]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]]).cumsum()
        rank = np.zeros(len(text), np.int64)
        rank[at[order]] = new
        known *= 2
        if new[-1] == len(at):
            break
    return at[order]


def _bisected(text: np.ndarray, places: np.ndarray, shift: int, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Where each word belongs within its stretch lo to hi of the suffix array, by the word `shift` places on."""
    lo, hi = lo.copy(), hi.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) >> 1
        there = text[places[mid] + shift]
        up = there <= word[live] if right else there < word[live]
        lo[live[up]] = mid[up] + 1
        hi[live[~up]] = mid[~up]
    return lo


def looked_up(tests: Tests, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix that starts a window the stretch of the suffix array that begins with the window; empty if none."""
    lo, hi = np.zeros(len(tests.starts), np.int64), np.full(len(tests.starts), len(places), np.int64)
    for shift in range(int(tests.sizes.max(initial=0))):
        live = np.flatnonzero((tests.sizes > shift) & (lo < hi))
        word = tests.words[tests.starts[live] + shift]
        low = _bisected(text, places, shift, word, lo[live], hi[live], False)
        hi[live] = _bisected(text, places, shift, word, low, hi[live], True)
        lo[live] = low
    return lo, hi


def shard_matches(tests: Tests, ids: np.ndarray, window: int) -> np.ndarray:
    """item, item_start, start, length of all longest matches in a shard: its documents' word numbers, a 0 after each.

    A word that no item has, or that follows a word in no item, ends a match; so the array is built over the stretches
    between such places, if they are long enough for a window.
    """
    follows = np.concatenate([[False], np.isin(ids[:-1] * (len(tests.numbers) + 1) + ids[1:], tests.pairs) & (ids[:-1] > 0) & (ids[1:] > 0)]) if len(ids) else np.zeros(0, bool)
    begins = np.flatnonzero((ids > 0) & ~follows)
    stops = np.flatnonzero((ids > 0) & ~np.append(follows[1:], False)) + 1 if len(ids) else begins
    enough = stops - begins >= int(tests.sizes.min(initial=window))
    begins, sizes = begins[enough], (stops - begins)[enough]
    at = np.arange((sizes + 1).sum()) - np.repeat(np.cumsum(sizes + 1) - sizes - 1 - begins, sizes + 1)  # a stretch and the place after it
    text = ids[at]
    text[np.cumsum(sizes + 1) - 1] = 0
    text = np.append(text, np.zeros(window, text.dtype))
    places = suffix_array(text, window)
    lo, hi = looked_up(tests, text, places)
    hits = np.flatnonzero(lo < hi)
    count = (hi - lo)[hits]
    # Items by items, so many that their places are few enough; one after another in an item are one longer match.
    out, done = [np.zeros((0, 4), np.int64)], 0
    owner, total = tests.item[hits], np.cumsum(count)
    while done < len(hits):
        end = max(int(np.searchsorted(total, (total[done - 1] if done else 0) + PLACES, "right")), done + 1)
        end = int(np.searchsorted(owner, owner[end - 1], "right"))
        own, n = hits[done:end], count[done:end]
        place = places[np.repeat(lo[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        item, item_start, size = (np.repeat(x[own], n) for x in (tests.item, tests.item_start, tests.sizes))
        order = np.lexsort((item_start, place - item_start, item))
        item, item_start, place, size = item[order], item_start[order], place[order], size[order]
        goes_on = (item[1:] == item[:-1]) & (place[1:] == place[:-1] + 1) & (item_start[1:] == item_start[:-1] + 1)
        first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        length = np.diff(np.append(first, len(item))) - 1 + size[first]
        out.append(np.stack([item[first], item_start[first], at[place[first]], length], axis=1))
        done = end
    return np.concatenate(out)


def _passed(docs: DataFrame, text: str, tests: Tests, window: int) -> DataFrame:
    """docs with n_words, and the block's matches added to `matches`."""
    shape, at = docs.schema, docs.columns.index(text)
    has, words_at = docs.columns.index("matches"), docs.columns.index("n_words")
    shared = docs.sparkSession.sparkContext.broadcast(tests)
    fields = ["item", "item_start", "start", "length"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        get, names = t.numbers.get, np.array(t.items, object)
        for batch in batches:
            for part in slices(batch, at, SHARD):
                ids, lengths = [], []
                for raw in raw_texts(part, at):
                    own = [np.fromiter(map(get, piece, repeat(0)), np.int64, len(piece)) for piece in words(raw)]
                    lengths.append(sum(map(len, own)))
                    ids += [*own, np.zeros(1, np.int64)]
                n = np.array(lengths, np.int64)
                first = np.cumsum(n + 1) - n - 1
                found = shard_matches(t, np.concatenate(ids), window)
                doc = np.searchsorted(first, found[:, 2], "right") - 1
                found[:, 2] -= first[doc]
                order = np.lexsort((found[:, 3], found[:, 2], found[:, 0], doc))
                doc, found = doc[order], found[order]
                before = part.column(has)
                parts = [pa.array(names[found[:, 0]].tolist(), pa.string()), *(pa.array(found[:, i]) for i in (1, 2, 3))]
                made = pa.StructArray.from_arrays(parts, names=fields)
                ends = np.searchsorted(doc, np.arange(len(n) + 1))
                matches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)
                if pa.compute.any(pa.compute.greater(pa.compute.list_value_length(before), 0)).as_py():
                    matches = pa.array([a + b for a, b in zip(before.to_pylist(), matches.to_pylist(), strict=True)], matches.type)
                columns = list(part.columns)
                columns[has], columns[words_at] = matches, pa.array(n)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(tidy(task), shape)


def _covered(matches: Column) -> Column:
    """Words in the union of the matches' spans."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).cast("long").alias("n"))
    return F.aggregate(spans, zero, step)["n"]


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with n_words, matches, n_hit, n_items, items_sha256 and contaminated: what of the items stands verbatim in a document.

    Whole documents are dealt to shards as they are read; a shard's suffix array is built over its words, and every test
    suffix that starts a window is binary-searched in it. matches are the longest common stretches of `window` words or
    more (or of a whole shorter item), with the item, its place there and its place here, in words from 0. n_hit counts
    the words inside any of them, n_items the items, items_sha256 hashes their ids as sorted strings. Items are
    broadcast in blocks of bounded size; beyond one block the documents are stored between the passes.

    Null and empty texts have no words and no matches; items without words are never found; items with a null id count
    as one, named by an empty string; items with the same id are one item; repeated documents are each marked. Empty
    tables give empty results, or no matches. Columns of docs named like those added are replaced, others stay.
    """
    keep = [c for c in docs.columns if c not in ADDED]
    out = docs.select(*keep, F.lit(0).cast("long").alias("n_words"), F.array().cast(MATCHES).alias("matches"))
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("binary").alias("raw"))
    # Without items the words are counted all the same.
    none = Tests([], {}, *[np.zeros(0, np.int64)] * 6)
    passes = 0
    for tests in tests_of(((r["name"], bytes(r["raw"]) if r["raw"] is not None else None) for r in rows.toLocalIterator()), window, block):
        out = _passed(stored(out, "passed") if passes else out, text, tests, window)
        passes += 1
    out = out if passes else _passed(out, text, none, window)
    names = F.array_sort(F.array_distinct("matches.item"))
    return out.withColumns({
        "n_hit": _covered(F.col("matches")), "n_items": F.size(names).cast("long"), "items_sha256": F.sha2(F.array_join(names, ","), 256), "contaminated": F.size("matches") > 0,
    })


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without those that hold any window of any item (see marked), in docs' own columns."""
    return marked(docs.withColumn("__row", F.struct(*docs.columns)), items, **how).filter(~F.col("contaminated")).select("__row.*")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark stands in each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = f"""
WITH d AS (
  SELECT doc_id, {SQL_WORDS.format("text")} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS.format("text")} AS w FROM benchmark
), cut AS (
  SELECT item, w, least(len(w), {WINDOW}) AS size FROM b WHERE len(w) > 0
), places AS (
  SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM cut
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM places
), texts AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), spots AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM texts
), hits AS (
  SELECT doc_id, item, size, i FROM spots JOIN windows USING (size, s)
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
