"""Line dedup by a log-template tree: token count and leading tokens, then variable fields generalised."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .common import stored, tidy

#: Least share of constant positions in a template, in per cent of those without a digit.
CONSTANT = 75
#: A sentence within a line is looked at by itself from so many tokens on; shorter ones recur by chance. Lines of any
#: length are.
SENTENCE = 8
#: Bits of the filters that spare most lines outside shared leaves, and most that don't recur, from being handed on (2 MB
#: each, whatever the input; the joins behind them are exact).
FILTER = 1 << 24
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z\x80-\xff]")
_UNEVEN = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c", b" \n", b"\n ")
_PIECE = re.compile(rb".*?[.!?]+[\x20\t\x0b-\r]+|.+")
_SPACE = b" \t\x0b\x0c\r"


def sentences(line: bytes) -> list[bytes]:
    """The sentences of a line whose tokens are divided by single blanks: each ends with a token that ends with . ! or ?."""
    return line.replace(b". ", b".\n").replace(b"! ", b"!\n").replace(b"? ", b"?\n").split(b"\n")


def masked(words: bytes) -> bytes:
    """The words, those with a digit as <*>."""
    return b" ".join(b"<*>" if _DIGIT.search(w) else w for w in words.split(b" ")) if _DIGIT.search(words) else words


def evened(text: bytes) -> bytes:
    """The text with its lines' tokens divided by single blanks."""
    if text[:1] != b" " and text[-1:] != b" " and not any(x in text for x in _UNEVEN):
        return text
    return b"\n".join([b" ".join(line.split()) for line in text.split(b"\n")])


def _cuts(text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """The units of an evened text: number, where it starts in the text, its length there, and its masked tokens."""
    digits = _DIGIT.search(text) is not None
    letter, no, start = _LETTER.search, 0, 0
    for line in text.split(b"\n"):
        own = masked(line) if digits else line
        if letter(own):
            yield no, start, len(line), own
        no += 1
        if b". " in line or b"! " in line or b"? " in line:
            at, parts = start, sentences(line)
            for k, part in enumerate(parts, no):
                if part.count(b" ") >= SENTENCE - 1:
                    own = masked(part) if digits else part
                    if letter(own):
                        yield k, at, len(part), own
                at += len(part) + 1
            no += len(parts)
        start += len(line) + 1


def units(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Number and masked tokens, divided by blanks, of every line and every long enough sentence of lines with several.

    A line is numbered before its sentences. What has no letter outside masked tokens is no unit, but has its number.
    """
    return ((no, own) for no, _, _, own in _cuts(evened(text)))


def leaf_of(unit: bytes) -> int:
    """The leaf of a unit: by its token count and its leading tokens, as many as the count has binary digits.

    So short lines share a leaf by three tokens or fewer, and long ones seldom share one by chance, however many there are.
    """
    n = unit.count(b" ") + 1
    depth, end = n.bit_length(), -1
    if depth < n:
        for _ in range(depth):
            end = unit.find(b" ", end + 1)
        unit = unit[:end]
    return xxhash.xxh64_intdigest(b"%d " % n + unit)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _units(docs: DataFrame) -> DataFrame:
    """doc, key, and the numbers, hashes, leaves, places and lengths of all units of docs (doc, key, raw), as lists; even.

    even is the text in which the places are, so that units needn't be looked for again.
    """
    shape = docs.select("doc", "key").schema.add("no", ArrayType(IntegerType())).add("line", ArrayType(LongType())).add("leaf", ArrayType(LongType()))
    shape = shape.add("at", ArrayType(IntegerType())).add("size", ArrayType(IntegerType())).add("even", "binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, line, leaf, at, size, even, ends = [], [], [], [], [], [], [0]
            for raw in batch.column(2).to_pylist():
                text = evened(raw or b"")
                for i, start, length, own in _cuts(text):
                    no.append(i)
                    at.append(start)
                    size.append(length)
                    line.append(xxhash.xxh64_intdigest(own))
                    leaf.append(leaf_of(own))
                even.append(text)
                ends.append(len(no))
            values = (pa.array(no, pa.int32()), _longs(line), _longs(leaf), pa.array(at, pa.int32()), pa.array(size, pa.int32()))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(even, pa.binary())], names=shape.names)

    return docs.mapInArrow(tidy(task), shape)


def _found_in(held: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc, key, no, line of the units of _units whose hash has its bit set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, lines = batch.column(2), batch.column(3).flatten()
            slot = lines.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(FILTER)
            at = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            row = pa.array(np.repeat(np.arange(len(batch)), numbers.value_lengths().to_numpy(zero_copy_only=False))[at])
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), numbers.flatten().take(at), lines.take(at)], names=["doc", "key", "no", "line"])

    return held.select("doc", "key", "no", "line").mapInArrow(tidy(task), "doc bigint, key bigint, no int, line bigint")


def _tokens_in(held: DataFrame, bits: np.ndarray) -> DataFrame:
    """line, leaf, tokens (hashes, null for <*>) of the units of _units whose leaf's bit is set; mostly once a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            lines, leaves, starts, sizes = [batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(4)]
            slot = leaves.view(np.uint64) % np.uint64(FILTER)
            set_at = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            set_at = set_at[np.unique(lines[set_at], return_index=True)[1]]
            row = np.repeat(np.arange(len(batch)), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))[set_at]
            at, tokens, ends, texts = [], [], [0], batch.column(4)
            for k, name, r, start, size in zip(set_at.tolist(), lines[set_at].tolist(), row.tolist(), starts[set_at].tolist(), sizes[set_at].tolist(), strict=True):
                if name not in seen:
                    seen.add(name)
                    at.append(k)
                    own = masked(texts[r].as_buffer()[start : start + size].to_pybytes())
                    tokens += [None if t == b"<*>" else xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in own.split(b" ")]
                    ends.append(len(tokens))
            if len(seen) > 100_000:
                seen.clear()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int64()))
            chosen = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lines[chosen]), pa.array(leaves[chosen]), lists], names=["line", "leaf", "tokens"])

    return held.select("line", "leaf", "at", "size", "even").mapInArrow(tidy(task), "line bigint, leaf bigint, tokens array<bigint>")


def _filter_of(rows: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash in the column, as bytes; at most FILTER / 64 rows come to the driver."""
    slot = F.pmod(column, F.lit(FILTER))  # what the hash, unsigned, leaves modulo a power of two
    words = rows.select(F.shiftright(slot, 6).cast("int").alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bits = np.zeros(FILTER >> 6, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint8)


def _where_set(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows whose hash in the column has its bit set: all that an exact join with the filter's hashes keeps, and few others."""
    at = rows.columns.index(column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(FILTER)
            yield batch.filter(pa.array((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))

    return rows.mapInArrow(tidy(task), rows.schema)


def recurring_lines(held: DataFrame) -> DataFrame:
    """line, first: for each unit of a template that recurs across documents the first document that has it.

    held: the documents' units (_units). A leaf (leaf_of) holds the units of one token count and the same leading tokens. In a leaf of several
    documents, what stands at a position in two or more of them is constant, anything else a variable field, as are
    tokens with a digit. A template is its constants and the places of its fields; it counts where enough positions are
    constant. All sums are over distinct units and combine before the shuffle, so a leaf or unit of any size is dealt
    out. Only units that share a leaf with others, of other documents, are looked at token by token.
    """
    several = F.col("lo") != F.col("hi")
    span = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    each = held.select("key", F.explode(F.arrays_zip("line", "leaf")).alias("u")).select("key", "u.line", "u.leaf")
    distinct = each.groupBy("line", "leaf").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    distinct = stored(distinct, "lines-distinct")
    leaves = stored(distinct.groupBy("leaf").agg(*span, F.count(F.lit(1)).alias("n")).filter(several & (F.col("n") > 1)).select("leaf"), "lines-leaves")
    bits = _filter_of(leaves, "leaf")
    tokens = _tokens_in(held, bits).drop("leaf").dropDuplicates(["line"])
    shared = _where_set(distinct, "leaf", bits).join(leaves, "leaf", "left_semi")
    rows = stored(shared.join(tokens, "line"), "lines-shared")
    at = rows.select("line", "lo", "hi", F.posexplode("tokens").alias("at", "token"), "leaf").withColumn("value", F.when(F.col("token").isNotNull(), F.xxhash64("leaf", "at", "token")))
    constant = at.filter("value is not null").groupBy("value").agg(*span).filter(several).select("value", F.lit(1).alias("constant"))
    # Where a unit stands comes back once it is one row again; its tokens move without.
    placed = at.select("line", "at", "value")
    marked = placed.filter("value is not null").join(constant, "value", "left").unionByName(placed.filter("value is null").withColumn("constant", F.lit(None).cast("int")))
    held = F.when(F.col("constant").isNotNull(), F.col("value")).otherwise(F.xxhash64("at"))
    # Hashes of positions are combined by xor, which needs no order.
    named = marked.groupBy("line").agg(F.bit_xor(held).alias("template"), F.count("constant").alias("constants"), F.count("value").alias("positions"))
    named = named.filter(F.col("constants") * 100 >= F.col("positions") * CONSTANT).select("line", "template")
    named = stored(named.join(rows.select("line", "leaf", "lo", "hi"), "line"), "lines-named")
    first = named.groupBy("leaf", "template").agg(*span).filter(several).select("leaf", "template", F.col("lo").alias("first"))
    alike = named.join(first, ["leaf", "template"]).select("line", "first")
    # A unit that recurs as it is needs no look at its tokens; what resembles it may have come before it.
    found = distinct.filter(several).select("line", F.col("lo").alias("first")).unionByName(alike)
    return stored(found.groupBy("line").agg(F.min("first").alias("first")), "lines-found")


def without(text: bytes, gone: set[int]) -> tuple[bytes, int, int]:
    """The text without the numbered lines and sentences, and how many of either went.

    A short sentence goes with its neighbours: where the nearest units on both sides of it go, or all units of its line.
    """
    out, no, n_lines, n_cut = [], 0, 0, 0
    for line in text.split(b"\n"):
        me, parts = no, sentences(b" ".join(line.split()))
        several = len(parts) > 1
        no += 1
        dead = [several and no + k in gone for k in range(len(parts))]
        no += len(parts) * several
        if me in gone:
            n_lines += 1
            continue
        if not any(dead):
            out.append(line)
            continue
        big = [k for k, p in enumerate(parts) if p.count(b" ") >= SENTENCE - 1]
        everything = all(dead[k] for k in big)
        for k in set(range(len(parts))).difference(big):
            left = next((dead[j] for j in reversed(big) if j < k), everything)
            right = next((dead[j] for j in big if j > k), everything)
            dead[k] = left and right
        if all(dead):
            n_lines += 1
            continue
        n_cut += sum(dead)
        out.append(b"".join(p for p, d in zip(_PIECE.findall(line), dead, strict=True) if not d).rstrip(_SPACE))
    return b"\n".join(out), n_lines, n_cut


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text less the lines and sentences whose template an earlier document has.

    Added are n_lines, n_dropped (lines that went) and n_cut (sentences that went from lines that stay). Lines end at
    \\n, a line's sentences at a token with . ! or ? at its end. A recurring template stays in the document with the
    smallest key, where it was first; the others lose it. Repetitions within one document, lines without a letter and
    empty lines are left alone; a sentence within a line needs SENTENCE tokens, or goes with those around it.

    key is an integer column (else ValueError). Null texts stay null with n_lines 0, empty ones have one empty line;
    rows with a null key are one document, before all others (they share it with the least 64-bit key); repeated rows
    are treated alike; an empty table gives an empty result. Columns named like those added are replaced, others stay.
    """
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer column")
    added = ("n_lines", "n_dropped", "n_cut")
    keep = [c for c in docs.columns if c not in added]
    ident = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.xxhash64(ident, F.col(text)).alias("doc"), ident.alias("key"), F.col(text).cast("binary").alias("raw"))
    held = stored(_units(rows), "lines-units")
    found = recurring_lines(held)
    gone = _found_in(held, _filter_of(found, "line")).join(found, "line").filter(F.col("key") != F.col("first"))
    # The same lines of one document, or of rows repeated, come once.
    gone = gone.groupBy("doc").agg(F.collect_set("no").alias("__gone"))
    told = docs.select(*keep).withColumn("__doc", F.xxhash64(ident, F.col(text)))
    told = told.join(gone, F.col("__doc") == F.col("doc"), "left").select(*keep, "__gone")
    shape = docs.select(*keep).schema
    for name in added:
        shape = shape.add(name, "long")
    at = keep.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for raw, own in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True):
                n = 0 if raw is None else raw.count(b"\n") + 1
                new, *less = without(raw, set(own)) if own else (raw, 0, 0)
                texts.append(new)
                counts.append((n, *less))
            columns = [*batch.columns[: len(keep)], *(pa.array(list(c), pa.int64()) for c in zip(*counts, strict=True))] if counts else [*batch.columns[: len(keep)], *[pa.array([], pa.int64())] * 3]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return told.mapInArrow(tidy(task), shape)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the lines and sentences whose template an earlier document has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", "n_cut", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents less what recurs; those that consisted of it alone go."""
    out = deduplicated(docs)
    changed = F.col("n_dropped") + F.col("n_cut") > 0
    empty = changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.filter(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", n_chars).select(*docs.columns)


#: The same in DuckDB, with the strings themselves in place of hashes.
SQL = rf"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS a FROM documents
), lines AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS no FROM cut
), split AS (
  SELECT doc_id, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM lines
), masked AS (
  SELECT *, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM split
), words AS (
  SELECT doc_id, no, unnest(raw) AS w, unnest(t) AS m, unnest(range(len(raw))) AS i FROM masked
), ends AS (
  SELECT *, regexp_matches(lag(w) OVER (PARTITION BY doc_id, no ORDER BY i), '[.!?]$') AS starts FROM words
), sentences AS (
  SELECT doc_id, no, s, list(m ORDER BY i) AS t FROM (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, no ORDER BY i) AS s FROM ends) GROUP BY ALL
), several AS (
  SELECT *, len(t) >= {SENTENCE} AS big FROM sentences WHERE (doc_id, no) IN (SELECT (doc_id, no) FROM sentences WHERE s > 0)
), units AS (
  SELECT doc_id, no, -1 AS s, t, [CAST(len(t) AS VARCHAR)] || t[1:CAST(floor(log2(greatest(len(t), 1))) AS BIGINT) + 1] AS leaf FROM masked
  UNION ALL SELECT doc_id, no, s, t, [CAST(len(t) AS VARCHAR)] || t[1:CAST(floor(log2(greatest(len(t), 1))) AS BIGINT) + 1] FROM several WHERE big
), lettered AS (
  SELECT * FROM units WHERE regexp_matches(array_to_string(t, ' '), '[A-Za-z]|[^\x00-\x7F]')
), uniq AS (
  SELECT leaf, t, min(doc_id) AS lo, max(doc_id) AS hi FROM lettered GROUP BY ALL
), leaves AS (
  SELECT leaf FROM uniq GROUP BY leaf HAVING min(lo) <> max(hi)
), placed AS (
  SELECT leaf, t, lo, hi, unnest(t) AS part, unnest(range(len(t))) AS k FROM uniq JOIN leaves USING (leaf)
), constant AS (
  SELECT leaf, k, part FROM placed WHERE part <> '<*>' GROUP BY ALL HAVING min(lo) <> max(hi)
), named AS (
  SELECT p.leaf, p.t, list(CASE WHEN c.part IS NULL THEN '' ELSE '=' || c.part END ORDER BY p.k) AS template, min(lo) AS lo, max(hi) AS hi
  FROM placed p LEFT JOIN constant c ON p.leaf = c.leaf AND p.k = c.k AND p.part = c.part
  GROUP BY p.leaf, p.t HAVING count(c.part) * 100 >= count(CASE WHEN p.part <> '<*>' THEN 1 END) * {CONSTANT}
), firsts AS (
  SELECT leaf, template, min(lo) AS first FROM named GROUP BY ALL HAVING min(lo) <> max(hi)
), gone AS (
  SELECT DISTINCT doc_id, no, s FROM lettered JOIN named USING (leaf, t) JOIN firsts USING (leaf, template) WHERE doc_id <> first
), flagged AS (
  SELECT x.doc_id, x.no, x.s, big, g.s IS NOT NULL AS gone, CASE WHEN big THEN g.s IS NOT NULL END AS known FROM several x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.no = g.no AND x.s = g.s
), judged AS (
  SELECT *, coalesce(bool_and(known) OVER (PARTITION BY doc_id, no), false) AND bool_or(gone) OVER (PARTITION BY doc_id, no) AS everything,
    last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id, no ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(known IGNORE NULLS) OVER (PARTITION BY doc_id, no ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM flagged
), dead AS (
  SELECT doc_id, no, s, CASE WHEN big THEN gone ELSE coalesce(before, everything) AND coalesce(after, everything) END AS dead FROM judged
), edited AS (
  SELECT doc_id, no, bool_and(dead) AS whole, count(CASE WHEN dead THEN 1 END) AS n_cut, list(dead ORDER BY s) AS flags FROM dead GROUP BY ALL HAVING bool_or(dead)
), joined AS (
  SELECT l.doc_id, l.no, g.no IS NOT NULL OR coalesce(e.whole, false) AS dropped, CASE WHEN g.no IS NULL AND NOT e.whole THEN e.n_cut ELSE 0 END AS n_cut,
    CASE WHEN e.flags IS NULL THEN l.line ELSE regexp_replace(array_to_string(list_transform(list_filter(
      list_zip(regexp_extract_all(l.line, '.*?[.!?]+[\x20\x09\x0B-\x0D]+|.+'), e.flags), lambda p: NOT p[2]), lambda p: p[1]), ''), '[\x20\x09\x0B-\x0D]+$', '') END AS line
  FROM lines l LEFT JOIN (SELECT DISTINCT doc_id, no FROM gone WHERE s = -1) g ON l.doc_id = g.doc_id AND l.no = g.no LEFT JOIN edited e ON l.doc_id = e.doc_id AND l.no = e.no
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(CASE WHEN dropped THEN 1 END) AS BIGINT) AS n_dropped, CAST(sum(n_cut) AS BIGINT) AS n_cut,
  coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY no), '') AS text
FROM joined GROUP BY doc_id
"""
