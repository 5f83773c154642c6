"""Near duplicates by min-max hashing: banded signatures find candidates, full shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import stored, stored_count, tidy

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 75
#: Permutations and bands. Each permutation gives its minimum and its maximum, so a band of two permutations has four
#: values: texts at a similarity of 0.75 meet in one of 32 bands but for 5 in a million.
PERMUTATIONS, BANDS = 64, 32
#: Rounds in which buckets that still hold several components get another pivot, before the exact rest.
ROUNDS = 2
#: Parts over which a pivot's pairs are dealt.
SALTS = 32
#: Labels or links that are sent to all tasks of a join (some 10 MB); more of them move with the other side.
SENT = 50_000
#: Slots of the frequency sketch by which the exact rest orders shingles (1 MB, whatever the input).
SLOTS = 1 << 20

_rng = np.random.default_rng(75)
_STEP = _rng.integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_BAND = _rng.integers(1, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle(text: bytes | None) -> np.ndarray:
    """A text's sorted distinct 64-bit shingle hashes."""
    # bytes.lower and bytes.split touch A-Z and ASCII white space only, as the words are defined.
    words = (text or b"").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not words:
        return h
    if len(h) < SHINGLE:
        return _mix(np.array([(h * _STEP[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + n] * _STEP[k]
    return np.unique(_mix(total))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def min_max_bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of the minima and maxima of two permutations of the set."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[None, at : at + 4096] ^ _FLIP[:, None]) * _MULTIPLY[:, None]
        low, high = np.minimum(low, part.min(axis=1)), np.maximum(high, part.max(axis=1))
    values = np.stack([low, high], axis=1).reshape(BANDS, 4)
    return _mix((values * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signatures(docs: DataFrame) -> DataFrame:
    """Other columns, n_shingles, cls (16 bytes that name the set; null for an empty one) and bands of docs (.., raw last)."""
    shape = docs.drop("raw").schema.add("n_shingles", "long").add("cls", "binary").add("bands", ArrayType(LongType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, names, bands = [], [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                s = shingle(raw)
                sizes.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(min_max_bands(s) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            values = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists], names=shape.names)

    return docs.mapInArrow(tidy(task), shape)


def _class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, raw: a text for each wanted class (cls, id of a document that has it); docs: id, raw."""
    return stored(docs.join(wanted, "id").select("cls", "raw").dropDuplicates(["cls"]), "neardup-texts")


def _held(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows, computed once and read again in parts of some SENT rows, and their number."""
    out, n = stored_count(rows, "neardup-held")
    return out.coalesce(1 + n // SENT), n


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which there are at most n, as the smaller side of a join."""
    return F.broadcast(rows) if n <= SENT else rows


def _confirmed(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """Of pairs (a, b) of classes those whose full sets are similar enough, and their number.

    b's pairs are dealt over SALTS parts and b's text goes to each part once, ahead of them, so a task that streams
    through its parts holds one b at a time and no text is repeated for each pair of a frequent b.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
    firsts = dealt.select("b", "salt").distinct().join(texts.withColumnRenamed("cls", "b"), "b")
    firsts = firsts.select("b", "salt", F.lit(None).cast("binary").alias("a"), "raw")
    rows = dealt.join(texts.withColumnRenamed("cls", "a"), "a").select("b", "salt", "a", "raw").unionByName(firsts)
    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros(0, np.uint64)
        for batch in slices(batches):
            b, _, a, raws = [c.to_pylist() for c in batch.columns]
            linked = []
            for other, raw in zip(a, raws, strict=True):
                x = shingle(raw)
                if other is None:
                    y = x
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(other is not None and 100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return _held(rows.mapInArrow(tidy(task), "a binary, b binary"))


class Labels:
    """The root of each class that is linked with others; any other class is its own root."""

    def __init__(self, rows: DataFrame, n: int = 0) -> None:
        self.rows, self.n = rows, n  # node, root

    def rooted(self, rows: DataFrame, n: int, column: str, out: str) -> DataFrame:
        """rows, of which there are at most n, with the root of the class in a column."""
        own = self.rows
        if n <= SENT < self.n:  # few of the labels are asked for
            own = own.join(F.broadcast(rows.select(F.col(column).alias("node")).distinct()), "node", "left_semi")
        return rows.join(_sent(own.toDF(column, out), min(n, self.n)), column, "left").withColumn(out, F.coalesce(out, column))

    def merged(self, edges: DataFrame, n: int) -> Labels:
        """The labels after joining the components that n edges (a, b) connect.

        Each round rewrites the edges between roots, drops those within one and hooks every root to its smallest
        neighbour below it, so links to one pivot take one round and chains a logarithmic number.
        """
        labels, n_labels = self.rows, self.n
        work = self.rooted(self.rooted(edges, n, "a", "root_a"), n, "b", "root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        while True:
            work, n = _held(work.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
            if not n:
                return Labels(labels, n_labels)
            hook = work.groupBy("a").agg(F.min("b").alias("to"))
            more = 1
            while more:  # each pass doubles how far a hook reaches, until all end at roots that aren't hooked
                further = hook.join(_sent(hook.toDF("to", "next"), n), "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("more"))
                further, more = stored_count(further, "neardup-hooks", F.col("more"))
                hook = further.select("a", "to").coalesce(1 + n // SENT)
            known = labels.join(_sent(hook.select(F.col("a").alias("node")), n), "node", "left_semi").select(F.col("node").alias("a"))
            fresh = hook.join(_sent(known, n), "a", "left_anti").toDF("node", "root")
            moved = labels.join(_sent(hook.withColumnRenamed("a", "root"), n), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels, n_labels = _held(moved.unionByName(fresh))
            x, y = _sent(hook.toDF("a", "to_a"), n), _sent(hook.toDF("b", "to_b"), n)
            work = work.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))


def _sketch(texts: DataFrame) -> np.ndarray:
    """How many of the texts have a shingle of each slot, roughly: SLOTS bytes, whatever the input."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in slices(batches):
            for raw in batch.column(0).to_pylist():
                np.add.at(counts, shingle(raw) % np.uint64(SLOTS), 1)
        slots = np.flatnonzero(counts > 0)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(counts[slots])], names=["slot", "n"])

    # As steps of a quarter of a doubling, which fit in a byte.
    rows = texts.select("raw").mapInArrow(tidy(task), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1")
    rows = rows.select(F.col("slot").cast("int"), F.round(F.log2("n") * 4).cast("int").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.uint8)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _rare_prefix_pairs(texts: DataFrame, labels: Labels) -> DataFrame:
    """All pairs (a, b) of classes in different components that can be similar enough, for an exact rest.

    Of two such sets, in any common order of shingles, one of the first n - ceil(t n) + 1 shingles of the larger is one
    of the first n - ceil(2 t / (1 + t) n) + 1 of the smaller (t: the similarity, 0.75). Rare shingles come first, so
    passages that many texts share are seldom among the smaller's; shingles that one component alone has are left out;
    a pair is kept where the shingles from the shared one on suffice.
    """
    counts = _sketch(texts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, hashes, sizes, places = [], [], [], []
            for node, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = shingle(raw)
                s = s[np.lexsort((s, counts[s % np.uint64(SLOTS)]))]
                n = len(s) - -(-PERCENT * len(s) // 100) + 1
                nodes += [node] * n
                hashes.append(s[:n].view(np.int64))
                sizes.append(np.full(n, len(s)))
                places.append(np.arange(n))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), *(pa.array(np.concatenate(c)) for c in (hashes, sizes, places))], names=["node", "h", "n", "at"])

    rows = texts.select("cls", "raw").mapInArrow(tidy(task), "node binary, h bigint, n bigint, at bigint")
    rows = rows.join(_sent(labels.rows, labels.n), "node", "left").select("node", "h", "n", "at", F.coalesce("root", "node").alias("root"))
    rows = stored(rows, "neardup-prefixes")
    several = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("h")
    rows = rows.join(several, "h", "left_semi")
    # The smaller's part: both * (100 + PERCENT) >= PERCENT * 2 n, where both is what it has from the shared shingle on.
    small = rows.filter((F.col("n") - F.col("at")) * (100 + PERCENT) >= 2 * PERCENT * F.col("n"))
    x, y = small.toDF("h", "a", "na", "at_a", "ra"), rows.toDF("h", "b", "nb", "at_b", "rb")
    enough = F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b")) * (100 + PERCENT) >= PERCENT * (F.col("na") + F.col("nb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = x.join(y, "h").filter(smaller & (F.col("ra") != F.col("rb")) & enough)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable over links) and kept of every row of docs.

    Rows with the same shingle set are one class. Classes that share a band are compared with the bucket's first
    class: at first each with one such pivot, then with the pivots of its other buckets that are still in another
    component, then, where a bucket still holds several, with other pivots. Buckets in which several components remain go to an exact prefix join of all their classes, so no
    bucket is compared pair by pair and no link between found candidates is left out.

    Null and wordless texts have no shingles and are linked with nothing; their component is their own key. Repeated
    rows are links of similarity 1; rows with one key and different texts count as different documents. A null key is
    kept only where its whole component has none. An empty table gives an empty result; other columns are not looked at.
    """
    out = _components(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw")))
    component = F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))


def _components(docs: DataFrame) -> DataFrame:
    """n_shingles, cls, root (a class of the component), component_id and all columns but raw of docs (key, .., raw last)."""
    ident = F.xxhash64("key", "raw").alias("id")
    sigs = stored(_signatures(docs.select(*docs.columns[:-1], ident, "raw")), "neardup-signatures")
    # Equal sets have equal bands.
    classes = sigs.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("key").alias("first"), F.min("id").alias("id"), F.first("bands").alias("bands"))
    posts = classes.select("cls", "id", F.explode("bands").alias("band"))
    pivots = posts.groupBy("band").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last")).filter(F.col("pivot") != F.col("last")).select("band", "pivot")
    members = stored(posts.join(pivots, "band"), "neardup-buckets")
    texts = _class_texts(docs.select(ident, "raw"), members.select("cls", "id").distinct())

    labels = Labels(members.select(F.col("cls").alias("node"), F.col("cls").alias("root")).limit(0))
    near = members.filter(F.col("cls") != F.col("pivot"))
    tried, n = _held(near.groupBy("cls").agg(F.min("pivot").alias("b")).select(F.col("cls").alias("a"), "b"))
    labels = labels.merged(*_confirmed(tried, texts))

    def apart(pairs: DataFrame, n: int) -> tuple[DataFrame, int]:
        """Of at most n pairs (a, b) those in different components that weren't compared."""
        pairs = pairs.join(done, ["a", "b"], "left_anti")
        return _held(labels.rooted(labels.rooted(pairs, n, "a", "ra"), n, "b", "rb").filter("ra != rb").select("a", "b"))

    def still_open(members: DataFrame, n: int) -> tuple[DataFrame, int]:
        """Of the members of buckets (at most n) those of buckets that hold several components: none opens again."""
        spans = labels.rooted(members, n, "cls", "root").groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        return _held(members.join(spans.select("band"), "band", "left_semi").select("band", "cls"))

    done, many = tried, BANDS * n
    pairs, n = apart(near.select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct(), many)
    if n:
        labels, done = labels.merged(*_confirmed(pairs, texts)), done.unionByName(pairs)
    buckets, n = still_open(members.select("band", "cls"), 2 * many)
    for turn in range(ROUNDS):
        if not n:
            break
        other = buckets.groupBy("band").agg(F.min_by("cls", F.xxhash64("cls", F.lit(turn))).alias("pivot"))
        fresh = buckets.join(_sent(other, n), "band").filter("cls != pivot").select(F.greatest("cls", "pivot").alias("a"), F.least("cls", "pivot").alias("b")).distinct()
        fresh, some = apart(fresh, n)
        if not some:
            break
        labels, done = labels.merged(*_confirmed(fresh, texts)), done.unionByName(fresh)
        buckets, n = still_open(buckets, n)

    left, n = _held(buckets.select("cls").distinct())
    if n:
        rest, n = _held(_rare_prefix_pairs(texts.join(_sent(left, n), "cls", "left_semi"), labels).join(done, ["a", "b"], "left_anti"))
        if n:
            labels = labels.merged(*_confirmed(rest, texts))

    grouped = classes.select("cls", "first").join(_sent(labels.rows.withColumnRenamed("node", "cls"), labels.n), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("cls", "root", "component_id")
    return sigs.drop("bands", "id").join(named, "cls", "left")


def op7_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count, component and whether it represents it."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest doc_id stays.

    Of several texts under that id, or without one where the whole group has none, the one with the smallest hash
    stays; rows repeated under id and text stay once. Texts are told apart by id and hash, as ids may be null or shared.
    """
    mark = F.xxhash64("text")
    groups = _components(docs.select(F.col("doc_id").alias("key"), mark.alias("mark"), F.col("text").cast("binary").alias("raw")))
    groups = groups.filter("n_shingles > 0 and key <=> component_id")
    kept = groups.groupBy("root").agg(F.min("mark").alias("mark"), F.first("key").alias("key"))
    same = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    whole = same.join(kept, same["doc_id"].eqNullSafe(kept["key"]) & (mark == kept["mark"]), "left_semi").dropDuplicates(["doc_id", "text"])
    # Texts without words are linked with nothing and stay.
    return whole.unionByName(docs.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
