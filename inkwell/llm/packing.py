"""Lexical retrieval packing: a sharded BM25 index finds unused neighbours that fill each seed document's window."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, tidy, unit_hash, worker_held
from .words import slices

#: Tokens of a window, and the id that ends each document.
LENGTH, END = 4096, 2
#: Tokens of a shard: what one task indexes and packs, whatever the input.
SHARD = 1 << 19
#: Content buckets along which documents are laid before they are cut into shards.
BUCKETS = 4096
#: BM25's parameters, terms of a query, and the share of a shard's documents beyond which a term is not indexed.
K1, B, TERMS, COMMON = 1.2, 0.75, 32, 0.1
#: Parts of words whose ids a worker remembers, new ones that are tokenized as one text, and bytes of texts looked at together.
CACHE, TOGETHER, AT_ONCE = 500_000, 1000, 1 << 23

#: What may follow a word's letters as one piece: ASCII marks but the apostrophe, which begins pieces like 's.
_MARKS = "!-&(-/:-@\\[-`{-~"
_MARK_LIST = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_ASCII_PIECES = re.compile(r"[a-zA-Z]+|[0-9]|[^a-zA-Z0-9]+")


def pieces_of(word: str) -> int:
    """How many pieces the vocabulary's pattern makes of a word; 0 where that isn't plain to see."""
    if word.isalpha():
        return 0 if "\u0130" in word else 1  # a dotted capital I becomes two characters in lower case
    if word.isascii():
        return 0 if "<|" in word or "'" in word else len(_ASCII_PIECES.findall(word))
    return 0


def letters(words: pa.StringArray) -> pa.BooleanArray:
    """Which words are one piece of letters."""
    told = pc.and_not(pc.utf8_is_alpha(words), pc.match_substring(words, "\u0130"))
    if not (text := "".join(pc.filter(words, told).to_pylist())).isalpha() and text:
        told = pa.array([t and w.isalpha() for t, w in zip(told.to_pylist(), words.to_pylist(), strict=True)], pa.bool_())
    return told


class WordIds:
    """Token ids of texts by word: words are split at ASCII white space, which no token of the vocabulary crosses.

    Ids equal those of the tokenizer over the whole text. Texts are looked at together: each distinct word of theirs once,
    letters apart from marks behind them, and such a part is tokenized once while remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.single = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # For words of one piece each, the pattern that finds pieces is spared.
        self.single.normalizer = normalizers.Lowercase()
        self.single.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known, self.ids = pa.array([""]), pa.array([b""])
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a piece of a word: a run of letters, a digit or a run of other characters.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def together(self, words: pa.StringArray, pieces: np.ndarray, by: object) -> pa.BinaryArray:
        """Ids of words of so many pieces, one text of TOGETHER words a call; null where the pieces are others."""
        out = [pa.array([], pa.binary())]
        for k in range(0, len(words), TOGETHER):
            own, last = words[k : k + TOGETHER], np.cumsum(pieces[k : k + TOGETHER])
            text = " ".join(own.to_pylist())
            e = (by if unicodedata.is_normalized("NFC", text) else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u2")  # raises for vocabularies beyond 65,536 ids
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == last[-1] and stops[-1] == len(ids):
                cut = np.append(0, stops[last - 1] * 2).astype(np.int32)
                out.append(pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cut), pa.py_buffer(ids)]))
            else:
                out.append(pa.nulls(len(own), pa.binary()))
        return pa.concat_arrays(out)

    def tokenize(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of new parts of words: plain ones together, odd ones each alone."""
        one = pc.or_(letters(words), pc.match_substring_regex(words, f"^[{_MARKS}]+$")).to_numpy(zero_copy_only=False)
        pieces = np.ones(len(words), np.int64)
        pieces[~one] = [pieces_of(w) for w in words.filter(pa.array(~one)).to_pylist()]
        sorts = [np.flatnonzero(one), np.flatnonzero(~one & (pieces > 0)), np.flatnonzero(pieces == 0)]
        plain = [self.together(words.take(pa.array(at)), pieces[at], by) for at, by in zip(sorts, (self.single, self.tokenizer), strict=False)]
        ids = pa.concat_arrays([*plain, pa.nulls(len(sorts[2]), pa.binary())])
        order = np.concatenate(sorts)
        odd = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
        alone = self.tokenizer.encode_batch(words.take(pa.array(order[odd])).to_pylist(), add_special_tokens=False)
        ids = pc.replace_with_mask(ids, ids.is_null(), pa.array([np.array(e.ids, "<u2").tobytes() for e in alone], pa.binary()))
        return ids.take(pa.array(np.argsort(order)))

    def __call__(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not raws:
            return []
        # The vocabulary is lower case. Texts with combining marks or special tokens go as they are: case matters there.
        texts = [raw if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw else raw.lower() for raw in raws]
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary
        bodies = pc.ascii_rtrim(words, characters=_MARK_LIST)
        plain = letters(bodies)
        marks = pc.struct_field(pc.extract_regex(words, f"(?P<marks>[{_MARKS}]*)$"), "marks")
        parts = pa.concat_arrays([pc.if_else(plain, bodies, words), pc.if_else(plain, marks, "")]).dictionary_encode()
        names, at = parts.dictionary, pc.index_in(parts.dictionary, value_set=self.known)
        if at.null_count:
            new = names.filter(at.is_null())
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, self.tokenize(new)])
            at = pc.replace_with_mask(at, at.is_null(), pa.array(np.arange(len(self.known) - len(new), len(self.known)), pa.int32()))
        own = self.ids.take(at)
        if len(self.known) > CACHE:  # the words of these texts stay, so frequent ones do
            self.known, self.ids = pa.concat_arrays([names, pa.array([""])]), pa.concat_arrays([own, pa.array([b""])])
        spelt = pc.binary_join_element_wise(own.take(parts.indices[: len(words)]), own.take(parts.indices[len(words) :]), b"")
        ids = spelt.take(flat.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[split.offsets.to_numpy()] // 2
        found = np.frombuffer(ids.buffers()[2] or b"", "<u2", ends[-1])
        return [found[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def word_ids(path: str) -> WordIds:
    """The worker's own WordIds of a vocabulary file."""
    return worker_held(("packing", path), lambda: WordIds(path))


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def content_bucket(ids: np.ndarray) -> int:
    """A bucket that texts share the likelier the more pairs of neighbouring ids they share."""
    if len(ids) < 2:
        return int(ids[0]) % BUCKETS if len(ids) else 0
    pairs = (ids[:-1].astype(np.uint64) << np.uint64(16)) + ids[1:]
    low = int((pairs * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5851F42D4C957F2D)).min())
    return (low * 0xD1342543DE82EF95 >> 20) % BUCKETS


def _windows(docs: DataFrame, path: str) -> DataFrame:
    """key, start, length, crc, doc_tokens, bucket and ids: each document's full windows (without ids) and its rest."""
    shape = docs.select("key").schema
    for name, kind in (("start", "long"), ("length", "integer"), ("crc", "long"), ("doc_tokens", "long"), ("bucket", "integer"), ("ids", "binary")):
        shape = shape.add(name, kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for batch in (part for whole in batches for part in slices(whole, 1, AT_ONCE)):
            take, rows = [], []
            for r, ids in enumerate(encode([raw or b"" for raw in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint16(END))
                bucket = content_bucket(ids)
                for start in range(0, len(ids), LENGTH):
                    part = ids[start : start + LENGTH]
                    full = len(part) == LENGTH
                    take.append(r)
                    rows.append((start, len(part), ids_crc32(part), len(ids), bucket, None if full else part.tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=shape.names)

    return docs.mapInArrow(tidy(task), shape)


class Index:
    """A BM25 inverted index over a shard's documents, given as arrays of ids; common terms are left out."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        flat, owner = np.concatenate(docs).astype(np.int64), np.repeat(np.arange(n), lengths)
        # The most frequent terms carry the least; they go before the sort that makes the postings.
        often = np.bincount(flat)
        keep = often[flat] <= max(COMMON * n, 2)
        pair, tf = np.unique(flat[keep] * n + owner[keep], return_counts=True)
        term, self.doc = pair // n, pair % n
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.first = np.append(self.first, len(term))
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths[self.doc] / max(lengths.mean(), 1))
        self.weight = np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm)
        by_doc = np.argsort(self.doc, kind="stable")
        self.of_doc = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.doc_terms = np.repeat(np.arange(len(self.terms)), df)[by_doc]
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents but the seed itself that share the seed's rarest terms, best first."""
        terms = self.doc_terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        if len(terms) > TERMS:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")[:TERMS]]
        if not len(terms):
            return terms
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in terms])
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[seed] = 0
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill_windows(docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that fill windows of LENGTH, each id in one.

    The seed opens a window, its neighbours fill it whole as long as they fit, the next is cut at its end and what
    is left of it opens the next window. Where a seed has no unused neighbour the next unused document follows. The
    last window's rest is cut into sequences whose lengths are powers of two, so nothing is padded.
    """
    index, unused = Index(docs), np.ones(len(docs), bool)
    order = np.argsort([-len(d) for d in docs], kind="stable")
    pieces, sequence, room, at, seed = [], 0, LENGTH, 0, None
    queue: list[int] = []
    for _ in range(len(docs)):
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            doc = queue.pop()
        else:
            while not unused[order[at]]:
                at += 1
            doc = int(order[at])
            seed = None
        unused[doc] = False
        start = 0
        while start < len(docs[doc]):
            n = min(room, len(docs[doc]) - start)
            pieces.append((doc, start, n, sequence, LENGTH - room))
            start, room = start + n, room - n
            if not room:
                sequence, room, seed = sequence + 1, LENGTH, None
        if seed is None:
            seed = doc
            queue = index.neighbours(doc, unused)[::-1].tolist()
    if room < LENGTH:
        tail = [p for p in pieces if p[3] == sequence]
        pieces = pieces[: len(pieces) - len(tail)]
        total = LENGTH - room
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            left = 1 << bit
            while left:
                doc, start, n, *_ = tail[0]
                take = min(left, n)
                pieces.append((doc, start, take, sequence, (1 << bit) - left))
                tail[0:1] = [(doc, start + take, n - take)] if take < n else []
                left -= take
            sequence += 1
    return pieces


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids, if asked for).

    Documents are tokenized once. Their full windows are sequences at once; the rests are laid on a line by content
    bucket and, within it, by a hash, and the line is cut into shards of SHARD tokens, so that a bucket of any size is
    dealt out and similar texts still meet. Each shard is indexed and packed by itself: bounded memory, no driver.

    path names the vocabulary file, which every executor must have. Null texts count as empty: a single END. Repeated
    rows are packed each for itself; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw"))
    # Rows that are equal in all, or share their key, are told apart by their place in the stored table.
    parts = stored(_windows(rows, path).withColumn("row", F.monotonically_increasing_id()), "packing-windows")
    # At most BUCKETS rows, whatever the input.
    line = parts.groupBy("bucket").agg(F.sum(F.when(F.col("ids").isNotNull(), F.col("length")).otherwise(0)).alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = line.withColumn("before", before)
    place = F.floor((F.col("before") + unit_hash(F.col("key"), F.col("start"), F.col("row")) * F.col("tokens")) / SHARD).cast("long")
    parts = parts.join(F.broadcast(line), "bucket").select(place.alias("shard"), "key", "start", "length", "crc", "doc_tokens", "ids")
    shape = rows.select(F.col("key").alias(key)).schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        shape = shape.add(name, "long")
    if ids:
        shape = shape.add("ids", "binary")

    def task(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("start", "ascending")])
        starts, lengths, crcs, totals = [table[c].to_numpy() for c in ("start", "length", "crc", "doc_tokens")]
        raw = table["ids"].to_pylist()
        full = [r for r, x in enumerate(raw) if x is None]
        rest = [r for r, x in enumerate(raw) if x is not None]
        out = [(r, starts[r], lengths[r], crcs[r], s, 0) for s, r in enumerate(full)]
        arrays = [np.frombuffer(raw[r], "<u2") for r in rest]
        for d, start, n, sequence, offset in fill_windows(arrays) if rest else []:
            out.append((rest[d], starts[rest[d]] + start, n, ids_crc32(arrays[d][start : start + n]), len(full) + sequence, offset))
        r, start, n, crc, sequence, offset = (np.array(c, np.int64) for c in zip(*out, strict=True))
        columns = [table["key"].take(pa.array(r)), *map(pa.array, (start, n, crc, totals[r], (group[0].as_py() << 32) + sequence, offset))]
        if ids:
            whole = [None if x is None else np.frombuffer(x, "<u2") for x in raw]
            columns.append(pa.array([None if whole[i] is None else whole[i][a - starts[i] : a - starts[i] + k].tobytes() for i, a, k in zip(r, start, n, strict=True)], pa.binary()))
        return pa.table(columns, names=shape.names)

    return parts.groupBy("shard").applyInArrow(task, shape)


def _vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of what is left."""
    return packed(docs, _vocabulary())
