"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, tidy, worker_held

#: Hash buckets of the character n-grams, their lengths and the width of the embeddings.
BUCKETS, GRAMS, DIM = 1 << 18, (4, 6, 8), 8
#: Words in a window; a text's score is that of its worst window, so long texts hide nothing.
WINDOW = 4
#: Longer tokens (scripts without spaces, joined words) are read in pieces of PIECE characters, each sharing OVERLAP (as
#: long as the longest n-gram) with the one before, so that every n-gram stands whole in a piece and a word in one isn't averaged away.
LONG, PIECE, OVERLAP = 64, 16, 8
#: n-grams in fewer training texts stay out of the model.
MIN_TEXTS = 4
#: Bounds of the training sample: rows in hash order, and their characters in all.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 30_000_000
#: Stretches, evenly spread, that a text gives to the sample where it is longer than its share.
STRETCHES = 8
#: Laps of training, steps in each; the worst windows of a text that a lap looks at.
LAPS, STEPS, WORST = 14, 16, 6
RATE, DECAY = 0.05, 2e-4
#: Standard errors beyond which an n-gram's log odds count in the choice of the first windows.
SURE = 2.0
#: Words whose scores a worker remembers, and texts scored at once.
CACHE, TOGETHER = 150_000, 32
#: Words that training looks at together.
WORDS = 50_000
_BASE = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(LONG + 2, 0xD6E8FEB86659FD93, np.uint64))
_EDGE = ".,;:!?\"'()[]{}<>|*#%&$~`-_/\\"


def tokens(text: str | None) -> list[str]:
    """The lower-cased text's tokens; the whole of a long one, in overlapping pieces."""
    words = (text or "").lower().split()
    if not words or len(max(words, key=len)) <= LONG:
        return words
    out: list[str] = []
    for w in words:
        if len(w) > LONG and len(inner := w.strip(_EDGE)) > LONG:
            out += [inner[i : i + PIECE] for i in range(0, len(inner) - OVERLAP, PIECE - OVERLAP)]
        else:
            out.append(w)
    return out


def gram_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Owner (index into words) and bucket of every n-gram of the lower-cased words within < and >, and of the whole words.

    Code points are hashed by sums of powers, all words at once. Mere punctuation has no n-grams. Words (from tokens)
    have at most LONG characters between punctuation.
    """
    inner = [w.strip(_EDGE) for w in words]
    sizes = np.array([len(w) + 2 if w else 0 for w in inner], np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in inner if w).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(points))
    total, owners, hashes = points.copy(), [], []
    for n in range(2, max(GRAMS) + 1):
        total = total[:-1] * _BASE + points[n - 1 :] if len(total) > 1 else total[:0]
        if n in GRAMS:
            whole = place[: len(total)] + n <= ends[: len(total)]
            owners.append(owner[: len(total)][whole])
            hashes.append(total[whole] ^ np.uint64(n))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes)[some] - sizes[some]
        power = _POWERS[place - np.repeat(starts, sizes[some])]
        owners.append(some.astype(np.int32))
        hashes.append(np.add.reduceat(points * power, starts) ^ np.uint64(99))
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate(owners), (h >> np.uint64(64 - 18)).astype(np.int32)


@dataclass
class Model:
    """Bucket scores (the embeddings times the difference of the softmax's two columns) and the bias."""

    scores: np.ndarray
    bias: float

    def words(self, tokens: list[str]) -> np.ndarray:
        """Each token's mean score over its n-grams; 0 without any."""
        owner, bucket = gram_table(tokens)
        sums = np.bincount(owner, self.scores[bucket], len(tokens))
        return sums / np.maximum(np.bincount(owner, minlength=len(tokens)), 1)


def window_counts(lengths: np.ndarray) -> np.ndarray:
    """How many windows texts of so many words have: one at each word that a whole window follows, one at least."""
    return np.maximum(lengths - WINDOW, 0) + 1


def window_sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return upto[starts + lengths] - upto[starts]


class Vocabulary:
    """The distinct words of texts as lists of n-gram buckets, one after another, and the texts as numbers of words."""

    def __init__(self, texts: list[str]) -> None:
        index: dict[str, int] = {"": 0}
        docs, chunk = [], []
        grams, counts = [], [np.zeros(1, np.int32)]

        def add() -> None:
            owner, bucket = gram_table(chunk)
            grams.append(bucket[np.argsort(owner, kind="stable")])
            counts.append(np.bincount(owner, minlength=len(chunk)).astype(np.int32))
            chunk.clear()

        for text in texts:
            own = tokens(text)
            for w in own:
                if w not in index:
                    index[w] = len(index)
                    chunk.append(w)
            docs.append(np.array([index[w] for w in own] or [0], np.int32))
            if len(chunk) >= WORDS:
                add()
        add()
        self.words, self.lengths = np.concatenate(docs), np.array([len(d) for d in docs])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.grams, self.count = np.concatenate(grams), np.concatenate(counts)
        self.first = np.cumsum(self.count, dtype=np.int64) - self.count

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' buckets, one word after another, and how many each has."""
        n = self.count[words]
        ends = np.cumsum(n)
        return self.grams[np.repeat(self.first[words] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n

    def scores(self, buckets: np.ndarray) -> np.ndarray:
        """Each word's mean over its n-grams, some words at a time."""
        out = np.zeros(len(self.count), np.float32)
        for at in range(0, len(out), WORDS):
            n = self.count[at : at + WORDS]
            part = self.grams[self.first[at] : self.first[at] + n.sum()]
            out[at : at + WORDS] = np.bincount(np.repeat(np.arange(len(n)), n), buckets[part], len(n)) / np.maximum(n, 1)
        return out


def _log_odds(vocabulary: Vocabulary, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each bucket occurs, and its log odds between toxic and other texts in standard errors over SURE."""
    seen = np.zeros((2, BUCKETS), np.int32)
    for start, n, y in zip(vocabulary.starts, vocabulary.lengths, toxic, strict=True):
        seen[int(y), np.unique(vocabulary.grams_of(np.unique(vocabulary.words[start : start + n]))[0])] += 1
    n_bad = toxic.sum()
    odds = np.log((seen[1] + 0.5) / (n_bad + 1)) - np.log((seen[0] + 0.5) / (len(toxic) - n_bad + 1))
    z = odds / np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    return seen.sum(axis=0), np.maximum(z - SURE, 0).astype(np.float32)


def _worst_windows(vocabulary: Vocabulary, score: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of each text's WORST windows with the highest sums, and their texts; some texts at a time."""
    found, of = [], []
    v, at = vocabulary, 0
    while at < len(v.lengths):
        to = at + max(1, int(np.searchsorted(np.cumsum(v.lengths[at:]), WORDS, "right")))
        lengths, base = v.lengths[at:to], v.starts[at]
        part = slice(base, base + lengths.sum())
        n_win = window_counts(lengths)
        doc = np.repeat(np.arange(at, to, dtype=np.int32), n_win)
        first = np.cumsum(n_win) - n_win
        win = np.arange(len(doc)) - np.repeat(first - (v.starts[at:to] - base), n_win)
        sums = window_sums(score[v.words[part]] * counts[part], win, np.minimum(WINDOW, np.repeat(lengths, n_win)))
        order = np.lexsort((-sums, doc))
        nth = np.arange(len(order)) - np.repeat(first, n_win)
        best = np.sort(order[nth < WORST])
        found.append(win[best] + base)
        of.append(doc[best])
        at = to
    return np.concatenate(found), np.concatenate(of)


def train(texts: list[str], toxic: list[int], seed: int = 1) -> Model | None:
    """Embeddings and softmax fitted together by Adam on the worst windows of each text; None if a class is missing.

    The first lap's windows are those with the highest log odds, later ones those that the model finds worst. n-grams
    and windows are held as 32-bit numbers and looked at in parts, so memory stays a few times that of the texts.
    """
    y = np.asarray(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    v = Vocabulary(texts)
    seen, odds = _log_odds(v, y)
    used = np.flatnonzero(seen >= MIN_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    odds[seen < MIN_TEXTS] = 0

    rng = np.random.default_rng(seed)
    counts = np.ones(len(v.words), np.float32)  # a word right after itself counts once
    counts[1:] = v.words[1:] != v.words[:-1]
    counts[v.starts] = 1
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    weight /= weight.sum()

    emb, out, bias = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.array([-2.0], np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    step = 0
    buckets = odds
    for _ in range(LAPS):
        win, of_doc = _worst_windows(v, v.scores(buckets), counts)
        size = np.minimum(WINDOW, v.lengths[of_doc])
        per = WINDOW / np.maximum(size, WINDOW // 2)
        part_start = np.cumsum(size) - size
        flat = np.repeat(win - part_start, size) + np.arange(size.sum())
        doc_start = np.flatnonzero(np.r_[True, of_doc[1:] != of_doc[:-1]])
        local, token = np.unique(v.words[flat], return_inverse=True)
        once = counts[flat]
        gram, n = v.grams_of(local)
        gram, owner = place[gram], np.repeat(np.arange(len(local), dtype=np.int32), n)
        share = np.repeat((1 / np.maximum(n, 1)).astype(np.float32), n)
        known = gram >= 0
        gram, owner, share = gram[known], owner[known], share[known]
        for _ in range(STEPS):
            step += 1
            side = out[:, 1] - out[:, 0]
            score = np.bincount(owner, (emb @ side)[gram] * share, len(local))
            mean = np.add.reduceat(score[token] * once, part_start) * per
            best = np.maximum.reduceat(mean, doc_start)
            top = np.flatnonzero(mean == np.repeat(best, np.diff(np.r_[doc_start, len(win)])))
            top = top[np.r_[True, of_doc[top][1:] != of_doc[top][:-1]]]  # of equal windows the first
            # A toxic text has a toxic window; every window of another text isn't.
            chance = 1 / (1 + np.exp(-np.clip(mean + bias[0], -50, 50)))
            d_win = np.where(y[of_doc] == 1, 0.0, chance * weight[of_doc])
            d_win[top] = (chance[top] - y[of_doc[top]]) * weight[of_doc[top]]
            d_part = d_win * per
            d_word = np.bincount(token, np.repeat(d_part, size) * once, len(local)).astype(np.float32)
            d_gram = np.bincount(gram, d_word[owner] * share, len(used)).astype(np.float32)
            d_side = emb.T @ d_gram
            grads = (d_gram[:, None] * side + np.float32(DECAY / len(y) ** 0.5) * emb, np.stack([-d_side, d_side], axis=1) + np.float32(DECAY) * out, np.array([d_win.sum()], np.float32))
            for p, g, (m, s) in zip((emb, out, bias), grads, moments, strict=True):
                m += np.float32(0.1) * (g - m)
                s += np.float32(0.01) * (g * g - s)
                p -= np.float32(RATE / (1 - 0.9**step)) * m / (np.sqrt(s / np.float32(1 - 0.99**step)) + np.float32(1e-8))
        buckets = np.zeros(BUCKETS, np.float32)
        buckets[used] = emb @ (out[:, 1] - out[:, 0])
    return Model(buckets, float(bias[0]))


def fair_share(sizes: list[int], total: int) -> int:
    """The largest size to which texts can be cut so that they sum up to at most total; texts below it stay whole."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= n
    return total


def _thinned(text: Column, share: int) -> Column:
    """text where it has at most share characters, else stretches from its start to its end that have as many in all."""
    each = max((share - STRETCHES) // STRETCHES, 1)  # a line break follows each
    gap = (F.length(text) - each) / (STRETCHES - 1)
    parts = [F.substring(text, (F.floor(gap * i) + 1).cast("int"), F.lit(each)) for i in range(STRETCHES)]
    return F.when(F.length(text) > share, F.concat_ws("\n", *parts)).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from a bounded sample of labelled rows: the first `rows` by a hash of doc_id, `chars` characters in all.

    docs: doc_id, text; labels: doc_id, toxic. Rows with crc32(doc_id as text) mod 5 = 0 are held out. Null labels and
    ids are left out; repeated labels of an id count as its highest. Every row stays in the sample: where the texts
    exceed `chars`, the longest give evenly spread stretches in place of the whole, all of one size in sum. None where
    no row or one class alone is labelled, or docs is empty; if no model results otherwise, ValueError is raised.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = durable(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sizes = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).collect()  # at most `rows` numbers
    share = fair_share([r["n"] or 0 for r in sizes], chars)
    # Texts are cut before they move; documents repeated under one id are taken once.
    sample = texts.groupBy("doc_id").agg(F.max(_thinned(F.col("text"), share)).alias("text"), F.max("toxic").alias("toxic"))
    # One task has the bounded sample and trains, so a lost executor is just a retry.
    ordered = sample.select("text", "toxic", F.xxhash64("doc_id"), "doc_id").coalesce(1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        rows.sort(key=lambda r: r[2:])
        model = train([r[0] for r in rows], [r[1] for r in rows])
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()], pa.binary()), pa.array([model.bias])], names=["scores", "bias"])

    got = ordered.mapInArrow(tidy(task), "scores binary, bias double").collect()
    if got:
        return Model(np.frombuffer(got[0]["scores"], np.float32), got[0]["bias"])
    if told.select("toxic").distinct().count() > 1 and not docs.isEmpty():
        raise ValueError("labels of both classes exist, but the sample has not both; no model was trained")
    return None


def scored(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score in 0..1: the sigmoid of the worst window of the whole text.

    Null and empty texts get the score of a window without words; without a model (no labels of both classes) every
    score is 0. Other columns stay; one named like the score is replaced.
    """
    keep = [c for c in docs.columns if c != score]
    shape = docs.select(*keep).schema.add(score, "double")
    at = keep.index(text)

    name = None if model is None else hash((model.bias, model.scores.tobytes()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_held(("toxicity", name), dict)

        def logits(texts: list[str]) -> Iterator[float]:
            split = [tokens(t) for t in texts]
            if new := list(set().union(*split).difference(cache)):
                if len(cache) > CACHE:
                    cache.clear()
                    new = list(set().union(*split))
                cache.update(zip(new, model.words(new).tolist(), strict=True))
            for own in split:
                if not own:
                    yield model.bias
                    continue
                scores = np.array([cache[t] for t in own])
                alike = np.flatnonzero(scores[1:] == scores[:-1]) + 1
                scores[[i for i in alike.tolist() if own[i] == own[i - 1]]] = 0.0  # a word right after itself counts once
                size = min(WINDOW, len(own))
                sums = window_sums(scores, np.arange(window_counts(len(own))), size)
                yield float(sums.max() / max(size, WINDOW // 2) * WINDOW) + model.bias

        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = np.zeros(len(texts))
            if model is not None:
                for k in range(0, len(texts), TOGETHER):
                    out[k : k + TOGETHER] = list(logits(texts[k : k + TOGETHER]))
                out = 1 / (1 + np.exp(-np.clip(out, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*keep, score])

    return docs.select(*keep).mapInArrow(tidy(task), shape)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labelled rows that aren't held out; rows without an id never are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(whole, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).filter(F.col("score") < 0.5).select(*docs.columns)
