"""Reversed search, decontamination and resampling: brute force over rows with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import decontamination, resampling, reversed_search
from inkwell.llm.words import words

DOCS = "doc_id bigint, text string, score string, n_words string, item string, rank string"
ITEMS = "item_id bigint, text string, doc_id string, matches string"
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return LETTERS.findall(lower(text))


def corpus(rnd, n_docs=160, n_items=14, vocabulary=60):
    """Documents and items that share passages, with nulls, empty and long texts, ties and repeated rows."""
    word = [f"w{k}" if k % 5 else f"Ä{k}É" for k in range(vocabulary)]
    say = lambda n: " ".join(rnd.choice(word) for _ in range(n))
    items = [(i, say(rnd.choice([3, 9, 10, 11, 30, 60]))) for i in range(n_items)]
    items += [(None, say(12)), (None, say(4)), (900, None), (901, ""), (902, "?!"), items[0], (items[1][0], say(15))]
    docs = []
    for i in range(n_docs):
        text = say(rnd.randrange(0, 40))
        if i % 3 == 0:
            own = plain_words(rnd.choice(items)[1])
            a = rnd.randrange(len(own)) if own else 0
            text += "-" + ",\n".join(own[a : a + rnd.randrange(1, 40)]).upper().replace("Ä", "Ä") + " " + say(3)
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, " .,"), (503, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (None, docs[6][1]), (None, None), (504, say(30_000) + " " + (items[5][1] or "")), (505, "x" * 3_000_000 + " w1 w2"), (-(2**62), say(25))]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in docs], DOCS).repartition(7), spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], ITEMS)


def test_words():
    text = "Az09 é-É_x{y}~ z  \x7f\x00Q" + "ab " * 700_000
    assert [w.decode() for piece in words(text.encode()) for w in piece] == plain_words(text)
    assert list(words(None)) == list(words(b"")) == [] and len(list(words(text.encode()))) == 3


# --- reversed search -----------------------------------------------------------------------------------------------


def plain_search(docs, items, best=10):
    counts = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_words(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        out += [(i, k, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("pairs", [1 << 20, 40])
def test_reversed_search(spark, pairs):
    docs, items = corpus(random.Random(5))
    d, b = frames(spark, docs, items)
    got = reversed_search.best_documents(d, b, pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items)
    assert len(list(reversed_search.blocks(b, "item_id", "text", 40))) > 3


def test_reversed_search_odd_tables(spark):
    docs, items = corpus(random.Random(6), 20, 3)
    d, b = frames(spark, docs, items)
    assert reversed_search.best_documents(d.limit(0), b).count() == reversed_search.best_documents(d, b.limit(0)).count() == 0
    assert reversed_search.best_documents(d.filter("text is null"), b).count() == 0
    named = reversed_search.best_documents(d, b.selectExpr("concat('i', item_id) as item_id", "text"), best=2)
    assert {r["item_id"] for r in named.collect()} <= {f"i{i}" for i, _ in items if i is not None} | {None}
    with pytest.raises(ValueError):
        reversed_search.best_documents(d, b, key="score")


def test_reversed_search_ties_in_many_copies(spark):
    """A third of all rows are copies: the smallest ids come first, whatever part they are read in."""
    docs = [(i, "alpha beta gamma" if i % 3 == 0 else f"other words {i}") for i in range(3000)]
    d, b = frames(spark, docs, [(1, "beta delta")])
    assert [r["doc_id"] for r in reversed_search.best_documents(d, b).orderBy("rank").collect()] == list(range(0, 30, 3))


# --- decontamination -----------------------------------------------------------------------------------------------


def plain_marks(docs, items, window=10):
    names = {}
    for i, t in items:
        w = plain_words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            names.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, own = plain_words(t), set(), set()
        for size in {len(k) for k in names}:
            for k in range(len(w) - size + 1):
                if (found := names.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    own |= found
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_decontamination(spark, block):
    docs, items = corpus(random.Random(7))
    d, b = frames(spark, docs, items)
    got = decontamination.marked(d, b, block=block)
    assert got.columns == ["doc_id", "text", "score", "item", "rank", *decontamination.ADDED]
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, rows), key=repr) == plain_marks(docs, items)
    # Every match is verbatim, can't be made longer, and has its places.
    texts = {}
    for i, t in items:
        texts.setdefault("" if i is None else str(i), []).append(plain_words(t))
    n = 0
    for r in got.collect():
        w = plain_words(r["text"])
        for m in r["matches"]:
            a, p, size = m["start"], m["item_start"], m["length"]
            own = [x for x in texts[m["item"]] if x[p : p + size] == w[a : a + size]]
            assert own and all(min(a, p) == 0 or w[a - 1] != x[p - 1] for x in own[:1] if len(texts[m["item"]]) == 1)
            assert any(a + size == len(w) or p + size == len(x) or w[a + size] != x[p + size] for x in own)
            n += 1
    assert n > 10
    clean = decontamination.decontaminated(d, b, block=block)
    assert clean.columns == d.columns and clean.count() == sum(not r[-1] for r in plain_marks(docs, items)) > 20


def test_decontamination_odd_tables(spark):
    docs, items = corpus(random.Random(8), 12, 3)
    d, b = frames(spark, docs, items)
    assert decontamination.marked(d.limit(0), b).count() == 0
    none = decontamination.marked(d, b.limit(0)).collect()
    assert len(none) == len(docs) and all(r["n_hit"] == 0 and not r["contaminated"] and r["n_words"] == len(plain_words(r["text"])) for r in none)


def test_suffix_array():
    rnd = random.Random(9)
    for size in (0, 1, 2, 40, 300):
        text = np.array([rnd.randrange(3) for _ in range(size)], np.int64)
        for depth in (1, 4, 10):
            ends = lambda i, depth=depth, text=text: (text[i : i + depth].tolist() + [0] * depth)[:depth]
            cut = lambda i, ends=ends: ends(i)[: ends(i).index(0)] if 0 in ends(i) else ends(i)
            got = decontamination.suffix_array(text, depth).tolist()
            assert sorted(got) == [i for i in range(size) if text[i]]
            assert all(cut(a) <= cut(b) for a, b in zip(got, got[1:], strict=False))


# --- resampling ----------------------------------------------------------------------------------------------------


def plain_resampling(docs, items, ngrams=1, buckets=10_000, least=20, share=10, seed=2024):
    def grams(t):
        w = plain_words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(g for _, x in docs for g in grams(x)), Counter(g for _, x in items for g in grams(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for d, x in docs:
        own = grams(x)
        gains = [math.floor(1000 * math.log((t[g] + 1) * (big_s + buckets) / ((s[g] + 1) * (big_t + buckets)))) for g in own]
        weight = sum(gains) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("ngrams", "share"), [(1, 10), (1, 45), (3, 30), (1, 100), (1, 0)])
def test_resampling(spark, ngrams, share):
    docs, items = corpus(random.Random(10))
    d, b = frames(spark, docs, items)
    got = resampling.resampled(d, b, ngrams=ngrams, share=share)
    assert got.columns == ["doc_id", *resampling.ADDED]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(docs, items, ngrams=ngrams, share=share)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_resampling_of_one_group(spark, doc_id):
    """Most rows have one id and one score: just the share is drawn, ranks run on."""
    docs = [(doc_id, "the same words again and again " * 5)] * 2000 + [(i, f"own words {i} " * 10) for i in range(500)]
    d, b = frames(spark, docs, [(1, "the same words")])
    ranks = sorted(r["rank"] for r in resampling.resampled(d, b).collect() if r["rank"] is not None)
    assert ranks == list(range(1, 251))


def test_resampling_odd_tables(spark):
    docs, items = corpus(random.Random(11), 30, 3)
    d, b = frames(spark, docs, items)
    assert resampling.resampled(d.limit(0), b).count() == 0
    assert sorted(map(tuple, resampling.resampled(d, b.limit(0)).collect()), key=repr) == plain_resampling(docs, [])
    with pytest.raises(ValueError):
        resampling.resampled(d, b, key="text")
