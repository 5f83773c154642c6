"""Line dedup, HTML, packing, near duplicates, media and toxicity: edge cases, brute force, round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import html_text, linededup, media, neardup, packing, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# --- lines ---------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    user = "user {} logged in from host {} at port {} with session {}"
    shared = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, "own words one two three\n" + user.format(1, 2, 3, 4)), (2, user.format(9, 8, 7, 6) + "\nother things stand here alone"), (3, None), (4, ""), (5, "short\nshort"), (6, "short"), (7, shared), (8, "intro to this piece of text\n" + shared)]
    rows += [(9, "same line in one document\nsame line in one document"), (None, "null id has these five words"), (10, "null id has these five words"), (8, "intro to this piece of text\n" + shared), (11, "x y z q r " * 5000)]
    d = docs(spark, *rows).withColumn("n_lines", F.lit("clash"))
    out = linededup.deduplicated(d).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out}
    assert got[1] == (rows[0][1], 2, 0) and got[2] == ("other things stand here alone", 2, 1)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5] == ("short\nshort", 2, 0) and got[6] == ("", 1, 1)
    assert got[7][0] == shared and got[8] == ("intro to this piece of text", 2, 1) and got[9][2] == 0 and got[10] == ("", 1, 1) and got[None][2] == 0
    assert linededup.deduplicated(d.limit(0)).count() == 0
    left = linededup.stage(spark, docs(spark, *rows), "")
    assert left.columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ") and 10 not in {r["doc_id"] for r in left.collect()}


def test_lines_of_any_length(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4))
    long = [word() for _ in range(200)]
    fields = [[*long], [*long]]
    for own in fields:  # five single fields far apart
        for k in (20, 60, 100, 140, 180):
            own[k] = word()
    chinese = "".join(chr(0x4E00 + i) for i in range(300))
    rows = [(1, " ".join(fields[0])), (2, " ".join(fields[1]) + "\nown"), (3, chinese), (4, "own " + word() + "\n" + chinese), (5, "All rights reserved."), (6, word() + "\nAll rights reserved."), (7, "12 34"), (8, "12 34"), (9, "---"), (10, "---\n\n")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linededup.deduplicated(docs(spark, *rows)).collect()}
    assert got[1][1] == 0 and got[2] == ("own", 1) and got[4] == (rows[3][1].split("\n")[0], 1) and got[6][1] == 1
    assert all(got[i] == (dict(rows)[i], 0) for i in (3, 5, 7, 8, 9, 10))
    with pytest.raises(ValueError):
        linededup.deduplicated(docs(spark, *rows), key="lang")


def test_passages_within_lines(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = [sentence(12), sentence(2), sentence(30), sentence(9)]
    own = [sentence(10) for _ in range(6)]
    rows = [(1, f"{own[0]} {' '.join(passage)} {own[1]}"), (2, f"{own[2]} {own[3]}  {' '.join(passage)} Ho. {own[4]}\n{own[5]}"), (3, f"{passage[0]}\n{passage[2]} Ho ho!"), (4, " ".join(passage))]
    got = {r["doc_id"]: (r["text"], r["n_dropped"], r["n_cut"]) for r in linededup.deduplicated(docs(spark, *rows)).collect()}
    assert got[1] == (rows[0][1], 0, 0) and got[2] == (f"{own[2]} {own[3]}  Ho. {own[4]}\n{own[5]}", 0, 4)
    assert got[3] == ("", 2, 0) and got[4] == ("", 1, 0)


# --- html ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<p>a<p>b", "a b"), ("x < y <b>bold</b>er", "x < y bolder"), ("<article>unclosed <p>para <scr", "unclosed para"), ("<table><tr><td>1<td>2</table>", "1 2"), ("<div hidden>h</div>v", "v"),
        ("<nav>n</nav><article><h1>T</h1><div class='ad'>no</div><p>A &amp; B&nbsp;C&#8217;s</p><aside>s</aside><form>f</form><section id=comments><p>c</p></section></article><footer>f</footer>", "T A & B C’s"),
        ("<article><p>a</p><article class=comment>c</article><p>b</p></article>", "a b"), ("<script>var x='</p>';</script><style>p{}</style><p>t</p>", "t"), ("<!-- x > y --><p>t<br>u</p>", "t u"),
        ("<p>" + "<i>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"), ("&lt;b&gt; &unknown; &#x41;", "<b> &unknown; A"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(html_text.parse(page)) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="main-with-sidebar"><article><p>whole</p></article></div>', "whole"), ('<div class="sidebar"><main>whole</main></div>', "whole"), ('<article><h1 class="post-header">T</h1><p class="share">s</p><p title="the hidden gem">g</p></article>', "T s g"),
        ('<article><p>a</p><div class="share-buttons">x</div><p class="ad">y</p><p hidden>z</p><p data-hidden="1">b</p></article>', "a b"),
        ("<article><p>main story</p></article><section id=comments><article><p>reader</p></article></section>", "main story"),
        ("<div><p>The long story stands beside the card, in a plain block of its own.</p></div><article><p>card</p></article>", "The long story stands beside the card, in a plain block of its own. card"),
    ],
)
def test_wrappers_names_and_attributes(page, text):
    assert html_text.main_text(html_text.parse(page)) == text


def test_counts_alone_find_page_parts(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    words = lambda n: " ".join(word() for _ in range(n))
    stories = [[words(rnd.randint(3, 30)) for _ in range(rnd.randint(1, 6))] for _ in range(60)]
    page = "<body><ul class=top>{}</ul><div class=x>{}</div><article><h1>{}</h1>{}</article><div class=y><b>&copy;</b> {}</div></body>"
    rows = [(i, f"http://h/{i}", page.format("".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(3 + i % 4)), words(20), own[0], "".join(f"<p>{p}</p>" for p in own[1:]), words(9))) for i, own in enumerate(stories)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(pages, names=False).collect()}
    assert got == {i: " ".join(own) for i, own in enumerate(stories)}
    hosts = spark.createDataFrame([("h", i, r[2]) for i, r in enumerate(rows)], "host string, mark long, html string")
    gone = {r["mark"]: {h & (1 << 64) - 1 for h in r["gone"]} for r in html_text.template_subtrees(hosts).collect()}
    for i, r in enumerate(rows):  # all three parts beside the article are templates, by their form
        tree = html_text.parse(r[2])
        own = dict(html_text.candidates(tree))
        parts = [k for k, up in enumerate(tree.parents) if tree.tags[up] == "body" and tree.tags[k] in ("ul", "div")]
        assert len(parts) == 3 and all(gone[i] & set(own[k]) for k in parts)


def test_long_page_and_clashing_columns(spark):
    body = "<article>" + "<p>word &amp; more</p>" * 40000 + "</article>"
    pages = spark.createDataFrame([(1, "http://h/1", body, "x", 5)], "page_id bigint, url string, html string, text string, n_chars int")
    out = html_text.extracted(pages).collect()
    assert out[0]["text"] == " ".join(["word & more"] * 40000) and out[0]["n_chars"] == 5


def test_templates_of_a_host(spark):
    page = "<body><div class=x1><p>Our shop</p><p>Call us</p></div><div><p>Story {}</p></div><div class=x2>All rights {}</div></body>"
    rows = [(i, f"http://h/{i}", page.format(i, "reserved")) for i in range(20)] + [(20, "http://other/1", page.format("x", "reserved")), (21, None, None), (22, "http://h/22", ""), (0, "http://h/0", page.format(0, "reserved"))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    out = html_text.extracted(pages).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[3] == "Story 3" and got[0] == "Story 0" and got[20] == "Our shop Call us Story x All rights reserved" and got[21] == "" and got[22] == ""
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    pages = spark.createDataFrame([(i, "http://h/", "<div><p>Only text</p></div>") for i in range(30)], "page_id bigint, url string, html string")
    assert {r["text"] for r in html_text.extracted(pages).collect()} == {"Only text"}


def test_units_are_found_again_by_their_places(spark):
    """What is compared token by token is cut from the stored text, which isn't parsed a second time."""
    texts = ["one  two\tx9 three.\n\n ends here", "a b c d e f g h. i j k l m n o p 5! q\nnext é line", "", None]
    rows = spark.createDataFrame([(i, i, t.encode() if t is not None else None) for i, t in enumerate(texts)], "doc bigint, key bigint, raw binary")
    for r in linededup._units(rows).collect():
        found = [(no, linededup.masked(bytes(r["even"])[at : at + size])) for no, at, size in zip(r["no"], r["at"], r["size"], strict=True)]
        assert found == list(linededup.units((texts[r["doc"]] or "").encode()))


# --- packing -------------------------------------------------------------------------------------------------------


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing._vocabulary()
    whole, own, rnd = Tokenizer.from_file(path), packing.WordIds(path), random.Random(5)
    letters = list("aAbBzZ09.,,..'\"-_!?<|> \t\néÉßİ́ ẞΣςÅ²Ⅰ٠一あ​\x1c\x85 \U0001f600ǅ") + ["'s", "<|endoftext|>"]
    texts = ["", " ", "<|endoftext|> x <|ENDOFTEXT|>y"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    for t, ids in zip(texts, own([t.encode() for t in texts]), strict=True):
        assert whole.encode(t, add_special_tokens=False).ids == ids.tolist()


def test_words_with_marks_share_their_letters_ids(monkeypatch):
    """A word is tokenized once, whatever marks follow it and however often it stands in the texts looked at together."""
    from tokenizers import Tokenizer

    path = packing._vocabulary()
    whole, own = Tokenizer.from_file(path), packing.WordIds(path)
    texts = [" zebra zebra. zebra*** Größe größe, größe&&&\tdon't don't. x9. ", "größe*** zebra, <|x|> İx İx."]
    told = lambda: [ids.tolist() for ids in own([t.encode() for t in texts])]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert told() == want
    known = own.known.to_pylist()
    assert {"zebra", "größe", ".", ",", "***"} < set(known) and not any(w.startswith("zebra") and w != "zebra" for w in known) and len(known) == len(set(known))
    monkeypatch.setattr(packing, "CACHE", 3)
    assert told() == want and told() == want


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    texts = [None, "", "one"] + [" ".join(rnd.choice(["red", "blue", "seven", "Zebra", "x9."]) for _ in range(rnd.choice([3, 50, 700, 6000]))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "nameless")]
    out = packing.packed(docs(spark, *rows).withColumn("length", F.lit(1)), packing._vocabulary(), ids=False).toPandas()
    t = Tokenizer.from_file(packing._vocabulary())
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in rows if i is not None}
    for i, ids in want.items():
        own = out[out.doc_id == i].drop_duplicates(["start", "length"]).sort_values("start") if i != 3 else None
        if own is not None:
            assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        for r in out[out.doc_id == i].itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert out.length.sum() == sum(len(want[i]) for i, _ in rows if i is not None) + len(t.encode("nameless").ids) + 1
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = s.length.sum()
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and total <= 4096 and (total & (total - 1)) == 0
    assert packing.packed(docs(spark, (1, "x")).limit(0), packing._vocabulary()).count() == 0


def test_many_equal_rows_are_packed_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 1 << 12)
    rows = [(None, "the same words again and again")] * 3000 + [(7, "other words, as often repeated")] * 3000
    out = packing.packed(docs(spark, *rows).repartition(4), packing._vocabulary()).toPandas()
    sizes = out.groupby(out.sequence_id // 2**32).length.sum()
    assert len(out) >= 6000 and len(sizes) > 5 and sizes.max() < 3 * packing.SHARD


def test_units_by_a_plain_walk():
    """Lines before their sentences, by one walk over tokens."""

    def plain(text):
        no, out = 0, []
        for line in text.split(b"\n"):
            tokens = line.split()
            cut, parts = [], []
            for t in tokens:
                cut.append(t)
                if t[-1:] in (b".", b"!", b"?"):
                    parts.append(cut)
                    cut = []
            parts += [cut] if cut or not parts else []
            told = lambda own: b" ".join(b"<*>" if any(48 <= c <= 57 for c in t) else t for t in own)
            lettered = lambda own: any(chr(c).isalpha() or c > 127 for t in own.split(b" ") for c in t)
            if lettered(told(tokens)):
                out.append((no, told(tokens)))
            no += 1
            if len(parts) > 1:
                out += [(no + k, told(p)) for k, p in enumerate(parts) if len(p) >= linededup.SENTENCE and lettered(told(p))]
                no += len(parts)
        return out

    rnd = random.Random(12)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "bc", "é", "d4", "5", ".", "!", "?", ". ", "? ", " ", "  ", "\t", "\r", "\n", "x y z u v w q r. "]) for _ in range(rnd.randrange(60))).encode()
        assert list(linededup.units(text)) == plain(text), text


def test_neighbours_share_rare_terms():
    shard = [np.array([7, 8, 1000 + 3 * i, 1001 + 3 * i, 1002 + 3 * i], np.uint16) for i in range(50)]
    shard[1][2:4] = shard[0][2:4]
    shard[2][2] = shard[0][4]
    index, unused = packing.Index(shard), np.ones(50, bool)
    unused[0] = False
    assert index.neighbours(0, unused).tolist() == [1, 2]  # 7 and 8 are in all texts and tell nothing
    unused[1] = False
    assert index.neighbours(0, unused).tolist() == [2] and index.neighbours(9, unused).tolist() == []


# --- near duplicates -----------------------------------------------------------------------------------------------


def components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows, n = [(0, None), (1, ""), (2, " \n"), (3, "a b c"), (4, "A b c"), (5, "a b c d"), (6, "q " * 5000)], 7
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(6, 120))]
        for _ in range(rnd.randint(1, 6)):
            own = base[:]
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    for _ in range(60):  # a passage that many texts share, in every share of the text
        own = passage + [rnd.choice(words) for _ in range(rnd.randint(1, 50))]
        rows.append((n, " ".join(own)))
        n += 1
    want = components(rows)
    d = docs(spark, *rows).withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.linked(d).collect()}
    assert got == want
    kept = neardup.stage(spark, docs(spark, *rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, (_, c) in want.items() if c == i]
    twice = neardup.linked(docs(spark, (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "lone"), (2, "x")))
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in twice.collect()) == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]
    assert neardup.linked(d.limit(0)).count() == 0


def test_stage_with_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(9)
    base = [" ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(80)) for _ in range(8)]
    rows = [(None, base[0]), (None, base[0]), (None, base[1] + " end"), (None, base[1]), (None, base[2]), (4, base[2] + " end")]  # no id at all; an id beats none
    rows += [(5, base[3]), (5, base[4]), (2, base[4] + " end"), (6, base[3] + " end")]  # of two texts under 5 one is a near duplicate of 2
    rows += [(7, base[5]), (7, base[5] + " end"), (7, base[5]), (8, base[6]), (8, base[7]), (None, None), (9, " "), (9, " ")]
    d = docs(spark, *rows)
    names = {t: k for k, b in enumerate(base) for t in (b, b + " end")}

    def groups(found):  # ids and groups of the texts with words that stay
        return sorted((i is None, i or 0, names[t]) for i, t in found if (t or "").strip())

    # Brute force: of each group the smallest id, one text of it.
    want = groups([min(((i, t) for i, t in rows if names.get(t) == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in range(8)])
    out = [(r["doc_id"], r["text"]) for r in neardup.stage(spark, d, "").collect()]
    assert groups(out) == want and len(set(out) - set(rows)) == 0
    assert sum(not (t or "").strip() for _, t in out) == 3
    # The whole pipeline over one source, where the mix takes every document once; without labels of both classes none is toxic.
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by_id = lambda found: {r["doc_id"]: r["n"] for r in found.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    packed = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    words = [r for r in out if (r[1] or "").strip()]  # the mix takes no text without words
    assert packed == by_id(packing.stage(spark, docs(spark, *words), "")) and packed[None] > 0


def test_chain_of_components(spark, monkeypatch):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(20)] + [(bytes([100]), bytes([101]))], "a binary, b binary")
    for most in (neardup.SENT, 3):  # the second time most joins are shuffles
        monkeypatch.setattr(neardup, "SENT", most)
        labels, groups = neardup.Labels(spark.createDataFrame([], "node binary, root binary")), defaultdict(set)
        for part in (edges.filter("a < X'0A'"), edges.filter("a >= X'0A'")):
            labels = labels.merged(part, part.count())
        assert labels.n == labels.rows.count()
        for r in labels.rows.collect():
            groups[bytes(r["root"])].add(bytes(r["node"]))
        assert {len(v | {k}) for k, v in groups.items()} == {21, 2}


def test_estimates_of_long_chains_stay_small(spark):
    """The planner's estimate of the labels' size doesn't grow with the passes that a chain takes."""
    estimates = []
    for n in (2, 64):
        edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n)], "a binary, b binary")
        labels = neardup.Labels(spark.createDataFrame([], "node binary, root binary")).merged(edges, n)
        assert sorted((bytes(r["node"]), bytes(r["root"])) for r in labels.rows.collect()) == [(bytes([i + 1]), b"\0") for i in range(n)]
        estimates.append(labels.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
    assert estimates[1] < estimates[0] + 64


# --- media ---------------------------------------------------------------------------------------------------------


def test_media_codecs():
    rnd = np.random.default_rng(0)
    grey = rnd.integers(0, 256, (5, 7), np.uint8)
    for encode in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(encode(grey))[1] == grey).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0")[1].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 255 7 250")[1].tolist() == [[7, 250]] and media.decode(b"P3 1 1 255 1 2 3")[1].tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n9 1\n" + bytes([0b10000000, 0b10000000]))[1].tolist() == [[0] + [255] * 7 + [0]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03")[1].tolist() == [[[1, 2, 3]]] and media.decode(b"P5 1 1 65535\n\x01\x02")[1].tolist() == [[258]]
    area = media.area_resize(grey.astype(float), 2, 3)
    wide = np.kron(grey, np.ones((2, 3)))  # each output sample is the mean of whole cells of the blown-up image
    assert np.allclose(area, wide.reshape(2, 5, 3, 7).mean(axis=(1, 3)))
    for broken in (b"", b"P5", b"P5 9 9 255\n\x00", b"BM", b"GIF89a", b"P7"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_media_columns(spark):
    texts = [None, "", "a" * 64, "é" * 1000, "x" * 200000, "b"]
    d = docs(spark, *enumerate(texts), (5, "b")).withColumn("media", F.lit("clash"))
    out = media.media_tiles(media.text_media(d), samples=True).collect()
    assert len(out) == 7
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert bytes(r["samples"]) == payload and r["n_bytes"] == len(raw) and r["width"] == 64 and r["error"] is None
        tile = np.lib.format.read_array(__import__("io").BytesIO(bytes(r["tile_npy"])))
        assert tile.shape == (32, 32) and len(r["dhash"]) == 16
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id int, media binary")
    assert all(r["error"] and r["dhash"] is None for r in media.media_tiles(odd).collect())
    assert media.media_tiles(odd.limit(0)).count() == 0


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rnd = random.Random(1)
    plain, bad = [f"{a}{b}{c}" for a in ("lo", "mi", "ta") for b in ("ra", "ne", "su") for c in ("n", "l", "k")], ["grubbish", "vilewort", "scoundrel"]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, told = docs(spark, *rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(d, told)
    odd = docs(spark, (1000, None), (1001, ""), (1002, "lora " * 20000), (1003, "lora grubbishh mine tasul"), (1004, "lora lora"), (1004, "lora lora")).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(odd, model).collect()}
    assert got[1003] > 0.5 and max(got[i] for i in (1000, 1001, 1002, 1004)) < 0.5
    held = {r["doc_id"]: r["score"] for r in toxicity.scored(d, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in held.items()]) > 0.95
    assert toxicity.fit(d, told.filter("toxic = 0")) is None and toxicity.fit(d, told.limit(0)) is None
    assert {r["score"] for r in toxicity.scored(d, None).collect()} == {0.0}
    assert toxicity.scored(d.limit(0), model).count() == 0


def test_subword_table():
    owner, bucket = toxicity.gram_table(["ab", "...", "abc", "ab."])
    of = lambda i: sorted(bucket[owner == i].tolist())
    grams = sum(max(0, len("<ab>") - n + 1) for n in toxicity.GRAMS)
    assert of(0) == of(3) and of(1) == [] and len(of(0)) == grams + 1 and hashlib and len(toxicity.gram_table([])[0]) == 0


def toxic_texts(seed, n=900):
    rnd = random.Random(seed)
    plain, bad = [f"{a}{b}{c}" for a in ("lo", "mi", "ta") for b in ("ra", "ne", "su") for c in ("n", "l", "k")], ["grubbish", "vilewort", "scoundrel"]
    texts = [[rnd.choice(plain) for _ in range(rnd.randint(5, 120))] for _ in range(n)]
    for own in texts[::4]:
        own[rnd.randrange(len(own))] = rnd.choice(bad)
    return texts, plain, bad, rnd


def test_toxic_word_in_a_long_token(spark):
    texts, plain, bad, rnd = toxic_texts(5)
    model = toxicity.train([" ".join(t) for t in texts], [int(i % 4 == 0) for i in range(len(texts))])
    rows = []
    for i, joint in enumerate(["", "", ".", "_", "/"] * 4):
        own = [rnd.choice(plain) for _ in range(400)]
        rows += [(2 * i, joint.join(own)), (2 * i + 1, joint.join([*own[:300], bad[i % 3], *own[300:]]))]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs(spark, *rows), model).collect()}
    assert all(got[2 * i] < 0.5 < got[2 * i + 1] for i in range(20))
    pieces = toxicity.tokens("Ab " + "".join(map(chr, range(0x4E00, 0x4E00 + 1000))) + " ..." + "x" * 64 + "...")
    assert pieces[0] == "ab" and pieces[-1] == "..." + "x" * 64 + "..." and max(map(len, pieces[1:-1])) <= 64
    grams = {p[i : i + n] for p in pieces[1:-1] for n in toxicity.GRAMS for i in range(len(p) - n + 1)}
    assert all("".join(map(chr, range(c, c + n))) in grams for n in toxicity.GRAMS for c in range(0x4E00, 0x4E00 + 1001 - n))


def test_toxic_neighbours_anywhere(spark):
    scores = np.zeros(toxicity.BUCKETS, np.float32)
    for w in ("foul", "vile"):
        scores[toxicity.gram_table([w])[1]] = 1.0
    model = toxicity.Model(scores, -1.5)
    # Two neighbours in every place, and different words of one score, which both count; a repeated word counts once.
    rows = [(i, " ".join(["a"] * i + ["foul", "vile"] + ["a"] * (60 - i))) for i in range(61)] + [(100, "foul foul" + " a" * 60)]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs(spark, *rows), model).collect()}
    assert np.allclose([got[i] for i in range(61)], 1 / (1 + np.exp(-0.5))) and np.isclose(got[100], 1 / (1 + np.exp(0.5)))


def test_scores_equal_a_plain_computation(spark):
    texts, plain, bad, rnd = toxic_texts(11, 300)
    model = toxicity.train([" ".join(t) for t in texts], [int(i % 4 == 0) for i in range(len(texts))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts[:60])] + [(60, "lora"), (61, "... !!"), (62, ""), (63, None), (64, "lora lora mine"), (65, "LORA, (mine)")]

    def word(w):
        buckets = toxicity.gram_table([w])[1]
        return sum(float(model.scores[b]) for b in buckets) / len(buckets) if len(buckets) else 0.0

    def plain_score(text):
        words = (text or "").lower().split()
        each = [0.0 if i and w == words[i - 1] else word(w) for i, w in enumerate(words)]
        n = min(len(words), toxicity.WINDOW)
        best = max((sum(each[i : i + n]) / max(n, toxicity.WINDOW // 2) * toxicity.WINDOW for i in range(len(words) - n + 1)), default=0.0) if words else 0.0
        return 1 / (1 + np.exp(-(best + model.bias)))

    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs(spark, *rows), model).collect()}
    assert len(got) == len(rows) and all(np.isclose(got[i], plain_score(t), atol=1e-5) for i, t in rows)


def test_one_long_labelled_text(spark):
    texts, *_ = toxic_texts(6)
    chars = sum(len(" ".join(t)) for t in texts)
    d = docs(spark, *[(i, " ".join(t)) for i, t in enumerate(texts)], *[(i, "lora mine tasul " * (chars // 10)) for i in range(1000, 1020)])
    told = spark.createDataFrame([(i, int(i % 4 == 0 and i < 1000)) for i in [*range(len(texts)), *range(1000, 1020)]], "doc_id bigint, toxic int")
    model = toxicity.fit(d, told, chars=chars)
    held = {r["doc_id"]: r["score"] for r in toxicity.scored(d.filter("doc_id < 1000"), model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in held.items()]) > 0.95
    with pytest.raises(ValueError):
        toxicity.fit(d.filter("doc_id % 4 = 1"), told)
    sizes = [5, 100, 0, 40, 1000]
    assert toxicity.fair_share(sizes, 2000) >= 1000 and toxicity.fair_share([], 9) == 9
    assert all(sum(min(n, s) for n in sizes) <= t < sum(min(n, s + 1) for n in sizes) for t in range(1, 1145) for s in [toxicity.fair_share(sizes, t)])
    long = "".join(chr(0x4E00 + i) for i in range(5000))
    cut = spark.createDataFrame([(long,), ("short",), (None,)], "t string").select(toxicity._thinned(F.col("t"), 800).alias("t")).collect()
    assert len(cut[0]["t"]) <= 800 and cut[0]["t"][0] == long[0] and cut[0]["t"][-1] == long[-1] and (cut[1]["t"], cut[2]["t"]) == ("short", None)
