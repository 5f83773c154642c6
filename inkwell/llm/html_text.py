"""Main text of web pages by site template removal: element subtrees that recur over a host's pages are deleted."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, tidy
from .urls import host_and_path

#: A subtree is a site's template if so many different pages of the host have it, and this share of them.
MIN_PAGES, MIN_SHARE = 4, 0.02

# Elements of the HTML standard by role, and usual names of page parts.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
WORDLESS = frozenset("script style textarea title xmp iframe noembed noframes noscript head template object svg math canvas audio video button select option datalist".split())
PAGE_PARTS = frozenset("nav header footer aside form dialog menu".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr thead tbody tfoot blockquote pre figcaption caption summary address".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond teaser related recommended ad ads advert promo".split())
LINE_NAMES = frozenset("ad ads advert advertisement sponsored promo comment comments".split())
NOISE_NAMES = COMMENT_NAMES | frozenset(
    "adverts advertisement advertising advertorial sponsor sponsored promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside header masthead footer "
    "cookie cookies consent gdpr notice notices alert alerts newsletter subscribe signup popup modal overlay share sharing social widget login pagination pager toolbar contentinfo complementary".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?][^>]*>)""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """A parsed page: its nodes in page order and its text runs, each with the node that holds it."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [0])
    #: Never part of a text (scripts, what is hidden); noise by its tag or name.
    mute: list[bool] = field(default_factory=lambda: [False])
    noise: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    #: Hashes of each subtree with its texts, and of its tags and attribute names alone.
    hashes: list[int] = field(default_factory=lambda: [0])
    shapes: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str]] = field(default_factory=list)


def _traits(tag: str, attributes: str) -> tuple[bool, bool, bool, str]:
    """Whether the element is mute, noise, the page's main part, by its tag and attributes; and its shape's name.

    Names are compared whole and by their first and last part between - or _; in single text blocks and inline whole, by a few.
    """
    mute, noise, main, shape = tag in WORDLESS, tag in PAGE_PARTS, tag in ("article", "main"), [tag]
    for name, value in _ATTRIBUTE.findall(attributes or ""):
        name, value = name.lower(), value.strip("\"'").lower()
        shape.append(name)
        if name == "hidden":
            mute = True
        elif name == "style":
            mute |= bool(_HIDDEN.search(value))
        elif name == "aria-hidden":
            mute |= value == "true"
        elif name in ("class", "id", "role"):
            main |= name == "role" and value == "main"
            shape += [re.sub("[0-9]+", "#", value)]
            if tag in ("html", "body", "main"):
                continue
            words = value.split()
            if tag in TEXT_BLOCKS or tag in INLINE:
                noise |= not LINE_NAMES.isdisjoint(words)
            else:
                ends = {parts[k] for w in words for parts in [re.split("[-_]", w)] for k in (0, -1)}
                noise |= not (COMMENT_NAMES if tag == "article" else NOISE_NAMES).isdisjoint(ends.union(words))
    return mute, noise, main and not noise and not mute, " ".join(shape)


def parse(text: str) -> Page:
    """A tolerant reading: unclosed and stray tags, broken comments and a page cut short all give a tree."""
    page, stack, sums, forms = Page(), [0], [xxhash.xxh64()], [xxhash.xxh64()]
    opened: dict[str, int] = {}
    at, end = 0, len(text)

    def add(run: str) -> None:
        page.runs.append((stack[-1], run))
        sums[-1].update(run.encode("utf-8", "surrogatepass"))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            node, own, form = stack.pop(), sums.pop(), forms.pop()
            opened[page.tags[node]] -= 1
            page.hashes[node] = own.intdigest()
            page.shapes[node] = form.intdigest()
            sums[-1].update(own.digest())
            forms[-1].update(form.digest())
            if page.tags[node] not in INLINE:
                page.runs.append((stack[-1], " "))

    def close(tags: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        if any(opened.get(t) for t in tags):
            for depth in range(len(stack) - 1, 0, -1):
                tag = page.tags[stack[depth]]
                if tag in tags:
                    return close_to(depth)
                if tag in barrier:
                    return None
        return None

    while at < end:
        lt = text.find("<", at)
        if lt < 0:
            add(text[at:])
            break
        if lt > at:
            add(text[at:lt])
        m = _TAG.match(text, lt)
        if not m:
            nxt = text[lt + 1 : lt + 2]
            if nxt.isalpha() or nxt in ("/", "!", "?"):  # a tag cut short, or with a broken quote
                gt = text.find(">", lt)
                at = end if gt < 0 else gt + 1
            else:
                add("<")
                at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                stop = text.find("-->", at - 2 if text.startswith((">", "->"), at) else at)
                at = end if stop < 0 else stop + 3
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            close((tag,), () if tag in ("article", "main", "body", "html") else ("article", "main", "table"))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                page.runs.append((stack[-1], " "))
            continue
        if tag not in INLINE:
            if opened.get("p"):
                close(("p",), ("article", "main", "table", "div", "section"))
            if tag in _CLOSES:
                close(_CLOSES[tag], ("ul", "ol", "dl", "table", "select"))
            page.runs.append((stack[-1], " "))
        if tag in INLINE and not attributes:
            continue  # without attributes it changes nothing; its end tag finds nothing open
        node = len(page.tags)
        mute, noise, main, shape = _traits(tag, attributes)
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.mute.append(mute)
        page.noise.append(noise)
        page.main.append(main)
        page.hashes.append(0)
        page.shapes.append(0)
        stack.append(node)
        forms.append(xxhash.xxh64(b"shape " + shape.encode("utf-8", "surrogatepass")))
        sums.append(xxhash.xxh64(f"<{tag} {attributes}".encode("utf-8", "surrogatepass")))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(text, at)
            sums[-1].update(text[at : stop.start() if stop else end].encode("utf-8", "surrogatepass"))
            at = stop.start() if stop else end
    close_to(1)
    return page


def _places(page: Page) -> tuple[list[bool], list[bool]]:
    """Of each node whether it is or holds a main part, and whether it is or stands inside one."""
    holds, inside = list(page.main), list(page.main)
    for i in range(len(page.tags) - 1, 0, -1):
        holds[page.parents[i]] |= holds[i]
    for i in range(1, len(page.tags)):
        inside[i] |= inside[page.parents[i]]
    return holds, inside


def candidates(page: Page) -> list[tuple[int, list[int]]]:
    """The nodes that may be templates of the site, each with the hashes that count.

    What holds the main part or is it can't be one. Inside it, and in pages that mark none, a subtree counts with its
    texts; inside it only containers count, as its paragraphs are the article even where they recur. Outside it,
    subtrees also count by their tags and attributes alone, as menus and footers keep their form where words change.
    """
    holds, inside = _places(page)
    marked = holds[0]
    out = []
    for i in range(1, len(page.tags)):
        tag = page.tags[i]
        if holds[i] or tag in ("html", "head", "body") or tag in WORDLESS or tag in INLINE:
            continue
        if marked and inside[i]:
            if tag not in TEXT_BLOCKS:
                out.append((i, [page.hashes[i]]))
        else:
            out.append((i, [page.hashes[i], page.shapes[i]] if marked else [page.hashes[i]]))
    return out


def subtree_hashes(page: Page) -> list[int]:
    """The distinct hashes of the subtrees that may be templates."""
    return sorted({h for _, own in candidates(page) for h in own})


def main_text(page: Page, templates: frozenset[int] = frozenset(), names: bool = True) -> str:
    """The page's text less its site's templates, then less what tags and names call noise (not without `names`).

    Where main parts are marked and hold at least half of what is left, they are the text. Noise by name doesn't count
    where all main parts stand inside it: then it is only a wrapper's name.
    """
    n = len(page.tags)
    holds, inside = _places(page)
    template = [False] * n
    for i, own in candidates(page) if templates else ():
        template[i] = not templates.isdisjoint(own)
    noise = list(page.noise) if names else [False] * n

    def gone_with(noise: list[bool]) -> list[bool]:
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[page.parents[i]] or page.mute[i] or template[i] or noise[i]
        return gone

    gone = gone_with(noise)
    if holds[0] and all(gone[i] for i in range(n) if page.main[i]):
        gone = gone_with([x and not h for x, h in zip(noise, holds, strict=True)])
    left = [(node, run) for node, run in page.runs if not gone[node]]
    size = lambda runs: sum(len(run) - run.count(" ") for _, run in runs)
    main = [x for x in left if inside[x[0]]]
    if main and 2 * size(main) >= size(left):
        left = main
    return " ".join(entities.unescape("".join(run for _, run in left)).split())


def template_subtrees(pages: DataFrame) -> DataFrame:
    """host, mark, gone: for each different page (mark) of a host the hashes of its template subtrees.

    pages: host, mark, html. Copies of a page count once, so that a page with many copies isn't its own template. All
    counts combine before the shuffle; a host of any size is dealt out by subtree.
    """
    shape = pages.select("host", "mark").schema.add("subtree", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                own = subtree_hashes(parse(text or ""))
                take += [r] * len(own)
                found += own
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.array(found, np.uint64).view(np.int64))], names=shape.names)

    seen = stored(pages.select("host", "mark", "html").mapInArrow(tidy(task), shape).distinct(), "html-subtrees")
    sizes = pages.select("host", "mark").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES)
    often = often.join(sizes, "host").filter(F.col("n") >= F.col("pages") * MIN_SHARE).select("host", "subtree")
    return seen.join(often, ["host", "subtree"]).groupBy("host", "mark").agg(F.collect_set("subtree").alias("gone"))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", names: bool = True) -> DataFrame:
    """pages with its html column replaced by the main text (an empty string where there is none).

    Subtrees that recur over a host's pages are deleted first; what tags and names call noise goes after them, for hosts
    of few pages (not at all without `names`).

    Null html counts as empty; null urls and urls without a host are pages of one nameless host; repeated rows are
    repeated in the result; an empty table gives an empty result. Other columns stay; one named like the text goes.
    """
    keep = [c for c in pages.columns if c not in (html, text)]
    host, _ = host_and_path(F.col(url))
    rows = pages.select(*keep, F.col(html).alias("__html"), host.alias("__host"), F.xxhash64(html).alias("__mark"))
    gone = template_subtrees(rows.select(F.col("__host").alias("host"), F.col("__mark").alias("mark"), F.col("__html").alias("html")))
    rows = rows.join(gone, (F.col("__host") == F.col("host")) & (F.col("__mark") == F.col("mark")), "left").select(*keep, "__html", "gone")
    shape = pages.select(*keep).schema.add(text, "string")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, lists = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            texts = [main_text(parse(s), frozenset(h & 0xFFFFFFFFFFFFFFFF for h in g or ()), names) if s else "" for s, g in zip(sources, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=shape.names)

    return rows.mapInArrow(tidy(task), shape)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length."""
    out = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
