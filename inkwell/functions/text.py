"""Text functions on columns: normalizing, hashing, front matter, excerpts, windows, redaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BIDIRECTIONAL, EXCERPT_MAX, SPACE, WINDOW_CHARS
from .redaction import redact

_FRONT = r"^---[ \t]*\n((?:[\s\S]*?))\n---[ \t]*(?:\n|$)"


def strip(c: Column) -> Column:
    """c without white space at its ends, as Python's str.strip."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank_to_null(c: Column) -> Column:
    """A filter value: stripped, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """One leading byte-order mark dropped, \\r\\n and \\r as \\n."""
    return F.regexp_replace(F.regexp_replace(c, "^\ufeff", ""), "\r\n?", "\n")


def text_error(raw: Column) -> Column:
    """Why bytes can't be a document's text; null where they can."""
    return F.when(~F.is_valid_utf8(raw.cast("string")), "not UTF-8").when(F.contains(raw, F.lit(b"\x00")), "contains NUL")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def front_matter(text: Column) -> Column:
    """key -> value of the block at the start of the text, null where there is none.

    The later of repeated keys wins, values lose comments and outer white space, quotes stay.
    """
    # Null where the pattern doesn't match: an empty block still is one.
    lines = F.filter(F.split(F.regexp_extract(text, _FRONT, 1), "\n", -1), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(cut_comment(F.regexp_replace(x, "^[^:]*:", ""))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(text.rlike(_FRONT), F.map_from_entries(last))


def body(text: Column) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(text, _FRONT, "")


def cut_comment(value: Column) -> Column:
    """value up to the white space before the first # that follows white space."""
    return F.regexp_replace(value, f"(?s)(?<![{SPACE}])[{SPACE}]+#.*$|^[{SPACE}]+#.*$", "")


def search_text(heading_path: Column, content: Column) -> Column:
    """What keyword search, embedding and excerpts see of a chunk."""
    return F.concat(F.coalesce(heading_path, F.lit("")), F.lit(" "), content)


def event_text(title: Column, summary: Column, root_cause: Column, resolution: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, summary, root_cause, resolution)]
    return F.concat(parts[0], *[x for p in parts[1:] for x in (F.lit(" "), p)])


def clip(c: Column, most: int = EXCERPT_MAX) -> Column:
    """At most `most` characters, the last an ellipsis where something was cut; '' for null."""
    return F.when(c.isNull(), "").when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: lambdas compute other expressions anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(text: Column, chars: int = WINDOW_CHARS) -> Column:
    """Consecutive windows of a text as structs of no, text, offset, next_offset, total_bytes and truncated (bytes).

    One pass cuts the text; a window's offset is a sum of whole blocks of windows and of the windows in its own block, so
    the work grows with the text.
    """
    block = 256
    parts = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, n: acc + n)
    floor = lambda n: F.floor(n / block).cast("int")

    def placed(ps: Column, sizes: Column, sums: Column) -> Column:
        whole = total(sizes)

        def one(p: Column, i: Column) -> Column:
            offset = total(F.slice(sums, F.lit(1), floor(i))) + total(F.slice(sizes, floor(i) * block + 1, i % block))
            end = offset + F.octet_length(p)
            return F.struct(i.alias("no"), p.alias("text"), offset.alias("offset"), end.alias("next_offset"), F.lit(0).cast("long").alias("total_bytes"), F.lit(False).alias("truncated"))

        told = F.transform(ps, one)
        return let(whole, lambda n: F.transform(told, lambda w: w.withField("total_bytes", n).withField("truncated", w["next_offset"] < n)))

    def summed(sizes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), floor(F.size(sizes) - 1)), lambda b: total(F.slice(sizes, b * block + 1, F.lit(block))))

    return let(parts, lambda ps: let(F.transform(ps, lambda p: F.octet_length(p).cast("long")), lambda sizes: let(summed(sizes), lambda sums: placed(ps, sizes, sums))))


def clip_error(c: Column) -> Column:
    """An error message without payload: cut where one starts, redacted, its first line, 500 characters."""
    cut = F.regexp_replace(c, r"""(?s)\{["'].*$""", "")
    return F.substring(F.regexp_extract(redact(cut), "^[^\n]*", 0), 1, 500)


def printable(c: Column) -> Column:
    """Control characters as \\xNN, bidirectional marks and line and paragraph separators as \\uNNNN; all others as they are."""
    odd = r"\x00-\x1f\x7f-\x9f" + BIDIRECTIONAL + r"\u2028\u2029"

    def one(x: Column) -> Column:
        code = F.lower(F.hex(F.encode(x, "UTF-16BE")))
        return F.when(~x.rlike(f"^[{odd}]$"), x).when(code.startswith("00"), F.concat(F.lit("\\x"), F.substring(code, 3, 2))).otherwise(F.concat(F.lit("\\u"), code))

    return F.when(c.rlike(f"[{odd}]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def iso(c: Column) -> Column:
    """A timestamp as ISO 8601 with offset, microseconds where there are any."""
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
