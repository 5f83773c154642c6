"""Search tokens, query parsing and keyword rank."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, or digits with the hyphen that joins them to digits before; hosts and e-mail addresses aren't special.
TOKEN = r"(?<=[0-9])-[0-9]+|[\p{L}\p{N}]+"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens in order; positions are indices from 1. No stop words, no stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(query: Column) -> Column:
    """The distinct tokens of a plain query, all of which must match."""
    return F.array_distinct(tokenize(query))


def term_weight(count: Column) -> Column:
    """The rank of one term that occurs so often (at most 255 occurrences count)."""
    sums = list(itertools.accumulate(1.0 / (j * j) for j in range(1, 256)))
    squares = F.when(count > 0, F.element_at(F.lit(sums), F.least(count.cast("int"), F.lit(255)))).otherwise(0.0)
    return 0.1 * squares / 1.64493406685


def length_norm(n_tokens: Column) -> Column:
    return F.log2(n_tokens + 1)


def parse_web_query(query: str | None) -> list[dict]:
    """A web-style query as OR groups: {'all': [[terms of a phrase]...], 'none': [[...]...]}.

    Quotes make phrases, OR separates groups, a leading - excludes. Never raises. Groups of exclusions alone are
    dropped: they are true for an empty document.
    """
    groups: list[dict] = [{"all": [], "none": []}]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query or ""):
        if word == "OR" and not minus:
            groups.append({"all": [], "none": []})
            continue
        text = (phrase or word).lower()
        terms = [m[0] for m in re.finditer(r"(?<=[0-9])-[0-9]+|[^\W_]+", text)]
        if terms:
            groups[-1]["none" if minus else "all"].append(terms)
    return [g for g in groups if g["all"]]
