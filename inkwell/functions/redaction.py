"""Secrets in free text: a scanner for connection strings and keys, and its column function."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MASK = "***"
#: Where a secret may begin: a location's scheme, an assignment to a name that ends in password, an interface key.
_OPENING = re.compile(r"(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*://)|(?P<name>[A-Za-z0-9_.-]*password[ \t]*=\s*)|(?P<key>(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]{8,})", re.I)
_TOKEN = re.compile(r"\S*")


def _secret_name(raw: str) -> bool:
    return unquote(raw).strip().lower().endswith("password")


def _location(rest: str) -> str:
    """What follows a scheme, up to white space, without its passwords.

    A user's password runs from the first colon before any / or @ to the last @, whatever it holds. In what comes after
    a question mark each value of a password ends at &; names may be percent-encoded.
    """
    first = next((i for i, c in enumerate(rest) if c in ":/@?#"), len(rest))
    at = rest.rfind("@")
    lead = ""
    if first < at and rest[first] == ":":
        inside = rest[first + 1 : at]
        lead, rest = rest[: first + 1] + MASK + "@", rest[at + 1 :]
        if any(_secret_name(p.partition("=")[0]) and "=" in p for p in re.split("[?&]", inside)):
            return lead[:-1]  # the @ may be in another password, which then goes on
    path, mark, query = rest.partition("?")
    parts = [f"{p.partition('=')[0]}={MASK}" if "=" in p and _secret_name(p.partition("=")[0]) else p for p in query.split("&")]
    return lead + path + mark + "&".join(parts)


def _value_end(text: str, at: int) -> int:
    """Where an assigned value ends.

    A value in single quotes ends at the next one that no backslash escapes; one that begins with a double quote goes
    on to the next; without either, at white space that no backslash escapes. What isn't closed goes to the end of the text.
    """
    quote = text[at : at + 1]
    if quote == "'":
        at += 1
        while at < len(text) and text[at] != "'":
            at += 2 if text[at] == "\\" else 1
        at += 1
    elif quote == '"':
        at = text.find('"', at + 1) + 1 or len(text)
    while at < len(text) and not text[at].isspace():
        at += 2 if text[at] == "\\" else 1
    return min(at, len(text))


def redacted(text: str) -> str:
    """The text with passwords of connection strings and interface keys masked; what else it says stays."""
    out, at = [], 0
    while found := _OPENING.search(text, at):
        out.append(text[at : found.start()])
        if found["key"]:
            out.append("sk-" + MASK)
            at = found.end()
        elif found["scheme"]:
            rest = _TOKEN.match(text, found.end())[0]
            out += [found["scheme"], _location(rest)]
            at = found.end() + len(rest)
        else:
            out += [found["name"], MASK]
            at = _value_end(text, found.end())
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redacted, na_action="ignore")


def redact(c: Column) -> Column:
    """redacted, row by row; null for null."""
    return _redacted(c)
