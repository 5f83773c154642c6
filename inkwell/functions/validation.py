"""Validation as data quality: the first failing rule's message, null for a good row."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import EVENT_KEYS, KINDS, OPTIONAL_TEXTS, PAYLOAD_DEPTH, PAYLOAD_MAX, PROJECT_MAX, QUERY_MAX, REQUIRED, RESULTS, SEVERITIES, SOURCES, SPACE, SUMMARY_MAX, TITLE_MAX, TOP_K, TOP_K_MAX
from .text import strip

_ISO = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d(:?\d\d)?)$"


def project_error(project: Column) -> Column:
    p = strip(project)
    return (
        F.when(F.coalesce(p, F.lit("")) == "", "project is empty")
        .when(F.length(p) > PROJECT_MAX, f"project longer than {PROJECT_MAX}")
        .when(p.rlike(f"[{SPACE}]"), "project must not contain whitespace")
        .when(p.rlike(r"[/\\]"), "project must not contain / or \\")
        .when(p.contains("\x00"), "project must not contain NUL")
    )


def timestamp(raw: Column) -> Column:
    """ISO 8601 with an offset as a timestamp; null for anything else (a date alone, a local time, out of range)."""
    whole = F.regexp_replace(raw, r"([+-]\d\d)(\d\d)$", "$1:$2")
    whole = F.regexp_replace(whole, r"([+-]\d\d)$", "$1:00")
    whole = F.regexp_replace(whole, r"^(.{11}\d\d:\d\d)(?!:)", "$1:00")  # a time without seconds isn't read with every offset
    at = F.try_to_timestamp(whole)
    return F.when(raw.rlike(_ISO) & F.year(at).between(1, 9999), at)


def timestamp_error(raw: Column, field: str) -> Column:
    wrong = raw.isNotNull() & timestamp(raw).isNull()
    local = raw.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d(:\d\d){0,2}(\.\d+)?)?$")
    return F.when(wrong & local, f"{field} needs a UTC offset").when(wrong, f"{field} is not ISO-8601")


def _member(c: Column, allowed: tuple[str, ...], field: str) -> Column:
    return F.when(c.isNotNull() & ~c.isin(*allowed), f"{field} must be one of [{', '.join(repr(a) for a in sorted(allowed))}]")


def payload_problem(payload: str) -> str | None:
    """Why JSON text can't be an event's payload: not JSON, not an object, too long or too deep, or with what can't be stored.

    Looked at are the values as decoded, so an escaped backslash before u0000 is no NUL; the length is that of the compact form.
    """
    odd: list[str] = []
    number = lambda text: float(text) if math.isfinite(float(text)) else odd.append(text)
    too_long = f"payload longer than {PAYLOAD_MAX}"
    try:
        value = json.loads(payload, parse_constant=odd.append, parse_float=number)
    except RecursionError:
        return too_long
    except ValueError:
        return "payload is not JSON"
    if not isinstance(value, dict):
        return "payload must be an object"
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > PAYLOAD_DEPTH:
            return too_long
        texts = [x for v in level for x in (v if isinstance(v, dict) else [v] if isinstance(v, str) else []) if isinstance(x, str)]
        if any("\x00" in t for t in texts):
            return "payload must not contain NUL"
        if any("\ud800" <= c <= "\udfff" for t in texts for c in t):
            return "payload must be valid Unicode"
        level = [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
    if odd:
        return "payload must not contain NaN or Infinity"
    try:
        return too_long if len(json.dumps(value, ensure_ascii=False, separators=(",", ":"))) > PAYLOAD_MAX else None
    except RecursionError:
        return too_long


@F.pandas_udf(StringType())
def _payload_problems(payloads: pd.Series) -> pd.Series:
    return payloads.map(payload_problem, na_action="ignore").astype(object).where(payloads.notna(), None)


def payload_error(payload: Column) -> Column:
    """payload_problem of JSON text, row by row; null for null and for what can be stored."""
    return _payload_problems(payload)


def event_error(keys: Column) -> Column:
    """The first rule that an event submission breaks. Expects its fields as string columns; keys: all its field names."""
    unknown = F.array_min(F.array_except(keys, F.array(*[F.lit(k) for k in EVENT_KEYS])))
    blank = lambda f: strip(F.col(f)) if f in ("title", "summary") else F.col(f)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(blank(f), F.lit("")) == "", f) for f in REQUIRED]))
    col = F.col
    rules = [
        F.when(unknown.isNotNull(), F.when(F.length(unknown).between(1, TITLE_MAX), F.concat(F.lit("unknown field: "), unknown)).otherwise("unknown field")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing required field: "), F.array_join(missing, ", "))),
        project_error(col("project")),
        F.when(col("title").contains("\x00"), "title must not contain NUL"),
        F.when(col("summary").contains("\x00"), "summary must not contain NUL"),
        F.when(F.length("title") > TITLE_MAX, f"title longer than {TITLE_MAX}"),
        F.when(F.length("summary") > SUMMARY_MAX, f"summary longer than {SUMMARY_MAX}"),
        _member(col("kind"), KINDS, "kind"),
        _member(col("result"), RESULTS, "result"),
        timestamp_error(col("occurred_at"), "occurred_at"),
        timestamp_error(col("resolved_at"), "resolved_at"),
        F.when(timestamp(col("resolved_at")) < timestamp(col("occurred_at")), "resolved_at is before occurred_at"),
        payload_error(col("payload")),
        *[F.when(col(f).contains("\x00"), f"{f} must not contain NUL").when(F.length(f) > most, f"{f} longer than {most}") for f, most in OPTIONAL_TEXTS.items() if f != "created_by"],
        _member(col("severity"), SEVERITIES, "severity"),
        _member(col("source"), SOURCES, "source"),
        F.when(F.length("created_by") > OPTIONAL_TEXTS["created_by"], f"created_by longer than {OPTIONAL_TEXTS['created_by']}"),
    ]
    return F.coalesce(*rules)


def query_error(query: Column, top_k: Column, required: bool) -> Column:
    q = strip(query)
    empty = F.when(F.coalesce(q, F.lit("")) == "", "query is empty") if required else F.lit(None).cast("string")
    return F.coalesce(empty, F.when(F.length(q) > QUERY_MAX, f"query longer than {QUERY_MAX}"), F.when(~F.coalesce(top_k, F.lit(TOP_K)).between(1, TOP_K_MAX), f"top_k must be between 1 and {TOP_K_MAX}"))


def closed_set_error(value: Column, allowed: tuple[str, ...], field: str) -> Column:
    return _member(value, allowed, field)


def base_hash_error(c: Column) -> Column:
    return F.when(c.isNotNull() & ~c.rlike(r"^sha256:[0-9a-f]{64}\z"), "base_hash is malformed")
