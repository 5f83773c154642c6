"""Text, validation and token functions: against plain versions over random texts, and by cases."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from inkwell.functions import redaction as S
from inkwell.functions import text as T
from inkwell.functions import tokens as K
from inkwell.functions import validation as V


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(expression.alias("x")).head()["x"]


def each(spark, expression, values):
    """The expression over column v, for every value."""
    rows = spark.createDataFrame(list(enumerate(values)), "i bigint, v string").select("i", expression.alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def strings(alphabet, n, seed, most=12):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(most))) for _ in range(n)]


def test_cut_comment(spark):
    def plain(value):
        for i, c in enumerate(value):
            if c == "#" and i and value[i - 1].isspace():
                return value[:i].rstrip()
        return value

    values = strings("#  \tab　", 800, 1)
    assert [x.rstrip() for x in each(spark, T.cut_comment(F.col("v")), values)] == [plain(v).rstrip() for v in values]


def test_normalize(spark):
    values = strings("\ufeff\r\n\ra", 300, 2)
    assert each(spark, T.normalize_text(F.col("v")), values) == [v.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n") for v in values]
    assert one(spark, T.text_error(F.col("v")), v=b"ab\xc3") == "not UTF-8"
    assert one(spark, T.text_error(F.col("v")), v=b"\x00") == "contains NUL"
    assert one(spark, T.text_error(F.col("v")), v="ñ".encode()) is None


def test_front_matter(spark):
    assert one(spark, T.front_matter(F.col("v")), v="---\nkey: 'q' # why\nno: colon: here\nkey: last\nnothing\n---\nrest") == {"key": "last", "no": "colon: here"}
    assert one(spark, T.front_matter(F.col("v")), v="--- \nkey: x") is None
    assert one(spark, T.body(F.col("v")), v="---\nk: v\n---\nrest") == "rest"


def test_clip(spark):
    for n in (0, 5, 6, 7):
        assert one(spark, T.clip(F.col("v"), 6), v="é" * n) == ("é" * n if n <= 6 else "é" * 5 + "…")


def plain_windows(text, chars):
    parts = [text[i : i + chars] for i in range(0, len(text), chars)] or [""]
    ends = list(itertools.accumulate(len(p.encode()) for p in parts))
    return [(i, p, e - len(p.encode()), e, ends[-1], e < ends[-1]) for i, (p, e) in enumerate(zip(parts, ends, strict=True))]


def test_windows(spark):
    texts = ["", "a", "ab\ncd", "日本語テキスト", "x🙂" * 700, "ä\r\n" * 1500] + strings("aé🙂\n", 60, 3, 40)
    for chars in (1, 3, 4):
        got = each(spark, T.windows(F.col("v"), chars), texts)
        assert [[tuple(w) for w in own] for own in got] == [plain_windows(t, chars) for t in texts]


def test_windows_of_a_long_text_take_linear_time(spark):
    def seconds(mb):
        text = F.repeat(F.lit("0123456789abcdé\n"), mb << 16)
        began = time.time()
        last = spark.range(1).select(text.alias("t")).select(F.explode(T.windows(F.col("t"))).alias("w")).agg(F.count("*").alias("n"), F.max("w.next_offset").alias("end")).head()
        assert last["end"] == (mb << 16) * 17 and last["n"] == -(-(mb << 20) // 4000)
        return time.time() - began

    seconds(1)
    assert seconds(32) < 30


# --- secrets -------------------------------------------------------------------------------------------------------

SECRET = "Qw7xZ"
#: Where a password may stand; {} is it, and nothing of it may be left.
PLACES = [
    "amqp://ann:{}@box:1/v", "amqp://ann:x@{}@box/v", "amqp://ann:x:{}@[::2]/v", "amqp://ann:x/{}@box", "amqp://ann:x?{}@box", "amqp://ann:x&{}#y@box/v", "amqp://ann:amqp://{}@box/v", "amqp+tls://ann:{}@box",
    "amqp://ann@box/v?password={}", "amqp://box/v?a=1&password={}&b=2", "amqp://box/v?password=x&PassWord={}", "amqp://ann@box/v?sslpassword={}", "amqp://ann@box/v?password=x#{}", "amqp://ann@box/v?pass%77ord={}", "amqp://ann@box/v?password=x@{}",
    "amqp://ann:x?password=y@{}", "server=box password={} user=ann", "server=box PASSWORD = {}", "server=box sslpassword={}", "db_password={}", "password='{}' user=ann", "password='x y{}' user=ann", "password='x\\' {}' user=ann", "password='x {} user=ann",
    'password="x {}" user=ann', 'password="x"{} user=ann', 'password=""{}', 'password="x {}', "password=x\\ {} user=ann", "password=x&{}", "password=amqp://{}@box user=ann", "password=x://{} user=ann", "first http://site.example/a then amqp://ann:{}@box", "amqp://ann:x@box and amqp://bob:{}@pit",
    "token sk-{}abcdefgh used",
]


@pytest.mark.parametrize("place", PLACES)
def test_no_secret_is_left(place):
    text = place.format(SECRET)
    assert SECRET in text and SECRET not in S.redacted(text) and "***" in S.redacted(text)
    assert SECRET not in S.redacted(f"before\n{text}") and S.redacted(f"before {text}").startswith("before ")


def test_every_quoting_hides_the_password():
    """Random passwords, quoted as connection strings ask for, between other settings."""
    rnd = random.Random(4)
    for _ in range(3000):
        word = "".join(rnd.choice("ab '\\\"@:/&#?=") for _ in range(rnd.randrange(6))) + SECRET
        quoted = "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"
        bare = "".join("\\" + c if c in " '\\\"" else c for c in word)
        for value in (quoted, bare):
            out = S.redacted(f"host=box password={value} user=ann")
            assert SECRET not in out and out.startswith("host=box password=***") and out.endswith(" user=ann"), value


def test_what_is_no_secret_stays():
    for text in ("amqp://box:567/v: write to ann@box.example", "mail ann@box.example: no://thing", "a password is needed", "http://site.example/a?b=c@d", "sk-short", ""):
        assert S.redacted(text) == text
    assert S.redacted("amqp://ann:x@box/v failed, ask ann@box.example") == "amqp://ann:***@box/v failed, ask ann@box.example"
    assert S.redacted("amqp://box/v?password=x&b=2 and password=y, z") == "amqp://box/v?password=***&b=2 and password=*** z"


def test_redaction_of_columns(spark):
    assert each(spark, T.redact(F.col("v")), ["a password=x", None, ""]) == ["a password=***", None, ""]
    assert one(spark, T.clip_error(F.col("v")), v='amqp://ann:x y@box {"a": 1}') == "amqp://ann:x y@box "
    assert one(spark, T.clip_error(F.col("v")), v="password=x failed\nmore") == "password=*** failed"


def test_printable(spark):
    import unicodedata

    def plain(text):
        told = {"Cc": "\\x{:02x}", "Zl": "\\u{:04x}", "Zp": "\\u{:04x}"}
        turns = {"AL", "L", "R"}
        marks = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Cf" and (unicodedata.bidirectional(c) in {"LRE", "RLE", "LRO", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI"} or c in "\u061c\u200e\u200f" and unicodedata.bidirectional(c) in turns)]
        return "".join(told[k].format(ord(c)) if (k := unicodedata.category(c)) in told else f"\\u{ord(c):04x}" if c in marks else c for c in text)

    odd = [chr(i) for i in range(1, 0x250)] + [chr(i) for i in range(0x600, 0x620)] + [chr(i) for i in range(0x2000, 0x2070)] + ["\U000e0001", "🙂", "\ufeff", "é\n\u202e"]
    assert each(spark, T.printable(F.col("v")), odd) == [plain(c) for c in odd]


# --- validation ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("payload", "error"),
    [
        ("{}", None), ('{"a":[1,{"b":null}]}', None), ('{"a":"\\\\u0000"}', None), ('{"a":"\\u0000"}', "payload must not contain NUL"), ('{"\\u0000":1}', "payload must not contain NUL"), ('{"a":["x",{"b":"\\u0000"}]}', "payload must not contain NUL"),
        ('{"a":NaN}', "payload must not contain NaN or Infinity"), ('{"a":[-Infinity]}', "payload must not contain NaN or Infinity"), ('{"a":1e999}', "payload must not contain NaN or Infinity"), ("[1]", "payload must be an object"), ("5", "payload must be an object"),
        ('{"a":', "payload is not JSON"), ("", "payload is not JSON"), ("{'a':1}", "payload is not JSON"), ('{"a":"\\ud800"}', "payload must be valid Unicode"), ('{"a":"\\ud83d\\ude00"}', None),
        ('{"a":' + "[" * 1500 + "]" * 1500 + "}", "payload longer than 2000"), ('{"a":' + "[" * 90_000 + "]" * 90_000 + "}", "payload longer than 2000"), ('{"a":' + "[" * 900 + "]" * 900 + "}", None),
        ('{"a":"' + "x" * 1992 + '"}', None), ('{"a":"' + "x" * 1993 + '"}', "payload longer than 2000"), ('{ "a" : "' + "x" * 1992 + '" }', None), ('{"a":"' + "\\u00e9" * 1992 + '"}', None),
    ],
)
def test_payloads(payload, error):
    assert V.payload_problem(payload) == error


def test_payload_columns(spark):
    assert each(spark, V.payload_error(F.col("v")), [None, "{}", "[]"]) == [None, None, "payload must be an object"]
    assert all(V.payload_problem(json.dumps({"k": v})) is None for v in (1, None, "x", [], {}))


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        ("2027-02-03T04:05:06Z", None), ("2027-02-03T04:05-0330", None), ("2027-02-03 04:05:06.123456+01", None), ("2027-02-03T04:05:06", "t needs a UTC offset"),
        ("2027-02-03", "t needs a UTC offset"), ("3.2.2027", "t is not ISO-8601"), ("1798000000", "t is not ISO-8601"), ("9999-12-31T23:59:59-01:00", "t is not ISO-8601"),
    ],
)
def test_timestamps(spark, raw, error):
    assert one(spark, V.timestamp_error(F.col("v"), "t"), v=raw) == error


def test_projects(spark):
    def plain(p):
        p = p.strip()
        return 0 < len(p) <= 64 and not any(c.isspace() or c in "/\\\x00" for c in p)

    names = strings("ab/\\ \t　\x00é", 400, 5) + ["x" * n for n in (63, 64, 65)] + [" " + "x" * 64 + " "]
    assert [e is None for e in each(spark, V.project_error(F.col("v")), names)] == [plain(n) for n in names]


# --- tokens --------------------------------------------------------------------------------------------------------


def plain_tokens(text):
    out, at = [], 0
    low = text.lower()
    while at < len(low):
        joined = low[at] == "-" and at and low[at - 1].isdigit() and low[at + 1 : at + 2].isdigit()
        end = at + bool(joined)
        while end < len(low) and (low[end].isdigit() if joined else low[end].isalnum()):
            end += 1
        if end > at:
            out.append(low[at:end])
        at = max(end, at + 1)
    return out


def test_tokens(spark):
    values = strings("aZé1 2-_.日", 600, 6)
    assert each(spark, K.tokenize(F.col("v")), values) == [plain_tokens(v) for v in values]


def test_web_queries_of_random_marks():
    """Whatever the marks, parsing ends; what it finds are the query's own tokens, and groups that only exclude are dropped."""
    for query in strings(['"', "-", "OR", " ", "ab", "c1", "(", "&", "é", "<->", "\t"], 4000, 7) + [None]:
        groups = K.parse_web_query(query)
        own = set(plain_tokens((query or "").replace("_", " ")))
        for g in groups:
            assert g["all"] and {t for part in g["all"] + g["none"] for t in part} <= own


def test_web_queries():
    assert K.parse_web_query('red "green blue" -grey OR -"not this" OR pink') == [{"all": [["red"], ["green", "blue"]], "none": [["grey"]]}, {"all": [["pink"]], "none": []}]
