"""Events: intake, statistics, search, log and status, against plain counting and plain search."""

import datetime as dt
import json
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from inkwell.functions.tokens import parse_web_query
from inkwell.operators import stats
from inkwell.operators.ranking import sent
from inkwell.plans import ledger, search
from inkwell.schemas import KINDS, OPTIONAL_TEXTS, REQUIRED, RESULTS, SEVERITIES, SOURCES
from inkwell.sources import events as stored_events
from inkwell.sources.ledger import read_events, submissions
from inkwell.sources.shared import shared_folder
from inkwell.streaming import intake

GOOD = {"project": "ship", "kind": "incident", "title": "Leak", "summary": "Water in the hold", "occurred_at": "2027-02-03T04:05:06Z", "result": "partial"}
EVENT = "id bigint, project string, module string, kind string, title string, summary string, root_cause string, resolution string, result string, occurred_at timestamp, resolved_at timestamp"
T0 = dt.datetime(2026, 1, 1)


def judged(spark, *bodies):
    """How many of the submissions are accepted, and the others' errors in order."""
    lines = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "n int, value string").coalesce(1).orderBy("n")
    good, bad = ledger.validate_events(submissions(lines.select("value")))
    return good.count(), [r["error"] for r in bad.select("error").collect()]


def test_each_field_is_checked(spark):
    """Every field left out, null, too long or outside its set, one at a time."""
    required, sets = REQUIRED, {"kind": KINDS, "result": RESULTS, "severity": SEVERITIES, "source": SOURCES}
    bodies = [GOOD, GOOD, GOOD | dict.fromkeys(OPTIONAL_TEXTS), GOOD | {f: "x" * n for f, n in OPTIONAL_TEXTS.items()}]
    n = len(bodies) + sum(map(len, sets.values()))
    bodies += [GOOD | {f: v} for f, own in sets.items() for v in own]
    wrong = [({k: v for k, v in GOOD.items() if k != f}, f"missing required field: {f}") for f in required]
    wrong += [(GOOD | {f: None}, f"missing required field: {f}") for f in required]
    wrong += [(GOOD | {f: "\t "}, f"missing required field: {f}") for f in ("title", "summary")]
    wrong += [(GOOD | {f: "x" * (m + 1)}, f"{f} longer than {m}") for f, m in OPTIONAL_TEXTS.items()] + [(GOOD | {"title": "x" * 201}, "title longer than 200"), (GOOD | {"summary": "x" * 2001}, "summary longer than 2000")]
    wrong += [(GOOD | {f: "other"}, f"{f} must be one of [{', '.join(map(repr, sorted(own)))}]") for f, own in sets.items()]
    wrong += [(GOOD | {"tittle": 1}, "unknown field: tittle"), ("[1]", "unknown field"), ("{", "unknown field"), ("", "unknown field"), ({}, "missing required field: " + ", ".join(required))]
    wrong += [(GOOD | {"resolved_at": "2027-02-03T04:05:05Z"}, "resolved_at is before occurred_at"), (GOOD | {"title": "a\x00"}, "title must not contain NUL")]
    count, errors = judged(spark, *bodies, *[b for b, _ in wrong])
    assert count == n and errors == [e for _, e in wrong]


def test_payloads_of_submissions(spark):
    line = json.dumps(GOOD)[:-1]
    good = ['{"a":"\\\\u0000"}', '{"a":[1,{"b":null}]}', "null", "{}"]
    bad = {"[1]": "must be an object", '"{}"': "must be an object", '{"a":NaN}': "must not contain NaN or Infinity", '{"a":[1e999]}': "must not contain NaN or Infinity", '{"a":"\\u0000"}': "must not contain NUL", '{"a":"\\ud800"}': "must be valid Unicode"}
    count, errors = judged(spark, *[f'{line}, "payload": {p}}}' for p in (*good, *bad)])
    assert count == len(good) and errors == [f"payload {e}" for e in bad.values()]
    deep = f'{line}, "payload": {{"a": {"[" * 1100}{"]" * 1100}}}}}'
    assert judged(spark, deep)[1] == ["payload longer than 2000"]


def test_submissions_are_read_from_files(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join([json.dumps(GOOD | {"title": f"t{i}", "payload": {"n": i}}) for i in range(3)] + ["no json", '{"severity": 5}']))
    rows = read_events(spark, str(tmp_path)).collect()
    assert sorted((r["title"], r["payload"]) for r in rows if r["title"]) == [(f"t{i}", f'{{"n":{i}}}') for i in range(3)]
    assert sorted(len(r["keys"]) for r in rows) == [1, 1, 7, 7, 7] and {r["severity"] for r in rows} == {None, "5"}


def events_of(rnd, n):
    """Random events of two projects, some at the same time."""
    say = lambda: " ".join(rnd.choice(["oil", "rope", "sail", "wind", "oar"]) for _ in range(rnd.randrange(1, 9)))
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(hours=rnd.randrange(n // 2 + 1))
        done = at + dt.timedelta(seconds=rnd.randrange(5000)) if rnd.random() < 0.5 else None
        rows.append((i, rnd.choice("pq"), rnd.choice([None, *"abcdefghijklmnop"]), rnd.choice(KINDS), say(), say(), rnd.choice([None, "worn", "bent"]), rnd.choice([None, say()]), rnd.choice(RESULTS), at, done))
    return rows


def test_statistics_by_plain_counting(spark):
    rows = events_of(random.Random(1), 300)
    e = spark.createDataFrame(rows, EVENT)
    head = {r["project"]: r["avg_resolution_seconds"] for r in stats.stats_head(e).collect()}
    for p in "pq":
        own = [r for r in rows if r[1] == p]
        took = [(r[10] - r[9]).total_seconds() for r in own if r[10]]
        assert head[p] == math.floor(sum(took) / len(took) + 0.5)
        modules = Counter(r[2] for r in own if r[2])
        told = sorted((r["position"], r["value"], r["n"], r["omitted"]) for r in stats.module_counts(e).filter(F.col("project") == p).withColumnRenamed("module", "value").collect())
        best = sorted(modules.items(), key=lambda x: (-x[1], x[0]))
        assert [t[1:] for t in told] == [(m, c, max(0, len(best) - 12)) for m, c in best[:12]]
        causes = Counter((r[6], r[2]) for r in own if r[6])
        again = sorted(((c, m, n) for (c, m), n in causes.items() if n > 1), key=lambda x: (-x[2], x[0], x[1] is None, x[1] or ""))[:12]
        assert [(r["root_cause"], r["module"], r["n"]) for r in stats.repeat_causes(e).filter(F.col("project") == p).orderBy("position").collect()] == again
    assert stats.in_scope(e, "\tc ").count() == sum(r[2] == "c" for r in rows) and stats.in_scope(e, " \n").count() == 300
    since = T0 + dt.timedelta(hours=70)
    assert stats.in_scope(e, None, since).count() == sum(r[9] >= since for r in rows)


ASKED = "query_id bigint, project string, query string, kind string, module string, since timestamp, until timestamp, top_k int"


def plain_events(rows, q):
    """The events that a query finds, by the definition: every event is looked at."""
    _, project, query, kind, module, since, until, top = q
    fit = [r for r in rows if r[1] == project and kind in (None, r[3]) and module in (None, r[2]) and (since is None or r[9] >= since) and (until is None or r[9] < until)]
    found = []
    for r in fit:
        if query is None:
            found.append((0, r[9], r[0]))
            continue
        t = " ".join(x or "" for x in (r[4], r[5], r[6], r[7])).split()
        times = lambda part, t=t: sum(t[i : i + len(part)] == part for i in range(len(t)))
        ranks = []
        for g in parse_web_query(query):
            wanted = [list(x) for x in dict.fromkeys(map(tuple, g["all"]))]
            if all(map(times, wanted)) and not any(map(times, g["none"])):
                ranks.append(sum(0.1 * sum(1 / j**2 for j in range(1, times(p) + 1)) / 1.64493406685 for p in wanted) / len(wanted))
        if ranks:
            found.append((round(max(ranks) / math.log2(len(t) + 1), 12), r[9], r[0]))
    return [i for *_, i in sorted(found, reverse=True)[:top]]


def test_event_search_by_brute_force(spark, monkeypatch):
    """Words, phrases, groups, exclusions, filters and periods over several batches and many small segments."""
    monkeypatch.setattr(stored_events, "SEGMENT", 20)
    rnd = random.Random(2)
    rows = events_of(rnd, 600)
    root = shared_folder(spark)
    for batch in range(3):
        stored_events.append_events(spark.createDataFrame(rows[batch::3], EVENT), root, batch)
    stored_events.append_events(spark.createDataFrame(rows[1::3], EVENT), root, 1)  # again: it replaces itself
    words = ["oil", "rope", '"oil rope"', '"rope rope"', '"wind oar sail"', "-sail", "-\"oar oar\"", "OR", "worn", "gone", '"']
    asked = []
    for k in range(90):
        query = None if k % 3 == 0 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5)))
        since, until = sorted(rnd.sample(range(310), 2))
        period = (T0 + dt.timedelta(hours=since) if k % 4 else None, T0 + dt.timedelta(hours=until) if k % 5 else None)
        asked.append((k, rnd.choice("pqr"), query, rnd.choice([None, *KINDS]) if k % 2 else None, rnd.choice([None, "a", "b"]), *period, rnd.choice([1, 8, 12])))
    q = spark.createDataFrame(asked, ASKED)
    want = {a[0]: plain_events(rows, a) for a in asked}
    for _ in range(2):
        got = {a[0]: [] for a in asked}
        for r in search.search_events(q, root=root).orderBy("query_id", "position").collect():
            got[r["query_id"]].append(r["id"])
        assert got == want and sum(map(len, want.values())) > 200
        monkeypatch.setattr(sent, "__defaults__", (1,))  # once more, with all joins as shuffles
    # The newest events of a project are in few of its segments.
    plain = q.filter("query is null and kind is null and module is null").select("query_id", "project", "since", "until")
    needed = stored_events.holding(stored_events.read_zones(spark, root), plain, F.lit(True), 12)
    held = stored_events.read_zones(spark, root).select("batch", "segment").distinct().count()
    assert held >= 30 and max(r["count"] for r in needed.groupBy("query_id").count().collect()) <= held / 2


def test_searches_leave_a_log(spark, tmp_path):
    rows = events_of(random.Random(3), 40)
    q = spark.createDataFrame([(1, "p", "oil", None, " ", None, None, 8), (2, "p", None, "nokind", None, None, None, 8), (3, "q", "nothing", "failure", None, T0, None, 8)], ASKED)
    found = search.search_events(q, spark.createDataFrame(rows, EVENT), log=str(tmp_path / "log")).count()
    log = {r["query_id"]: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert set(log) == {1, 3} and log[1]["hit_count"] == found > 0 and log[1]["hit_paths"] is None and log[1]["tool"] == "search_events"
    assert log[3]["hit_count"] == 0 and json.loads(log[3]["filters"]) == {"kind": "failure", "since": "2026-01-01T00:00:00+00:00"} and log[1]["filters"] == "{}"


def test_running_causes_write_what_changes(spark, tmp_path):
    causes = [["a", "b", "a"], ["c"], ["b", "d", "b"], ["a", None]]
    for k, own in enumerate(causes):
        spark.createDataFrame([("p", None, c) for c in own], "project string, module string, root_cause string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("project string, module string, root_cause string").parquet(f"{tmp_path}/in")
        intake.repeats_sink(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        total = Counter(c for own in causes[: k + 1] for c in own if c)
        assert {r["root_cause"]: r["n"] for r in intake.current_repeats(spark, f"{tmp_path}/out").collect()} == {c: n for c, n in total.items() if n > 1}
    written = Counter(r["batch_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert written == {0: 1, 2: 1, 3: 1} and intake.current_repeats(spark, f"{tmp_path}/out", 1).count() == 1
    intake.compact_repeats(spark, f"{tmp_path}/out", f"{tmp_path}/packed")
    assert intake.current_repeats(spark, f"{tmp_path}/packed").count() == 2


def test_status_and_log(spark):
    docs = spark.createDataFrame([("p",)], "project string")
    chunks = spark.createDataFrame([("p", None), ("p", [1.0])], "project string, embedding array<float>")
    runs = spark.createDataFrame([("p", "ok", T0), ("p", "failed", T0 + dt.timedelta(days=1))], "project string, status string, finished_at timestamp")
    logs = spark.createDataFrame([("p", 0), ("p", 3)], "project string, hit_count int")
    asked = spark.createDataFrame([(" p",), ("nobody",)], "project string")
    rows = {r["project"]: r for r in stats.kb_status(asked, docs, chunks, docs, runs, logs).collect()}
    assert rows["p"]["chunks_without_embedding"] == 1 and rows["p"]["zero_hit_queries"] == 1 and rows["p"]["last_ingest_at"] == T0
    assert rows["nobody"]["documents"] == 0 and rows["nobody"]["last_ingest_at"] is None
    q = spark.createDataFrame([(1, "p", "a", None, "current"), (2, "p", "b", "m", None)], "query_id bigint, project string, query string, module string, status string")
    hits = spark.createDataFrame([(1, 2, "docs/a.md"), (1, 1, "docs/a.md")], "query_id bigint, position int, path string")
    log = {r["query_id"]: r for r in ledger.query_log(q, hits, "search_docs", "c", ("module", "status")).collect()}
    assert log[1]["filters"] == '{"status":"current"}' and log[1]["hit_paths"] == ["docs/a.md"] * 2 and log[2]["hit_paths"] == [] and log[2]["hit_count"] == 0
    assert ledger.query_log(q, hits, "search_events", "c", ("module",), paths=False).head()["hit_paths"] is None


def test_proposals_and_files(spark):
    import hashlib

    texts = spark.createDataFrame([("p", "docs/a.md", "one\r\ntwo\n"), ("p", "docs/k.md", "가나다")], "project string, path string, text string")
    docs = texts.select("project", "path").unionByName(spark.createDataFrame([("p", "docs/new.md")], "project string, path string"))
    now = "sha256:" + hashlib.sha256(b"one\ntwo\n").hexdigest()
    asked = [("docs/a.md", "one\ntwo\n", now), ("docs/a.md", "one\n2\n", now), ("docs/a.md", "x", "sha256:" + "0" * 64), ("docs/a.md", "x", "SHA"), ("docs/none.md", "x", None), ("docs/new.md", "x\n", None)]
    p = spark.createDataFrame([("p", *a) for a in asked], "project string, path string, body string, base_hash string")
    rows = {(r["path"], r["outcome"], r["diff"]) for r in ledger.propose_docs(p, docs, texts).collect()}
    assert ("docs/a.md", "ok", "") in rows and ("docs/a.md", "conflict", None) in rows and ("docs/a.md", "validation", None) in rows and ("docs/none.md", "not_found", None) in rows
    assert ("docs/new.md", "ok", "--- /dev/null\n+++ b/docs/new.md\n@@ -0,0 +1 @@\n+x\n") in rows
    r = spark.createDataFrame([("p", "docs/k.md", 0), ("p", "docs/k.md", 1), ("p", "docs/k.md", 3), ("p", "docs/k.md", 99), ("p", "x.md", 0)], "project string, path string, offset bigint")
    got = {(x["path"], x["offset"]): (x["outcome"], x["text"]) for x in ledger.get_files(r, texts, docs).collect()}
    assert got[("docs/k.md", 0)] == ("ok", "가나다") and got[("docs/k.md", 1)][0] == "offset inside a character" and got[("docs/k.md", 3)] == ("ok", "나다") and got[("docs/k.md", 99)][0] == "offset past the end" and got[("x.md", 0)][0] == "not_found"


def test_interrupted_runs(spark):
    runs = spark.createDataFrame([(1, "p", "running", None), (2, "p", "running", None)], "id bigint, project string, status string, error string")
    assert [r["status"] for r in ledger.interrupted_runs(runs).orderBy("id").collect()] == ["failed", "running"]


def test_ids_are_unique(spark):
    e = spark.createDataFrame(events_of(random.Random(4), 8), EVENT).drop("id").withColumns({c: F.lit(None).cast("string") for c in ("severity", "source", "related_doc_path", "payload", "created_by")}).withColumn("created_at", F.current_timestamp())
    assert ledger.with_ids(e.repartition(4), 100).select("id").distinct().count() == 8
