"""Document search and incremental ingest end to end on small trees."""

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell import catalog
from inkwell.operators import audit, ranking
from inkwell.plans import ingest as ing
from inkwell.plans import search
from inkwell.schemas import CHUNKS, DOCUMENTS
from inkwell.sources import corpus, index, ledger

FM = "---\ntitle: T\ndoc_type: other\nstatus: current\nmodule: null\n---\n\n"


def files_of(spark, files, links=()):
    raw = spark.createDataFrame([("p", p, t if isinstance(t, bytes) else t.encode(), None) for p, t in files.items()], "project string, path string, content binary, mtime timestamp")
    listing = spark.createDataFrame([("p", p, "file", True) for p in files] + [("p", x, "link", False) for x in links] or [("p", "src/x", "file", True)], "project string, path string, kind string, exact boolean")
    return raw, listing


def run(spark, files, docs=None, chunks=None, links=(), embedder=None):
    empty = lambda schema: spark.createDataFrame([], schema)
    return ing.ingest(*files_of(spark, files, links), docs if docs is not None else empty(DOCUMENTS), chunks if chunks is not None else empty(CHUNKS), embedder)


RUN = ("status", "files_seen", "files_changed", "files_deleted", "chunks_upserted")


def test_runs_follow_a_plain_model(spark, tmp_path):
    """Random edits of a small tree, run after run into a stored index: its rows, counters and written rows are those of a dict."""
    rnd = random.Random(1)
    root, model = f"{tmp_path}/index", {}
    for step in range(4):
        files = {p: t for p, t in model.items() if rnd.random() < 0.8}
        for _ in range(rnd.randrange(1, 4)):
            files[f"docs/{rnd.choice('abcdef')}/{rnd.choice('xyz')}.md"] = f"# Heading {rnd.randrange(9)}\n\ntext {rnd.randrange(3)}\n\n## Part\n\nmore\n"
        broken = step == 2
        if broken:  # nothing is deleted, and files from the bad one on wait
            files["docs/c/bad.md"] = b"\xff"
        head, made = ing.ingest_into(root, *files_of(spark, files), f"{tmp_path}/runs")
        before = index.read_index(spark, root, head["version"] - 1)[0].count() if head["version"] > 1 else 0
        good = {p: t for p, t in files.items() if not broken or p < "docs/c/bad.md"}
        changed = {p for p, t in good.items() if model.get(p) != t}
        gone = set() if broken else set(model) - set(files)
        assert before == len(model) or not changed | gone
        row = made.run.head()
        assert tuple(row[c] for c in RUN) == ("failed" if broken else "ok", len(good), len(changed), len(gone), 2 * len(changed))
        assert not broken or row["error"] == "docs/c/bad.md: not UTF-8"
        model = {p: t for p, t in model.items() if p not in gone} | good
        docs, chunks = index.read_index(spark, root)
        assert {r["path"]: r["content_hash"] for r in docs.collect()} == {p: hashlib.sha256(t.encode()).hexdigest() for p, t in model.items()}
        assert sorted((r["path"], r["chunk_idx"]) for r in chunks.collect()) == sorted((p, i) for p in model for i in (0, 1))
        assert docs.count() == made.documents.count() == len(model) and made.chunks.count() == 2 * len(model)
        if changed | gone:  # what was written is what changed
            last = head["segments"][-1]
            assert (last["documents"], last["chunks"], last["touched"]) == (len(changed), 2 * len(changed), len(changed | gone))
        told = {(r["path"], r["chunk_idx"], r["term"]): r["positions"] for r in index.read_postings(spark, root).collect()}
        fresh = {(r["path"], r["chunk_idx"], r["term"]): r["positions"] for r in ranking.chunk_postings(chunks).collect()}
        assert told == fresh
        if step == 1:
            index.compact(spark, root)
    statuses = [r["status"] for r in ledger.latest_runs(spark.read.parquet(f"{tmp_path}/runs")).collect()]
    assert sorted(statuses) == ["failed"] + ["ok"] * 3


def test_documents_of_old_rules_are_rebuilt(spark):
    first = run(spark, {"docs/a.md": FM + "# A\n\nbody\n", "README.md": "# Root\n\nhello\n"})
    assert {r["path"]: (r["title"], r["doc_type"]) for r in first.documents.collect()} == {"docs/a.md": ("T", "other"), "README.md": ("Root", "readme")}
    stale = first.documents.withColumn("rules_version", F.lit(0)).withColumn("indexed_at", F.to_timestamp(F.lit("2020-01-01")))
    again = run(spark, {"docs/a.md": FM + "# A\n\nbody\n", "README.md": "# Root\n\nhello\n"}, stale, first.chunks)
    assert tuple(again.run.head()[c] for c in RUN) == ("ok", 2, 0, 0, 2) and {r["indexed_at"].year for r in again.rebuilt.collect()} == {2020}
    none = run(spark, {}, first.documents, first.chunks)
    assert none.run.head()["status"] == "failed" and none.documents.count() == 2 and none.gone.count() == 0


def test_versions_of_an_index(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/index"
    files = {f"docs/{i}.md": f"# T{i}\n\nbody {i}\n" for i in range(6)}
    ing.ingest_into(root, *files_of(spark, files))
    held = index.read_index(spark, root)
    one = {"docs/1.md": "# New\n\nother\n"}
    head, _ = ing.ingest_into(root, *files_of(spark, one), whole=False)
    assert head["version"] == 2 and [s["documents"] for s in head["segments"]] == [6, 1]
    again, _ = ing.ingest_into(root, *files_of(spark, one), whole=False)
    assert again == head  # nothing changed: no version
    assert {r["title"] for r in held[0].collect()} == {f"T{i}" for i in range(6)}  # a reader keeps the version that it began with
    assert {r["title"] for r in index.read_index(spark, root)[0].collect()} == {"T0", "New", "T2", "T3", "T4", "T5"}
    assert {r["title"] for r in index.read_index(spark, root, 1)[0].collect()} == {f"T{i}" for i in range(6)}
    # Two writers that both saw version 2: the second follows the first.
    seen, real = [], index.manifest
    late = {"docs/2.md": "# Late\n\nlate\n"}

    def stale(session, at, version=None):
        if version is None and not seen:
            seen.append(1)
            return real(session, at, 1)
        return real(session, at, version)

    made = run(spark, late, *index.read_index(spark, root))
    monkeypatch.setattr(index, "manifest", stale)
    head = index.append_changes(made.rebuilt, made.fresh, made.gone.limit(0), root)
    assert seen and head["version"] == 3 and len(head["segments"]) == 3
    monkeypatch.setattr(index, "manifest", real)
    # A manifest is there or not; a file under way isn't one.
    (tmp_path / "index" / "log" / ".draft").write_text("{")
    assert index.versions(spark, root) == [1, 2, 3] and not index._create(spark, f"{root}/log/{3:020d}.json", "x")
    packed = index.compact(spark, root)
    assert len(packed["segments"]) == 1 and packed["segments"][0]["documents"] == 6 and packed["segments"][0]["touched"] == 0
    assert {r["title"] for r in index.read_index(spark, root)[0].collect()} == {"T0", "New", "Late", "T3", "T4", "T5"}
    assert index.compact(spark, root) == packed and index.vacuum(spark, root) == 0  # all is younger than a day
    assert index.vacuum(spark, root, hours=-1) == 3 and index.versions(spark, root) == [4]
    assert index.read_index(spark, root)[1].count() == 6


def test_a_compaction_beside_other_writers(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/index"
    for name in ("a", "b"):
        ing.ingest_into(root, *files_of(spark, {f"docs/{name}.md": f"# {name}\n\nx\n"}), whole=False)
    real = index._written

    def slow(*args):  # an append comes in while the compaction writes
        made = real(*args)
        monkeypatch.setattr(index, "_written", real)
        ing.ingest_into(root, *files_of(spark, {"docs/a.md": "# newer\n\ny\n"}), whole=False)
        return made

    monkeypatch.setattr(index, "_written", slow)
    head = index.compact(spark, root)
    assert head["version"] == 4 and len(head["segments"]) == 2
    assert sorted(r["title"] for r in index.read_index(spark, root)[0].collect()) == ["b", "newer"]

    def other(*args):  # another compaction is faster: its version stands
        made = real(*args)
        monkeypatch.setattr(index, "_written", real)
        index.compact(spark, root)
        return made

    monkeypatch.setattr(index, "_written", other)
    assert index.compact(spark, root)["version"] == 5 and sorted(r["title"] for r in index.read_index(spark, root)[0].collect()) == ["b", "newer"]


def test_a_run_that_raises_is_logged(spark, tmp_path):
    raw, listing = files_of(spark, {"docs/a.md": "# a\n\nx\n"})
    with pytest.raises(Exception, match="password"):
        ing.ingest_into(f"{tmp_path}/index", raw.withColumn("content", F.raise_error(F.lit("amqp://u:qq@h no password=qq here")).cast("binary")), listing, f"{tmp_path}/runs")
    rows = ledger.latest_runs(spark.read.parquet(f"{tmp_path}/runs")).collect()
    assert [r["status"] for r in rows] == ["failed"] and "qq" not in rows[0]["error"]


def test_links_keep_what_is_below(spark):
    tree = ["docs/kept/one.md", "docs/kept/deep/two.md", "docs/keptnot.md", "docs/other.md"]
    first = run(spark, {p: f"# {p}\n\ntext" for p in tree})
    left = run(spark, {tree[3]: f"# {tree[3]}\n\ntext"}, first.documents, first.chunks, links=["docs/kept"])
    assert sorted(r["path"] for r in left.documents.collect()) == sorted([tree[0], tree[1], tree[3]])


def test_backfill_stops_at_failure(spark):
    def broken(texts):
        raise RuntimeError("down")

    r = run(spark, {"docs/a.md": "# a\n\na"}, embedder=broken)
    assert r.run.head()["status"] == "partial"
    r = run(spark, {"docs/a.md": "# a\n\na"}, embedder=lambda t: [[1.0, 0.0]] * len(t))
    assert r.run.head()["status"] == "ok" and r.chunks.head()["embedding"] == [1.0, 0.0]


QUERY = "query_id bigint, project string, query string, module string, doc_type string, status string, top_k int, embedding array<float>"


def plain_keyword_rank(text, terms):
    """The rank by its definition, over all pairs of hits."""
    tokens = re.findall(r"[a-z0-9]+", text.lower())
    if not set(terms) <= set(tokens):
        return None
    hits = [(t, p) for p, t in enumerate(tokens) if t in terms and p <= 16383]
    if len(terms) == 1:
        raw = 0.1 * sum(1 / j**2 for j in range(1, min(len(hits), 255) + 1)) / 1.64493406685
    else:
        miss = 1.0
        for (t, p), (u, q) in itertools.combinations(hits, 2):
            if t != u:
                miss *= 1 - math.sqrt(0.01 * (1e-30 if abs(p - q) > 100 else 1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2))))
        raw = max(1 - miss, 1e-20)
    return round(raw / math.log2(len(tokens) + 1), 12)


def test_keyword_ranks_by_brute_force(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["red", "blue", "green", "a", "b", "c"] + ["x"] * rnd.choice([0, 40])) for _ in range(rnd.choice([3, 20, 300, 900]))) for _ in range(40)]
    texts += ["red " + "x " * 150 + "blue", "red " * 60 + "x " * 120 + "blue " * 60, "red " + "x " * 17000 + "blue", "blue red"]
    chunks = spark.createDataFrame([("p", "", f"docs/{i:02}.md", 0, "", t) for i, t in enumerate(texts)], "project string, repo string, path string, chunk_idx int, heading_path string, content string")
    docs = chunks.selectExpr("project", "repo", "path", "cast(null as string) module", "'other' doc_type", "'current' status")
    queries = ["red", "red blue", "blue green a", "red red", "x", "absent red"]
    asked = spark.createDataFrame([(i, "p", q, None, None, None, 8, None) for i, q in enumerate(queries)], QUERY)
    got = {(r["query_id"], r["path"]): r["ts_rank"] for r in ranking.keyword_matches(ranking.chunk_postings(chunks), docs, asked).collect()}
    want = {(i, f"docs/{k:02}.md"): r for i, q in enumerate(queries) for k, t in enumerate(texts) if (r := plain_keyword_rank(t, list(dict.fromkeys(q.split())))) is not None}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) <= 2e-12 for k in want)


def test_proximity_of_many_hits_takes_linear_time(spark):
    def seconds(n):
        hits = F.array(*[F.struct(F.lit(t).alias("term"), F.sequence(F.lit(at), F.lit(3 * n // 2), F.lit(3)).alias("positions")) for at, t in enumerate(("a", "b"))])
        began = time.time()
        assert spark.range(1).select(ranking.proximity(hits).alias("x")).head()["x"] <= 1
        return time.time() - began

    seconds(100)
    assert seconds(10_000) < 5


def test_terms_that_many_queries_ask_for_meet_in_a_shuffle(spark, monkeypatch):
    chunks = spark.createDataFrame([("p", "", f"docs/{i}.md", 0, "", f"word w{i % 5}") for i in range(50)], "project string, repo string, path string, chunk_idx int, heading_path string, content string")
    docs = chunks.selectExpr("project", "repo", "path", "cast(null as string) module", "'other' doc_type", "'current' status")
    asked = spark.createDataFrame([(i, "p", f"word w{i}", None, None, None, 8, None) for i in range(5)], QUERY)
    few = sorted(map(tuple, ranking.keyword_arm(ranking.chunk_postings(chunks), docs, asked).collect()))
    monkeypatch.setattr(ranking.sent, "__defaults__", (1,))
    assert sorted(map(tuple, ranking.keyword_arm(ranking.chunk_postings(chunks), docs, asked).collect())) == few and len(few) == 50


@pytest.mark.parametrize("shuffled", [False, True])
def test_nearest_by_brute_force(spark, monkeypatch, shuffled):
    """Small tiles and blocks, filters, ties, zero vectors, more queries than a block; sent to all tasks, and shuffled."""
    for name, value in ({"TILE": 16, "GATHERED": 3, "BLOCK": 7, "HELD_ROWS": 60} | ({"SENT_NUMBERS": 0} if shuffled else {})).items():
        monkeypatch.setattr(ranking, name, value)
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(4, 5)) * 4
    vectors = [(centres[i % 4] + rnd.normal(size=5) * 0.3).astype(np.float32).tolist() for i in range(300)] + [[0.0] * 5] * 2
    vectors += vectors[:10] + [None]
    rows = [("pq"[i % 3 == 0], "", f"docs/{i:03}.md", i % 2, None if i % 5 == 0 else f"m{i % 4}", f"t{i % 3}", "s", v) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "project string, repo string, path string, chunk_idx int, module string, doc_type string, status string, embedding array<float>").repartition(5)
    asked = [(k, "pq"[k % 2], "x", f"m{k % 5}" if k % 3 == 0 else None, f"t{k % 4}" if k % 4 == 1 else None, None, 8, (centres[k % 4] + rnd.normal(size=5)).astype(np.float32).tolist() if k % 9 else None) for k in range(60)]
    got = sorted(map(tuple, ranking.nearest(chunks, spark.createDataFrame(asked, QUERY), 6).collect()))
    want = []
    for k, project, _, module, kind, _, _, wanted in asked:
        if wanted is not None:
            unit = np.array(wanted, np.float64) / np.linalg.norm(wanted)
            fit = [r for r in rows if r[0] == project and r[7] is not None and module in (None, r[4]) and kind in (None, r[5])]
            far = [(round(1 - float((np.array(r[7], np.float64) * unit).sum() / (np.linalg.norm(r[7]) or 1)), 9) + 0.0, r[1:4]) for r in fit]
            want += [(k, *key, d) for d, key in sorted(far)[:6]]
    assert got == sorted(want) and len(want) > 200


def ask(spark, result, query, top_k=8, embedding=None, log=None, **filters):
    q = spark.createDataFrame([(1, "p", query, filters.get("module"), filters.get("doc_type"), filters.get("status"), top_k, embedding)], QUERY)
    return search.search_docs(q, result.documents, result.chunks, log=log).orderBy("position").collect()


def test_search_of_documents(spark, tmp_path):
    """Ties come in the order of paths, filters act before the pool is cut, and each search is logged, also one without a hit."""
    files = {f"docs/n{i:02}.md": FM + "# N\n\nmany words\n" for i in range(ranking.POOL + 5)} | {"docs/zz.md": FM.replace("other", "api") + "# Z\n\nmany words\n", "docs/rare.md": FM + "# R\n\nrare " + "filler " * 200 + "thing\n"}
    r, log = run(spark, files), f"{tmp_path}/log"
    tied = ask(spark, r, "many", 12, log=log)
    assert [h["path"] for h in tied] == [f"docs/n{i:02}.md" for i in range(12)] and len({h["score"] for h in tied}) == 1
    assert [h["path"] for h in ask(spark, r, "many", doc_type="api", log=log)] == ["docs/zz.md"]
    assert ask(spark, r, "; !", log=log) == []
    rows = sorted((x["query"], x["filters"], x["hit_count"], x["hit_paths"][:1]) for x in spark.read.parquet(log).collect())
    assert rows == [("; !", "{}", 0, []), ("many", '{"doc_type":"api"}', 1, ["docs/zz.md"]), ("many", "{}", 12, ["docs/n00.md"])]
    assert "thing" in ask(spark, r, "thing")[0]["excerpt"] and "rare" not in ask(spark, r, "thing")[0]["excerpt"]


def test_rows_found_by_their_vector_alone_show_their_head(spark):
    r = run(spark, {"docs/a.md": "# A\n\nhead of the text " + "filler " * 200 + "thing\n"}, embedder=lambda texts: [[1.0, 0.0]] * len(texts))
    assert ask(spark, r, "thing other", embedding=[1.0, 0.0])[0]["excerpt"].startswith("head of the text")


def test_a_search_of_the_stored_index_reads_few_buckets(spark, tmp_path):
    root = f"{tmp_path}/index"
    ing.ingest_into(root, *files_of(spark, {f"docs/{i}.md": f"# T\n\nword{i} shared\n" for i in range(40)}))
    q = spark.createDataFrame([(1, "p", "word7", None, None, None, 8, None)], QUERY)
    assert [r["path"] for r in search.search_index(q, root).collect()] == ["docs/7.md"]
    found = index.read_postings(spark, root, ranking.asked_terms(q))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and found.select("bucket").distinct().count() == 1


def test_fusion(spark):
    arm = lambda rows: spark.createDataFrame([(1, "", p, c, k) for p, c, k in rows], "query_id bigint, repo string, path string, chunk_idx int, rank int")
    q = spark.createDataFrame([(1, 12)], "query_id bigint, top_k int")
    out = ranking.fused(arm([("a", 0, 1), ("b", 0, 2)]), arm([("b", 0, 1)]), q).orderBy("position").collect()
    assert [r["path"] for r in out] == ["b", "a"]
    out = ranking.fused(arm([("a", i, i + 1) for i in range(5)]), arm([]), q).collect()
    assert len(out) == 2


def test_fragment():
    text = "word " * 100 + "alpha beta " + "word " * 100
    part = search.fragment(text, {"alpha", "beta"})
    assert "alpha beta" in part and len(part.split()) == 60
    assert search.fragment("", {"a"}) == ""


def test_scans_read_the_texts(spark, tmp_path):
    rows = [(64, "see [x](7.md)"), (7, "key sk-abcdefghijklmnopqrst in a text"), (9, None), (40, "plain")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in catalog.queries()["secret_scan"](spark, str(tmp_path)).collect()]
    assert found == [("docs/7.md", "key", "sk-abcdefghi")]
    assert sorted(r["path"] for r in catalog.queries()["orphans"](spark, str(tmp_path)).collect()) == ["docs/40.md", "docs/9.md"]


def test_two_projects_with_one_path(spark):
    raw = spark.createDataFrame([("a", "docs/x.md", bytearray(b"# X\n\nbody\n"), None)], "project string, path string, content binary, mtime timestamp")
    listing = spark.createDataFrame([("a", "docs/x.md", "file", True), ("b", "docs/x.md", "link", True)], "project string, path string, kind string, exact boolean")
    made = ing.ingest(raw, listing, spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS))
    runs = {r["project"]: (r["status"], r["error"]) for r in made.run.collect()}
    assert runs == {"a": ("ok", None), "b": ("failed", "no Markdown was found")}
    assert [(r["project"], r["reason"]) for r in made.skipped.collect()] == [("b", "symlink")]
    assert all(r["run_id"] and r["started_at"] <= r["finished_at"] for r in made.run.collect())


def test_event_ids_of_several_batches(spark):
    from inkwell.streaming.intake import numbered

    rows = spark.range(0, 1000, 1, 7).filter("id % 3 <> 0").withColumnRenamed("id", "value")
    ids = [r["id"] for batch in range(3) for r in numbered(rows, batch).collect()]
    assert len(ids) == len(set(ids)) == 3 * 666 and sorted(ids)[:3] == [0, 1, 2]


def test_read_corpus_and_run_ledger(spark, tmp_path):
    top = tmp_path / "docs"  # the root's own name recurs below it
    kept = ("docs/a.md", "docs/sub/b.md", "README.md", "docs/docs/c d.md", "adr/docs/e.md")
    for name in (*kept, "docs/node_modules/c.md", "src/d.md", "docs/e.txt"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(name)
    for root in (f"file://{top}", str(top), f"{top}/"):
        assert {r["path"]: bytes(r["content"]).decode() for r in corpus.read_corpus(spark, root).collect()} == {p: p for p in kept}
    ledger.start_runs(spark.createDataFrame([("a",), ("b",)], "project string"), "r1", f"{tmp_path}/runs")
    done = spark.createDataFrame([("a", "r1", "ok")], "project string, run_id string, status string").selectExpr("*", "current_timestamp() AS started_at", "current_timestamp() AS finished_at")
    ledger.append_run(done, f"{tmp_path}/runs")
    assert {r["project"]: r["status"] for r in ledger.latest_runs(spark.read.parquet(f"{tmp_path}/runs")).collect()} == {"a": "ok", "b": "running"}


def test_reached_by_brute_force(spark):
    rnd = random.Random(5)
    for n, degree in ((30, 1), (60, 2)):
        pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(n * degree // 2)}
        edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
        seen, ahead = {0}, [0]
        while ahead:
            ahead = [b for a, b in pairs if a in ahead and b not in seen]
            seen |= set(ahead)
        got = [r["path"] for r in audit.reached(edges, spark.createDataFrame([("0",)], "path string"), 1).collect()]
        assert len(got) == len(set(got)) and set(got) == {str(x) for x in seen}


def test_a_long_chain_is_reached_in_few_rounds(spark, monkeypatch):
    """Ten thousand documents, each of which links to the next one and back to the first; and a cycle at the end."""
    n = 10_000
    edges = spark.range(n).selectExpr("cast(id as string) src", f"explode(array(cast(if(id = {n - 1}, {n - 50}, id + 1) as string), '0')) dst")
    jobs = []
    real = audit._jumps
    monkeypatch.setattr(audit, "_jumps", lambda e: jobs.append(real(e)) or jobs[-1])
    assert audit.reached(edges, spark.createDataFrame([("0",)], "path string")).count() == n
    assert len(jobs) == 1 and 4 + len(jobs[0]) + 2 <= 21
