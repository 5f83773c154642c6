"""Corpus audit: front matter, links, orphans, fences, phrases, secrets, lifecycle, structure, parity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import has_open_fence, prose
from ..functions.text import front_matter
from ..schemas import DOC_TYPES, STATUSES
from ..sources.corpus import in_index_paths
from ..sources.shared import held, shared_folder


def front_matter_problems(docs: DataFrame) -> DataFrame:
    """path, problem of indexed documents (path, text): what front matter lacks or has wrong; a README must have none."""
    m, readme = F.col("m"), F.col("path").rlike("(?i)^README[^/]*$")
    lacks = lambda k: F.coalesce(m[k], F.lit("")).isin("", "null")
    found = F.array_compact(F.array(
        F.when(readme & m.isNotNull(), "README has front matter"),
        F.when(~readme & m.isNull(), "no front matter"),
        *[F.when(~readme & m.isNotNull() & lacks(k), f"no {k}") for k in ("title", "doc_type", "status")],
        F.when(~readme & m.isNotNull() & ~F.coalesce(F.map_contains_key("m", F.lit("module")), F.lit(False)), "no module key"),
        F.when(~readme & ~lacks("doc_type") & ~m["doc_type"].isin(*DOC_TYPES), "doc_type outside the taxonomy"),
        F.when(~readme & ~lacks("status") & ~m["status"].isin(*STATUSES), "status outside the taxonomy"),
    ))
    rows = docs.filter(in_index_paths(F.col("path"))).select("path", front_matter(F.col("text")).alias("m"))
    return rows.select("path", F.explode(found).alias("problem"))


def resolve_path(base: Column, target: Column) -> Column:
    """target as seen from the document at base, . and .. resolved."""
    parts = F.concat(F.slice(F.split(base, "/"), 1, F.greatest(F.size(F.split(base, "/")) - 1, F.lit(0))), F.split(target, "/"))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def links(docs: DataFrame) -> DataFrame:
    """src, dst of relative Markdown links (fragments dropped); other sites, mail and fragments alone are left out."""
    target = F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)))
    rows = docs.select(F.col("path").alias("src"), target.alias("t")).filter(~F.col("t").rlike(r"^(https?:|mailto:|#)"))
    return rows.select("src", resolve_path(F.col("src"), F.regexp_replace("t", "#.*$", "")).alias("dst"))


def broken_links(docs: DataFrame) -> DataFrame:
    known = docs.select(F.col("path").alias("dst")).distinct()
    return links(docs).join(known, "dst", "left_anti").select("src", "dst")


def _jumps(edges: DataFrame) -> list[DataFrame]:
    """Pointers of the nodes with one edge: level k leads 2^k steps on, or to where their chain ends.

    As many levels as double to the longest chain; on a cycle there is no end, so they stop once they span all nodes.
    """
    step = edges.groupBy("src").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    levels = [held(step)]
    n = levels[0].count()
    while n and 1 << (len(levels) - 1) < n:
        on = levels[-1].select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        level = held(levels[-1].join(on, "dst", "left").select("src", F.coalesce("next", "dst").alias("dst"), F.col("next").isNotNull().alias("moved")))
        levels.append(level.drop("moved"))
        if level.filter("moved").isEmpty():
            break
    return levels


def reached(edges: DataFrame, start: DataFrame, plain_rounds: int = 4) -> DataFrame:
    """path of all that chains of edges (src, dst) lead to from start (path), itself included.

    A round joins the last round's new paths with the edges and appends what is new to a table. After plain_rounds such
    rounds, edges into what is reached are dropped and the rest's chains (one edge a node) are walked by doubled steps, so
    a chain of any length takes as many steps as its length has binary digits. Rounds grow with the branchings on a
    path, not with its length.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)
    n = 0

    def add(paths: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        new = paths.join(spark.read.schema("path string").parquet(*seen), "path", "left_anti") if seen else paths
        new.distinct().write.parquet(f"{folder}/{n}")
        seen.append(f"{folder}/{n}")
        return spark.read.schema("path string").parquet(seen[-1])

    seen: list[str] = []
    edges = held(edges.distinct())
    front = add(start.select("path"))
    while not front.isEmpty():
        for _ in range(plain_rounds):
            front = add(edges.join(front.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path")))
            if front.isEmpty():
                return spark.read.schema("path string").parquet(*seen)
        known = spark.read.schema("path string").parquet(*seen)
        edges = held(edges.join(known.withColumnRenamed("path", "dst"), "dst", "left_anti").select("src", "dst"))
        # From the longest steps to single ones: each node on the front's chains is met.
        for level in reversed(_jumps(edges)):
            ahead = level.join(front.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path"))
            front = held(front.unionByName(add(ahead)))
    return spark.read.schema("path string").parquet(*seen)


def orphans(docs: DataFrame, start: str = "README.md") -> DataFrame:
    """Paths that no chain of links reaches from `start`."""
    seen = reached(links(docs), docs.filter(F.col("path") == start).select("path").distinct())
    return docs.select("path").join(seen, "path", "left_anti")


def _by_text(docs: DataFrame, function, name: str, kind: str) -> DataFrame:
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], name: [function(t) for t in f["text"].fillna("")]})

    return docs.select("path", "text").mapInPandas(task, f"path string, {name} {kind}")


def unclosed_fences(docs: DataFrame) -> DataFrame:
    return _by_text(docs, has_open_fence, "open", "boolean").filter("open").select("path")


def phrase_hits(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """path, phrase: the stated phrases that stand in a document's prose, code stripped."""
    found = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.col("prose").contains(p))
    return _by_text(docs, prose, "prose", "string").select("path", F.explode(found).alias("phrase"))


def secrets(docs: DataFrame) -> DataFrame:
    """path, kind, head (12 characters): keys, private keys and connection strings with a real password; NULs don't hide them."""
    text = F.regexp_replace("text", "\x00", "")
    all_of = lambda pattern, kind, group=0: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("hit")))
    dsn = F.filter(all_of(r"([A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]*:[^\s]+@)", "dsn", 1), lambda s: ~s["hit"].rlike(r":(\*+|\$\{[^}]*\}|)@$"))
    every = F.concat(all_of(r"sk-[A-Za-z0-9_-]{16,}", "key"), all_of(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private key"), dsn)
    return docs.select("path", F.explode(every).alias("s")).select("path", "s.kind", F.substring("s.hit", 1, 12).alias("head"))


def lifecycle_problems(docs: DataFrame, today: Column) -> DataFrame:
    """path, problem: superseded documents need another indexed one that replaces them, stale ones a date not in the future."""
    rows = docs.select("path", front_matter(F.col("text")).alias("m")).select("path", F.col("m")["status"].alias("status"), F.col("m")["superseded_by"].alias("by"), F.try_to_timestamp(F.col("m")["stale_since"], F.lit("yyyy-MM-dd")).cast("date").alias("since"))
    known = docs.select(F.col("path").alias("by")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "by", "left")
    problem = (
        F.when((F.col("status") == "superseded") & F.col("by").isNull(), "no superseded_by")
        .when((F.col("status") == "superseded") & (F.col("by") == F.col("path")), "superseded by itself")
        .when((F.col("status") == "superseded") & F.col("known").isNull(), "superseded by an unknown document")
        .when((F.col("status") == "stale") & F.col("since").isNull(), "no stale_since")
        .when((F.col("status") == "stale") & (F.col("since") > today), "stale_since is in the future")
    )
    return rows.select("path", problem.alias("problem")).filter("problem is not null")


def structure(docs: DataFrame) -> DataFrame:
    """path, h2, h3, tables, table_rows, fences of each document."""
    lines = F.split("text", "\n", -1)
    n = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")
    return docs.select("path", n(r"^##\s").alias("h2"), n(r"^###\s").alias("h3"), n(r"^\s*\|?[\s:|-]*-[\s:|-]*\|[\s:|-]*$").alias("tables"), n(r"^\s*\|").alias("table_rows"), n(r"^ {0,3}(```|~~~)").alias("fences"))


def structure_parity(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, same: whether two documents have equal structure counts."""
    s = structure(docs)
    counts = F.array("h2", "h3", "tables", "table_rows", "fences")
    a, b = s.select(F.col("path").alias("left"), counts.alias("a")), s.select(F.col("path").alias("right"), counts.alias("b"))
    return pairs.join(a, "left").join(b, "right").select("left", "right", (F.col("a") == F.col("b")).alias("same"))


def path_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, side of paths that only one of two lists has."""
    one = lambda x, y, side: x.select("path").distinct().join(y.select("path"), "path", "left_anti").select("path", F.lit(side).alias("side"))
    return one(a, b, "left").unionByName(one(b, a, "right"))


def taxonomy(documents: DataFrame) -> DataFrame:
    """field, value, n of doc_type and status."""
    pair = F.explode(F.array(F.struct(F.lit("doc_type").alias("field"), F.col("doc_type").alias("value")), F.struct(F.lit("status").alias("field"), F.col("status").alias("value"))))
    return documents.select(pair.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
