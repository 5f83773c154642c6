"""Keyword and vector arms of document search, top-n pools, and rank fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, search_text
from ..functions.tokens import length_norm, query_terms, term_weight, tokenize
from ..schemas import PER_DOCUMENT, POOL, RRF_K, TOP_K
from .postings import postings

KEY = ["repo", "path", "chunk_idx"]
#: Rows, and numbers of query vectors, that are sent to all tasks of a join (some 10 and 64 MB); more rows move both sides.
SENT, SENT_NUMBERS = 100_000, 1 << 24
#: Vectors of a tile, tiles of a project that a task gathers, queries of a block, parts of a project in a shuffle.
TILE, GATHERED, BLOCK, SALTS = 2048, 8, 512, 16
#: Found rows that a task holds.
HELD_ROWS = 1 << 21
#: Positions beyond which the distance of two terms counts the same.
NEAR = 100


def token_table(chunks: DataFrame) -> DataFrame:
    """project, KEY, n_tokens, pos, term: every token of every chunk."""
    t = tokenize(search_text(F.col("heading_path"), F.col("content")))
    rows = chunks.select("project", *KEY, t.alias("t"))
    return rows.select("project", *KEY, F.size("t").alias("n_tokens"), F.posexplode("t").alias("pos", "term"))


def filters_fit(q: str = "q_") -> Column:
    """Whether a document row passes the query's filters; a filter that is null passes all."""
    fits = F.lit(True)
    for f in ("module", "doc_type", "status"):
        fits = fits & (F.col(q + f).isNull() | (F.col(q + f) == F.col(f)))
    return fits


def top_per_query(rows: DataFrame, order: list[Column], n: int = POOL, group: str = "query_id", spread: int = 16) -> DataFrame:
    """The first n rows of each group in a total order, in two steps: no task sorts a whole group."""
    part = F.pmod(F.xxhash64(*KEY), F.lit(spread))
    local = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    first = rows.withColumn("__part", part).withColumn("__n", local).filter(F.col("__n") <= n)
    last = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return first.withColumn("__n", last).filter(F.col("__n") <= n).drop("__n", "__part")


def proximity(hits: Column) -> Column:
    """1 less the product of all pairs' misses over (term, positions) structs; 1e-20 without a pair.

    Pairs of terms further apart than NEAR positions all have one factor, a hair below 1, so they are only counted. The
    others stand, in the merged order of positions, among the NEAR places that follow: the work grows with the hits.
    """
    miss = F.lit([1 - math.sqrt(0.1 * 0.1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))) for d in range(1, NEAR + 1)])
    start = F.struct(F.lit(1.0).alias("miss"), F.lit(0).cast("long").alias("n"))
    size = lambda ps: F.size(ps).cast("long")

    def ahead(merged: Column) -> Column:
        """For each hit the product of its misses with the hits that follow, and their number."""

        def one(a: Column, i: Column) -> Column:
            near = F.filter(F.slice(merged, i + 2, NEAR), lambda b: (b["t"] != a["t"]) & (b["p"] - a["p"] <= NEAR))
            return F.aggregate(near, start, lambda acc, b: F.struct((acc["miss"] * F.element_at(miss, b["p"] - a["p"])).alias("miss"), (acc["n"] + 1).alias("n")))

        return F.aggregate(F.transform(merged, one), start, lambda acc, x: F.struct((acc["miss"] * x["miss"]).alias("miss"), (acc["n"] + x["n"]).alias("n")))

    def rank(own: Column) -> Column:
        merged = F.array_sort(F.flatten(F.transform(own, lambda ps, t: F.transform(ps, lambda p: F.struct(p.alias("p"), t.alias("t"))))))
        pairs = F.aggregate(own, F.lit(0).cast("long"), lambda acc, ps: acc + size(ps))
        same = F.aggregate(own, F.lit(0).cast("long"), lambda acc, ps: acc + size(ps) * size(ps))
        far = lambda near: F.pow(F.lit(1 - 0.1 * 1e-15), ((pairs * pairs - same) / 2 - near["n"]).cast("double"))
        return let(let(merged, ahead), lambda near: F.greatest(1 - near["miss"] * far(near), F.lit(1e-20)))

    return let(F.transform(hits, lambda h: F.filter(h["positions"], lambda p: p <= 16383)), rank)


def sent(rows: DataFrame, most: int = SENT) -> DataFrame:
    """rows to be sent to every task of a join where they are at most `most` (counted first), else to meet it in a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, project, q_module, q_doc_type, q_status, n_terms, term: a row for each distinct term of a query."""
    terms = queries.select("query_id", "project", *[F.col(f).alias(f"q_{f}") for f in ("module", "doc_type", "status")], query_terms(F.col("query")).alias("terms"))
    return terms.withColumn("n_terms", F.size("terms")).select("*", F.explode("terms").alias("term")).drop("terms")


def keyword_matches(found: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, KEY, ts_rank of the chunks that have all terms of a query and pass its filters; found: postings of chunks.

    Only postings that some query asks for go on; documents' fields decide before any ranking. A chunk meets a query in
    one row, of one list of positions a term.
    """
    hit = found.join(sent(asked_terms(queries)), ["project", "term"])
    hit = hit.join(documents.select("project", "repo", "path", "module", "doc_type", "status"), ["project", "repo", "path"]).filter(filters_fit())
    hit = hit.groupBy("query_id", *KEY, "n_terms", "n_tokens").agg(F.collect_list(F.struct("term", "positions")).alias("hits"))
    hit = hit.filter(F.size("hits") == F.col("n_terms"))
    raw = F.when(F.col("n_terms") == 1, term_weight(F.size(F.col("hits")[0]["positions"]))).otherwise(proximity(F.col("hits")))
    return hit.select("query_id", *KEY, F.round(raw / length_norm(F.col("n_tokens")), 12).alias("ts_rank"))


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """The postings of chunks that aren't stored (see sources.index.read_postings for those that are)."""
    return postings(chunks, search_text(F.col("heading_path"), F.col("content")), ["project", *KEY])


def keyword_arm(found: DataFrame, documents: DataFrame, queries: DataFrame, pool: int = POOL) -> DataFrame:
    """query_id, KEY, rank, ts_rank: the pool's rows; the pool is a prefix of the total order, so its ranks are the global ones."""
    rows = top_per_query(keyword_matches(found, documents, queries), [F.desc("ts_rank"), *[F.asc(k) for k in KEY]], pool)
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("ts_rank"))))


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(vectors, axis=1)
    norms[norms == 0] = 1.0
    return vectors / norms[:, None], norms


def tiles(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector, TILE of one project in a row: their keys and filter fields as lists, their vectors as bytes.

    Each task gathers a project's rows, puts them in the order of the nearest of some spread pivots, and cuts them, so that
    vectors of a tile lie close together and far tiles can be passed over. Vectors of a project have one length.
    """
    fields = [*KEY, "module", "doc_type", "status"]
    lists = [chunks.schema[f].dataType.simpleString() for f in fields]
    shape = "project string, " + ", ".join(f"{f} array<{t}>" for f, t in zip(fields, lists, strict=True)) + ", dims int, vectors binary"

    def cut(project: str, rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
        vectors = np.array([r[-1] for r in rows], np.float32)
        unit, _ = _unit(vectors.astype(np.float64))
        pivots = unit[:: max(1, len(unit) // GATHERED)][:GATHERED]
        order = np.argsort((unit @ pivots.T).argmax(axis=1), kind="stable")
        for k in range(0, len(rows), TILE):
            own = order[k : k + TILE]
            columns = [[[rows[i][c] for i in own]] for c in range(len(fields))]
            yield pa.RecordBatch.from_pylist([{"project": project, **{f: c[0] for f, c in zip(fields, columns, strict=True)}, "dims": vectors.shape[1], "vectors": vectors[own].tobytes()}], schema=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            if schema is None:
                kinds = [batch.schema.field(f).type for f in fields]
                schema = pa.schema([("project", pa.string()), *[(f, pa.list_(k)) for f, k in zip(fields, kinds, strict=True)], ("dims", pa.int32()), ("vectors", pa.binary())])
            columns = [batch.column(i).to_pylist() for i in range(len(fields) + 2)]
            for project, *row in zip(*columns, strict=True):
                rows = held.setdefault(project, [])
                rows.append(tuple(row))
                if len(rows) >= GATHERED * TILE:
                    yield from cut(project, held.pop(project), schema)
        for project, rows in held.items():
            yield from cut(project, rows, schema)

    return chunks.filter("embedding is not null").select("project", *fields, "embedding").mapInArrow(task, shape)


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Queries with a vector, BLOCK of one project in a row, as `tiles` has chunks."""
    one = queries.filter("embedding is not null").withColumns({"n": F.row_number().over(Window.partitionBy("project", F.pmod(F.xxhash64("query_id"), F.lit(8))).orderBy("query_id")), "part": F.pmod(F.xxhash64("query_id"), F.lit(8))})
    asked = F.collect_list(F.struct("query_id", "module", "doc_type", "status", "embedding"))  # at most BLOCK
    return one.groupBy("project", "part", F.floor(F.col("n") / BLOCK).alias("block")).agg(asked.alias("asked")).select("project", "asked")


def nearest(chunks: DataFrame, queries: DataFrame, pool: int = POOL) -> DataFrame:
    """query_id, KEY, distance: the pool nearest chunks of each query, exact, for any number of queries.

    chunks: project, KEY, module, doc_type, status, embedding (rows without one are absent). Tiles of chunks meet blocks of
    queries of their project; each pair is one matrix product, unless by the triangle inequality nothing in the tile can be
    among a query's nearest. A task keeps the pool nearest so far of each query; the pools are merged in two steps. Few
    queries are sent to all tasks; many meet the tiles in a shuffle, a project's tiles dealt over SALTS parts.
    """
    left, right = tiles(chunks), _query_blocks(queries)
    if (queries.agg(F.sum(F.size("embedding"))).head()[0] or 0) <= SENT_NUMBERS:
        pairs = left.join(F.broadcast(right), "project")
    else:
        salted = left.withColumn("salt", F.pmod(F.xxhash64("vectors"), F.lit(SALTS)).cast("int"))
        pairs = salted.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["project", "salt"]).drop("salt")
    names = ["query_id", *KEY, "distance"]
    fields = ("module", "doc_type", "status")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64())

    def batch_of(best: dict[int, list[tuple]]) -> pa.RecordBatch:
        rows = [(q, *r[1:], r[0]) for q, own in best.items() for r in own]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        edge: dict[int, float] = {}
        for batch in batches:
            for r in range(len(batch)):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                asked = row["asked"].as_py()
                vectors = np.frombuffer(row["vectors"].as_buffer(), np.float32).reshape(-1, row["dims"].as_py()).astype(np.float64)
                unit, norms = _unit(vectors)
                wanted, _ = _unit(np.array([q["embedding"] for q in asked], np.float64))
                centre = unit.mean(axis=0)
                reach = np.inf if not vectors.any(axis=1).all() else np.sqrt(((unit - centre) ** 2).sum(axis=1).max())
                # Of unit vectors, half the squared distance is the cosine distance.
                least = np.maximum(0, np.sqrt(((wanted - centre) ** 2).sum(axis=1)) - reach) ** 2 / 2
                near = [i for i, q in enumerate(asked) if least[i] <= edge.get(q["query_id"], np.inf) + 1e-8]
                about = 1 - wanted[near] @ unit.T
                codes = {f: row[f].values.dictionary_encode() for f in fields}
                numbers = {f: {v: k for k, v in enumerate(c.dictionary.to_pylist())} for f, c in codes.items()}
                codes = {f: c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for f, c in codes.items()}
                keys = {k: row[k].values for k in KEY}
                for i, guess in zip(near, about, strict=True):
                    q = asked[i]
                    fits = np.ones(len(unit), bool)
                    for f in fields:
                        if q[f] is not None:
                            fits &= codes[f] == numbers[f].get(q[f], -2)
                    at = np.flatnonzero(fits & (guess <= edge.get(q["query_id"], np.inf) + 1e-8))
                    if len(at) > pool:  # ties at the edge stay until the keys decide
                        at = at[guess[at] <= np.partition(guess[at], pool - 1)[pool - 1] + 1e-8]
                    if not len(at):
                        continue
                    distance = np.round(1 - (vectors[at] * wanted[i]).sum(axis=1) / norms[at], 9) + 0.0
                    take = pa.array(at)
                    new = list(zip(distance.tolist(), *(keys[k].take(take).to_pylist() for k in KEY), strict=True))
                    own = sorted(best.get(q["query_id"], []) + new)[:pool]
                    best[q["query_id"]] = own
                    if len(own) == pool:
                        edge[q["query_id"]] = own[-1][0]
                if len(best) * pool > HELD_ROWS:  # a task with very many queries hands on what it has
                    yield batch_of(best)
                    best, edge = {}, {}
        if best:
            yield batch_of(best)

    local = pairs.mapInArrow(task, "query_id bigint, repo string, path string, chunk_idx int, distance double")
    return top_per_query(local, [F.asc("distance"), *[F.asc(k) for k in KEY]], pool)


def vector_arm(chunks: DataFrame, queries: DataFrame, pool: int = POOL) -> DataFrame:
    return nearest(chunks, queries, pool).withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy("distance")))


def fused(keyword: DataFrame, vector: DataFrame, queries: DataFrame, per_document: int = PER_DOCUMENT) -> DataFrame:
    """query_id, position, KEY, score, by_keyword: reciprocal rank fusion, the cap per document, then top_k; dropped rows aren't refilled."""
    both = keyword.select("query_id", *KEY, "rank", F.lit(True).alias("k")).unionByName(vector.select("query_id", *KEY, "rank", F.lit(False).alias("k")))
    scores = both.groupBy("query_id", *KEY).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.max("k").alias("by_keyword"))
    in_document = F.row_number().over(Window.partitionBy("query_id", "repo", "path").orderBy(F.desc("score"), "chunk_idx"))
    kept = scores.withColumn("__n", in_document).filter(F.col("__n") <= per_document).drop("__n")
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY))
    limits = queries.select("query_id", F.coalesce("top_k", F.lit(TOP_K)).alias("__k"))
    return kept.withColumn("position", position).join(limits, "query_id").filter(F.col("position") <= F.col("__k")).drop("__k")
