"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, salted_join, unit_hash

#: Weights dealt to the sources in order of their names, again and again.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST = 3
#: Ranks are cut into so many slices a source; only the slice that holds the cut is sorted.
SLICES = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: source_size, importance, target (double).

    sizes: source, size (words), gain (long, the documents' importance). Targets share the sum of all sizes by weight;
    a source stops at `most` times its size and the rest is shared by weight again, which the sorted running sums below
    give at once: sources by cap / weight, the capped ones are a prefix. A null source is a source, the last by name.
    """
    facts = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("gain")).alias("size_gain"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    facts = facts.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    facts = facts.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    facts = facts.withColumn("level", F.col("left") / F.sum("weight").over(after))
    # The first source in that order that its share doesn't lift over its cap: all before it are capped, none after it.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_ratio).alias("nth"), "level"))
    facts = facts.withColumn("fits", fits).withColumn("chosen", F.min("fits").over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("chosen") * F.col("weight"), F.col("cap").cast("double")))
    return facts.select("source", "source_size", "size_gain", target.cast("double").alias("target"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, power: float = 0.5, seed: str = "mix") -> DataFrame:
    """key, size, source_size, target and taken for every row of docs.

    A source that must give k times its words and a rest gives k whole copies of each document for certain. The rest is a
    Pareto sample: a document's inclusion odds are p / (1 - p) with p in proportion to floor(size ** power) (at least 1)
    and such that the rest is expected; documents come in the order of their random odds over their inclusion odds,
    until the rest's words are reached to the nearest document. power = 0 gives every document of a source the same
    chance. Random numbers are a hash of seed and key, so reruns agree.

    Null or wordless texts have size 0 and taken 0; an empty table gives an empty result; rows with equal keys are drawn
    alike, repeated rows are ordered among themselves by size. Columns other than the three named are not looked at.
    """
    gain = F.greatest(F.lit(1), F.floor(F.pow(F.col("size").cast("double"), F.lit(power)))).cast("long")
    sizes = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = durable(sizes.withColumn("gain", gain))
    facts = source_targets(sizes, weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    facts = durable(facts.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")))
    p = F.when(F.col("size_gain") > 0, F.least(F.lit(1.0), F.col("rest") * F.col("gain") / F.col("size_gain"))).otherwise(0.0)
    u = unit_hash(F.lit(seed), F.col("key"))
    # odds / (1 + odds) is in [0, 1] and has the order of the odds; p = 0 comes last, p = 1 first.
    rank = (u * (1 - F.col("p"))) / (u * (1 - F.col("p")) + (1 - u) * F.col("p"))
    drawn = salted_join(sizes, facts, ["source"], F.xxhash64("key")).withColumn("p", p).withColumn("rank", F.when(F.col("p") > 0, rank).otherwise(1.0))
    drawn = durable(drawn.select("key", "source", "size", "source_size", "target", "copies", "rest", "rank", F.floor(F.col("rank") * SLICES).alias("slice")))

    slices = drawn.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    # The slice in which the running sum reaches the rest; slices below it are in, those above are out.
    cut = slices.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    cut = cut.groupBy("source").agg(F.min(F.struct("slice", "before")).alias("cut")).select("source", F.col("cut.slice").alias("cut"), "cut.before")
    placed = salted_join(drawn, cut, ["source"], F.xxhash64("key"))

    inside = placed.filter(F.col("slice") == F.col("cut"))
    upto = Window.partitionBy("source").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    inside = inside.withColumn("extra", (so_far + F.col("size") / 2 <= F.col("rest")).cast("long"))
    # Where no slice reaches the rest (rounding, or nothing left to take), all slices with a chance are in.
    outside = placed.filter(~F.col("slice").eqNullSafe(F.col("cut")))
    outside = outside.withColumn("extra", F.when(F.col("cut").isNull(), (F.col("rest") > 0.5) & (F.col("rank") < 1)).otherwise(F.col("slice") < F.col("cut")).cast("long"))
    taken = F.col("size") * F.least(F.lit(most), F.col("copies") + F.col("extra"))
    return outside.unionByName(inside).select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, in whole copies; those it doesn't take go."""
    # Rows that share a doc_id are told apart by their text, and repeated rows count together.
    mark = F.xxhash64("text", "source")
    named = docs.withColumn("__name", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), mark.cast("string")))
    taken = mixed(named, key="__name").withColumn("copies", F.floor(F.col("taken") / F.greatest(F.lit(1), F.col("size"))))
    taken = taken.groupBy("__name").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    nth = F.row_number().over(Window.partitionBy("__name").orderBy("__name"))  # over the join's own partitions
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(nth <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    rows = named.join(taken, "__name").withColumn("own", own).filter("own > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same sample in DuckDB: words counted by pattern, targets by repeated sharing, ranks by the same hash and full sorts.
SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), gains AS (
  SELECT *, greatest(1, CAST(floor(pow(CAST(size AS DOUBLE), 0.5)) AS BIGINT)) AS gain FROM docs
), facts AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * gain) AS BIGINT) AS size_gain,
    [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS weight FROM gains GROUP BY source
), ordered AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_of_all,
    CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_after FROM facts
), levels AS (
  SELECT *, rest_of_all / weight_after AS level FROM ordered
), fits AS (
  SELECT l.level, abs(sum(least(CAST(3 * f.source_size AS DOUBLE), l.level * f.weight)) - sum(f.source_size)) AS off FROM levels l, facts f WHERE l.level >= 0 GROUP BY l.level
), targets AS (
  SELECT *, least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(level, off) FROM fits) * weight) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets
), rests AS (
  SELECT *, target - copies * source_size AS rest FROM parts
), odds AS (
  SELECT g.doc_id, g.source, g.size, r.source_size, r.target, r.copies, r.rest,
    CASE WHEN size_gain > 0 THEN least(1.0::DOUBLE, rest * gain / size_gain) ELSE 0.0 END AS p,
    (CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM gains g JOIN rests r ON g.source IS NOT DISTINCT FROM r.source
), ranks AS (
  SELECT *, CASE WHEN p > 0 THEN (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) ELSE 1.0 END AS rank FROM odds
), sums AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranks
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(3, copies + CASE WHEN p > 0 AND before + size / 2 <= rest AND (rest > 0.5 OR before < rest) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM sums
"""
