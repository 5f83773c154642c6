"""Quality rules and robust multivariate outliers (minimum covariance determinant), in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, salted_join

#: Shortest text, and the share of words in repeated windows, in per cent, that the base rules allow.
MIN_WORDS, MAX_REPEATED = 20, 30
#: Words of a window whose repetition counts.
WINDOW_WORDS = 8
#: Groups with fewer rows are pooled by language, and small pools into one.
MIN_GROUP = 60
#: Share of a group that the covariance is taken from, its consistency factor for 4 normal dimensions, and the steps.
CORE, CONSISTENCY, STEPS = 0.75, 1.48, 3
#: Words added to a text's own when its rates are taken, so that short texts don't scatter.
SHRINK, USUAL_LENGTH = 100.0, 5.0
#: Least scale of each statistic: no group is so uniform that a smaller deviation counts.
FLOORS = (0.05, 0.05, 0.05, 0.1)
#: The 0.9999 quantile of chi square with 4 degrees of freedom.
LIMIT = 23.51
D = len(FLOORS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside WINDOW_WORDS-word windows that occur at least twice in the array, the first occurrence included."""

    def positions(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p, k, d: F.coalesce(F.get(p, k + d)["h"] == F.get(p, k)["h"], F.lit(False))
        return let(pairs, lambda p: F.array_sort(F.transform(F.filter(p, lambda x, k: ((k > 0) & same(p, k, -1)) | same(p, k, 1)), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.when(k == 0, WINDOW_WORDS).otherwise(F.least(F.lit(WINDOW_WORDS), x - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW_WORDS)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(positions(h), covered)))
    return F.when(F.size(words) <= WINDOW_WORDS, F.lit(0)).otherwise(found).cast("long")


def text_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; zeros for null."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: x.rlike(WORD))
    return let(
        F.regexp_extract_all(full, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(full, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            (F.length(full) - F.length(F.regexp_replace(full, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def transformed() -> list[Column]:
    """The statistic vector: log of the mean word length, square roots of the rates of the rest, shrunk for short texts."""
    n = F.col("n_words") + SHRINK
    return [F.log((F.col("word_chars") + SHRINK * USUAL_LENGTH) / n), *[F.sqrt(F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]]


def _estimate(rows: DataFrame, weights: list[Column], factor: float) -> DataFrame:
    """Per group and start s: means s_m0.., factor s_l00.. of the covariance with floors, and its log determinant s_det."""
    sums = []
    for s, w in enumerate(weights):
        x = [F.when(w, F.col(f"x{i}")) for i in range(D)]
        sums += [F.avg(x[i]).alias(f"{s}_m{i}") for i in range(D)]
        sums += [F.avg(x[i] * x[j]).alias(f"{s}_p{i}{j}") for i in range(D) for j in range(i + 1)]
    out = rows.groupBy("grp").agg(*sums)
    for s in range(len(weights)):
        cov = lambda i, j, s=s: (F.col(f"{s}_p{i}{j}") - F.col(f"{s}_m{i}") * F.col(f"{s}_m{j}")) * factor + (FLOORS[i] ** 2 if i == j else 0.0)
        covs = {f"{s}_c{i}{j}": cov(i, j) for i in range(D) for j in range(i + 1)}
        out = out.withColumns(covs)
        for i in range(D):  # entry by entry, so that no expression holds the earlier ones again and again
            for j in range(i + 1):
                rest = F.col(f"{s}_c{i}{j}")
                for k in range(j):
                    rest = rest - F.col(f"{s}_l{i}{k}") * F.col(f"{s}_l{j}{k}")
                out = out.withColumn(f"{s}_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"{s}_l{j}{j}"))
        out = out.withColumn(f"{s}_det", sum((F.log(F.col(f"{s}_l{i}{i}")) for i in range(1, D)), F.log(F.col(f"{s}_l00"))))
    return out.select("grp", *[c for c in out.columns if c[1:3] in ("_m", "_l", "_d")])


def _distance(s: int | str) -> Column:
    """Squared Mahalanobis distance of x0.. from estimate s, by forward substitution within one expression."""
    y: list[Column] = []
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"{s}_m{i}")
        for k in range(i):
            rest = rest - F.col(f"{s}_l{i}{k}") * y[k]
        y.append(rest / F.col(f"{s}_l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _slot(distance: Column) -> Column:
    """A distance as one of some thousand slots, fine near zero."""
    return F.floor(F.log1p(F.least(distance, F.lit(1e12))) * 128).cast("int")


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per group the minimum-covariance-determinant estimate b_*: means, Cholesky factor, log determinant.

    rows: grp, spread (integer), x0... Two starts, the group's plain moments and those of the rows near its medians,
    take concentration steps: distances from the estimate, the CORE share with the smallest ones (found by counts of
    distance slots, so no group is sorted), their moments. The start that ends with the smaller determinant is kept.
    """
    mid = rows.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"q{i}") for i in range(D)])
    near = salted_join(rows, durable(mid), ["grp"], F.col("spread"))
    close = F.greatest(*[F.abs(F.col(f"x{i}") - F.col(f"q{i}")) / (2 * FLOORS[i]) for i in range(D)]) <= 1
    facts = durable(_estimate(near.withColumn("close", close), [F.lit(True), F.col("close")], 1.0))
    for _ in range(steps):
        placed = salted_join(rows, facts, ["grp"], F.col("spread"))
        # A start without rows near the medians has no distances and falls back to the other.
        placed = placed.withColumns({"d0": _slot(_distance(0)), "d1": _slot(F.coalesce(_distance(1), _distance(0)))})
        placed = placed.select("grp", "spread", *[f"x{i}" for i in range(D)], "d0", "d1")
        slots = placed.select("grp", F.posexplode(F.array("d0", "d1")).alias("s", "d")).groupBy("grp", "s", "d").agg(F.count(F.lit(1)).alias("n"))
        of = Window.partitionBy("grp", "s")
        slots = slots.withColumn("upto", F.sum("n").over(of.orderBy("d"))).withColumn("all", F.sum("n").over(of))
        cut = slots.filter(F.col("upto") >= F.ceil(F.col("all") * CORE)).groupBy("grp").agg(F.min(F.when(F.col("s") == 0, F.col("d"))).alias("cut0"), F.min(F.when(F.col("s") == 1, F.col("d"))).alias("cut1"))
        placed = salted_join(placed, cut, ["grp"], F.col("spread"))
        facts = durable(_estimate(placed, [F.col("d0") <= F.col("cut0"), F.col("d1") <= F.col("cut1")], CONSISTENCY))
    names = [c[2:] for c in facts.columns if c.startswith("0_")]
    first = F.coalesce(F.col("0_det") <= F.col("1_det"), F.lit(True))
    return facts.select("grp", *[F.when(first, F.col(f"0_{n}")).otherwise(F.col(f"1_{n}")).alias(f"b_{n}") for n in names])


def ruled(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", limit: float = LIMIT) -> DataFrame:
    """key, the statistics, base_failed, kept and distance of every row of docs.

    The base rules reject texts with too few words or too many in repeated windows. Of the others, a row whose
    transformed statistics are further than `limit` (squared Mahalanobis distance) from the robust estimate of its
    language and source is rejected; languages and sources with fewer than MIN_GROUP such rows are judged with the
    other small ones of the language, and those with all small ones. Null languages and sources are groups of their
    own. Null or empty texts fail the base rules; repeated rows are judged alike; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), text_statistics(F.col(text)).alias("s"))
    rows = rows.select("key", "lang", "source", "s.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumns({f"x{i}": x for i, x in enumerate(transformed())})
    rows = durable(rows.withColumn("spread", F.xxhash64("key")))

    good = ~F.col("base_failed")
    cells = rows.filter(good).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    pool = cells.filter(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("pooled")).withColumnRenamed("lang", "pool_lang")
    cells = cells.join(pool, F.col("lang").eqNullSafe(F.col("pool_lang")), "left")
    own, of_lang = F.col("n") >= MIN_GROUP, F.col("pooled") >= MIN_GROUP
    grp = F.when(own, F.to_json(F.struct("lang", "source"))).when(of_lang, F.to_json(F.struct("lang"))).otherwise("all")
    named = salted_join(rows, durable(cells.select("lang", "source", grp.alias("grp"))), ["lang", "source"], F.col("spread"))
    named = durable(named.drop("lang", "source"))

    facts = robust_estimates(named.filter(good).select("grp", "spread", *[f"x{i}" for i in range(D)]))
    out = salted_join(named, facts, ["grp"], F.col("spread")).withColumn("distance", F.when(good, _distance("b")))
    kept = good & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)
    return out.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's statistics, base verdict and robust outlier verdict."""
    return ruled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
