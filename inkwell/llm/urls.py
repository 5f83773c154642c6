"""URL filters by path-template trees, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, salted_join, stored

#: (verdict, host, path), as the query applies them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Beyond so many children of a node, values with less than their even share are variable.
CHILDREN = 8
#: Sibling branches whose shares of child kinds differ by at most this (half the sum of differences), and whose rates of
#: bad labels by at most so many standard errors, are one.
SHAPE, ERRORS = 0.25, 1.96
#: Weight of the prior in a template's purity, and the share of bad labels at which it is rejected.
PRIOR_WEIGHT, REJECT_AT = 4.0, 0.8
#: Parts over which a hot host's rows are dealt.
SALTS = 8
#: Level from which on runs of levels without a fork are looked for, so that they take one step together.
RUNS = 4
#: Levels that the SQL spells out; the operator itself goes as deep as the deepest path.
SQL_LEVELS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. A rule fits its host and every subdomain."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments, runs of digits as <n>, long hexadecimal runs as <h>; one empty one for a bare path."""
    plain = F.regexp_replace(F.regexp_replace(path, "(?<![0-9A-Za-z-])[0-9a-fA-F-]{16,}(?![0-9A-Za-z-])", "<h>"), "[0-9]+", "<n>")
    return F.split(F.regexp_replace(plain, "^/+|/+$", ""), "/+", -1)


def _purity(bad: Column, labelled: Column, prior: Column) -> Column:
    return (bad + PRIOR_WEIGHT * prior) / (labelled + PRIOR_WEIGHT)


def _run_length(tree: DataFrame, i: int, depth: int) -> int:
    """For how many levels from i on no node with several rows forks or ends; where none has several, all that are left."""
    rest = F.slice("segments", i + 1, depth)
    nodes = tree.filter(F.size("segments") > i).groupBy("host", "template").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.count(F.lit(1)).alias("n"))
    fork = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False) - 1
    run = F.when(fork >= 0, fork).otherwise(F.size("lo"))
    return nodes.filter("n > 1").agg(F.coalesce(F.min(run), F.lit(depth - i))).head()[0]


def template_verdicts(urls: DataFrame) -> DataFrame:
    """One row a (host, segments): its template, labelled, bad, purity and verdict.

    urls: host, segments and bad (true, false, or null where not labelled). Level by level, for each node of a host's
    tree: where it has many children, the rare ones become '*'; of the others those are merged into '~' that resemble
    the node's largest child in shape (which kinds of children they have in turn, in which shares) and in the rate of
    bad labels. A branch without labels of its own has the rate of the same branch over all hosts, so labels reach it;
    a branch without either counts as alike. A template's purity is its bad share smoothed towards that of the paths it
    covers over all hosts, which is smoothed towards the share of all labels; at REJECT_AT it is blocked.

    All sums combine before the shuffle. Node facts are joined to children with a salt, so a host of any size is dealt
    out. A level takes a few small jobs. Where no host's node has several children, all go down to the next fork, or to
    their ends, in one step, so it is forks that count, not segments.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    tree = urls.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    # A checkpoint keeps its plan's estimated size, which joins multiply: its digits would double with every level. A table
    # that is read again has its own.
    tree = stored(tree.withColumn("template", F.lit("")), "urls-tree")
    depth = tree.agg(F.max(F.size("segments"))).head()[0] or 0
    i = 0
    while i < depth:
        if i >= RUNS and (run := _run_length(tree, i, depth)):
            further = F.array_join(F.slice("segments", i + 1, run), "/")
            tree = stored(tree.withColumn("template", F.when(F.size("segments") > i, F.concat_ws("/", "template", further)).otherwise(F.col("template"))), "urls-tree")
            i += run
            continue
        s = F.when(F.size("segments") > i, F.get("segments", F.lit(i)))
        below = F.coalesce(F.get("segments", F.lit(i + 1)), F.lit(""))
        own = tree.filter(F.size("segments") > i).select("host", "template", s.alias("s"), below.alias("kind"), "n", "labelled", "bad")
        child = durable(own.groupBy("host", "template", "s").agg(*sums))
        node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"), F.max(F.struct("n", "s")).alias("top"))
        node = node.select("host", "template", "children", "all_n", F.col("top.s").alias("top"))
        over = child.groupBy("template", "s").agg(F.sum("labelled").alias("o_labelled"), F.sum("bad").alias("o_bad"))
        facts = salted_join(salted_join(child, over, ["template", "s"], F.xxhash64("host"), SALTS), node, ["host", "template"], F.xxhash64("s"), SALTS)
        facts = durable(facts)
        # Shares of child kinds, of every child and of its node's largest one.
        shape = own.groupBy("host", "template", "s", "kind").agg(F.sum("n").alias("k"))
        of = facts.select("host", "template", "s", "top", F.col("n").alias("of"))
        shape = salted_join(shape, of, ["host", "template", "s"], F.xxhash64("kind"), SALTS).select("host", "template", "s", "kind", "top", (F.col("k") / F.col("of")).alias("share"))
        shape = durable(shape)
        largest = shape.filter(F.col("s") == F.col("top")).select("host", "template", "kind", F.col("share").alias("top_share"))
        # Two distributions overlap by the sum of their lesser shares.
        alike = salted_join(shape, largest, ["host", "template", "kind"], F.xxhash64("s"), SALTS).groupBy("host", "template", "s").agg(F.sum(F.least("share", F.coalesce("top_share", F.lit(0.0)))).alias("overlap"))
        facts = facts.join(alike, ["host", "template", "s"])  # a row each
        own_rate = F.when(F.col("labelled") > 0, F.col("bad") / F.col("labelled")).when(F.col("o_labelled") > 0, F.col("o_bad") / F.col("o_labelled"))
        facts = facts.select("host", "template", "s", "n", "children", "all_n", "top", "overlap", own_rate.alias("rate"), F.when(F.col("labelled") > 0, F.col("labelled")).otherwise(F.col("o_labelled")).alias("seen"))
        facts = durable(facts)
        best = facts.filter(F.col("s") == F.col("top")).select("host", "template", F.col("rate").alias("t_rate"), F.col("seen").alias("t_seen"))
        facts = salted_join(facts, best, ["host", "template"], F.xxhash64("s"), SALTS)
        mean = (F.col("rate") * F.col("seen") + F.col("t_rate") * F.col("t_seen") + 1) / (F.col("seen") + F.col("t_seen") + 2)
        error = F.sqrt(mean * (1 - mean) * (1 / F.col("seen") + 1 / F.col("t_seen")))
        rates = F.coalesce(F.abs(F.col("rate") - F.col("t_rate")) <= ERRORS * error, F.lit(True))
        rare = (F.col("children") > CHILDREN) & (F.col("n") * F.col("children") < F.col("all_n"))
        merged = (F.col("children") > 1) & (F.round("overlap", 9) >= 1 - SHAPE) & rates
        name = F.when(F.col("s") == "", "").when(rare, "*").when(merged, "~").otherwise(F.col("s"))
        named = facts.select("host", "template", "s", F.concat("template", F.lit("/"), name).alias("__next"))
        rows = salted_join(tree.withColumn("s", s), named, ["host", "template", "s"], F.xxhash64("segments"), SALTS)
        tree = stored(rows.withColumn("template", F.coalesce("__next", "template")).drop("s", "__next"), "urls-tree")
        i += 1
    over = tree.groupBy("segments").agg(F.sum("labelled").alias("o_labelled"), F.sum("bad").alias("o_bad"))
    total = salted_join(tree, over, ["segments"], F.xxhash64("host"), SALTS).groupBy("host", "template")
    total = total.agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad"), F.sum("o_labelled").alias("o_labelled"), F.sum("o_bad").alias("o_bad"))
    labelled, bad = tree.agg(F.sum("labelled"), F.sum("bad")).head()
    out = salted_join(tree, total, ["host", "template"], F.xxhash64("segments"), SALTS)
    whole = F.lit(((bad or 0) + PRIOR_WEIGHT * 0.5) / ((labelled or 0) + PRIOR_WEIGHT))
    purity = F.round(_purity(F.col("t_bad"), F.col("t_labelled"), _purity(F.col("o_bad"), F.col("o_labelled"), whole)), 9)
    out = out.withColumn("purity", purity)
    return out.select("host", "segments", "template", F.col("t_labelled").alias("labelled"), F.col("t_bad").alias("bad"), "purity", F.when(F.col("purity") >= REJECT_AT, "block").otherwise("allow").alias("verdict"))


def judged(pages: DataFrame, rules: tuple = RULES, key: str = "page_id", url: str = "url", label: str | None = None) -> DataFrame:
    """key, host, path, rule, verdict and template of every row.

    A rule's verdict stands; other urls get their template's. The labels from which templates are judged are the
    column `label` (true: bad) where it is named and set, else the rules' own verdicts on urls of the same tree. Null
    urls and urls without :// have an empty host and path, which are judged like any other; repeated rows are repeated
    in the result; an empty table gives an empty result. Other columns, also ones named like those of the result, are
    not looked at.
    """
    host, path = host_and_path(F.col(url))
    told = F.col(label).cast("boolean") if label else F.lit(None).cast("boolean")
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), told.alias("told"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says}).withColumns({"segments": segments(F.col("path")), "bad": F.coalesce("told", F.col("says") == "block")})
    facts = template_verdicts(rows.select("host", "segments", "bad")).select("host", "segments", "template", F.col("verdict").alias("judged"))
    out = salted_join(rows, facts, ["host", "segments"], F.xxhash64("key", "path"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("says", "judged").alias("verdict"), "template")


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, and by its host's path templates where no rule fits."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _level(i: int) -> str:
    """The SQL of one level of the tree."""
    last, s = f"tree{i}", f"a[{i + 1}]"
    return f"""
, own{i} AS (SELECT host, template, {s} AS s, coalesce(a[{i + 2}], '') AS kind, n, labelled, bad FROM {last} WHERE len(a) > {i})
, child{i} AS (SELECT host, template, s, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM own{i} GROUP BY ALL)
, node{i} AS (SELECT host, template, count(*) AS children, sum(n) AS all_n, first(s ORDER BY n DESC, s DESC) AS top FROM child{i} GROUP BY ALL)
, over{i} AS (SELECT template, s, sum(labelled) AS o_labelled, sum(bad) AS o_bad FROM child{i} GROUP BY ALL)
, share{i} AS (SELECT host, template, s, kind, sum(o.n) / c.n AS share FROM own{i} o JOIN child{i} c USING (host, template, s) GROUP BY host, template, s, kind, c.n)
, alike{i} AS (SELECT x.host, x.template, x.s, sum(least(x.share, coalesce(t.share, 0))) AS overlap FROM share{i} x JOIN node{i} USING (host, template)
    LEFT JOIN share{i} t ON t.host = x.host AND t.template = x.template AND t.s = top AND t.kind = x.kind GROUP BY ALL)
, facts{i} AS (SELECT host, template, s, n, children, all_n, top, overlap, CASE WHEN labelled > 0 THEN bad / labelled WHEN o_labelled > 0 THEN o_bad / o_labelled END AS rate,
    CASE WHEN labelled > 0 THEN labelled ELSE o_labelled END AS seen FROM child{i} JOIN over{i} USING (template, s) JOIN node{i} USING (host, template) JOIN alike{i} USING (host, template, s))
, pairs{i} AS (SELECT f.*, t.rate AS t_rate, t.seen AS t_seen, (f.rate * f.seen + t.rate * t.seen + 1) / (f.seen + t.seen + 2) AS mean FROM facts{i} f JOIN facts{i} t ON f.host = t.host AND f.template = t.template AND t.s = f.top)
, named{i} AS (SELECT host, template, s, template || '/' || CASE WHEN s = '' THEN '' WHEN children > {CHILDREN} AND n * children < all_n THEN '*'
    WHEN children > 1 AND round(overlap, 9) >= 1 - {SHAPE}::DOUBLE AND (rate IS NULL OR t_rate IS NULL OR abs(rate - t_rate) <= {ERRORS}::DOUBLE * sqrt(mean * (1 - mean) * (1 / seen + 1 / t_seen))) THEN '~' ELSE s END AS further FROM pairs{i})
, tree{i + 1} AS (SELECT t.host, t.a, coalesce(further, t.template) AS template, n, labelled, bad FROM {last} t LEFT JOIN named{i} m ON m.host = t.host AND m.template = t.template AND m.s = t.{s})"""


SQL = (
    r"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
, split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rests)
, ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
, tokens AS (SELECT *, list_transform(regexp_extract_all(path, '[0-9A-Za-z-]+|[^0-9A-Za-z-]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9a-fA-F-]{16,}') THEN '<h>' ELSE x END) AS w,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad FROM ruled)
, rows AS (SELECT page_id, host, path, rule, bad, regexp_split_to_array(regexp_replace(regexp_replace(array_to_string(w, ''), '[0-9]+', '<n>', 'g'), '^/+|/+$', '', 'g'), '/+') AS a FROM tokens)
, tree0 AS (SELECT host, a, '' AS template, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM rows GROUP BY ALL)"""
    + "".join(_level(i) for i in range(SQL_LEVELS))
    + f"""
, overall AS (SELECT a, sum(labelled) AS o_labelled, sum(bad) AS o_bad FROM tree{SQL_LEVELS} GROUP BY ALL)
, total AS (SELECT host, template, sum(labelled) AS t_labelled, sum(bad) AS t_bad, sum(o_labelled) AS o_labelled, sum(o_bad) AS o_bad FROM tree{SQL_LEVELS} JOIN overall USING (a) GROUP BY ALL)
, prior AS (SELECT (sum(t_bad) + {PRIOR_WEIGHT} * 0.5::DOUBLE) / (sum(t_labelled) + {PRIOR_WEIGHT}) AS p FROM total)
, verdicts AS (SELECT host, template, CASE WHEN round((t_bad + {PRIOR_WEIGHT}::DOUBLE * ((o_bad + {PRIOR_WEIGHT}::DOUBLE * p) / (o_labelled + {PRIOR_WEIGHT}))) / (t_labelled + {PRIOR_WEIGHT}), 9) >= {REJECT_AT}::DOUBLE
    THEN 'block' ELSE 'allow' END AS judged FROM total CROSS JOIN prior)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE judged END AS verdict, t.template
FROM rows r JOIN tree{SQL_LEVELS} t ON r.host = t.host AND r.a = t.a JOIN verdicts v ON v.host = t.host AND v.template = t.template
"""
)
