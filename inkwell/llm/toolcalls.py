"""Tool-call linking for chat data, in DataFrame operations only: calls, results, order, validation, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable_count

#: Tools by name: their parameters with JSON type, whether required, and least and greatest value or length.
TOOLS: dict[str, dict[str, tuple[str, bool, int | None, int | None]]] = {
    "instruct": {"text": ("string", True, 1, 2000), "turn": ("integer", True, 0, 0)},
    "ask": {"text": ("string", True, 1, 350), "turn": ("integer", True, 0, None), "language": ("string", False, 2, 2)},
}
_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "object": "OBJECT.*", "array": "ARRAY.*"}


def argument_errors(name: Column, arguments: Column, tools: dict = TOOLS) -> Column:
    """What is wrong with a call's arguments (JSON text) by its tool's schema, in a fixed order; empty if nothing is."""
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).rlike("^OBJECT")
    fits = F.lit(None).cast("array<string>")
    for tool, parameters in tools.items():
        found: list[Column] = []
        for field, (kind, required, least, most) in sorted(parameters.items()):
            part = F.try_variant_get(value, f"$.{field}", "variant")
            given = F.coalesce(~F.is_variant_null(part), F.lit(False)) & part.isNotNull()
            if required:
                found.append(F.when(~given, f"{field} is missing"))
            right = F.schema_of_variant(part).rlike(f"^({_KINDS[kind]})$")
            found.append(F.when(given & ~right, f"{field} isn't {kind}"))
            size = F.length(F.try_variant_get(value, f"$.{field}", "string")) if kind == "string" else F.try_variant_get(value, f"$.{field}", "double")
            if least is not None:
                found.append(F.when(given & right & (size < least), f"{field} is under {least}"))
            if most is not None:
                found.append(F.when(given & right & (size > most), f"{field} is over {most}"))
        known = F.array(*[F.lit(f) for f in sorted(parameters)])
        strange = F.array_sort(F.array_except(F.json_object_keys(arguments), known))
        errors = F.concat(F.array_compact(F.array(*found)), F.transform(strange, lambda k: F.concat(k, F.lit(" is unknown"))))
        fits = F.when(name == tool, errors).otherwise(fits)
    broken = F.when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("arguments aren't a JSON object")))
    return F.coalesce(broken, fits, F.array(F.lit("unknown tool")))


def call_levels(calls: DataFrame) -> DataFrame:
    """call_id, level: how many calls come before a call along `after`; null for those that are in or after a cycle.

    calls: call_id (unique), after. Pointers are doubled: each round every call learns the level its pointer has
    gathered and points twice as far, so a chain of n calls takes log2 n joins. A call after one that isn't there is
    a first one.
    """
    known = calls.select(F.col("call_id").alias("there"))
    # Calls without a pointer take no part in the joins: under one null key they would all meet in one task.
    links = calls.filter("after is not null").join(known, F.col("after") == F.col("there"), "left").select("call_id", F.col("there").alias("up"))
    state = calls.filter("after is null").select("call_id", F.lit(None).cast("string").alias("up")).unionByName(links)
    state, waiting = durable_count(state.withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), F.col("up").isNotNull())
    while waiting:
        further = state.toDF("up", "next", "more")
        moved = state.filter("up is not null").join(further, "up", "left").select("call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        state, still = durable_count(state.filter("up is null").select("call_id", "up", "level").unionByName(moved), F.col("up").isNotNull())
        if still == waiting:
            break  # only cycles are left
        waiting = still
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def linked_calls(calls: DataFrame, results: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """One row a call, and one a result without a call: conv_id, call_id, kind, turn, level, n_results, errors, json.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (the call it follows, or null); results: conv_id,
    turn, call_id, content. Results are joined to calls by identifier; of several the one with the first turn (then
    content) counts. Sorting by conv_id, level, turn and call_id is a topological order. errors: of the arguments by
    schema, a result that is missing or not after its call, several results, an unknown predecessor, a cycle. json is
    canonical: keys sorted, no white space.

    Calls repeated under one identifier count as one, the first by turn, name and arguments; null identifiers link
    with nothing and nothing follows them. Null arguments aren't an object. Empty tables give an empty result; other
    columns are not looked at.
    """
    fields = ["conv_id", "turn", "name", "arguments", "after"]
    least = F.min(F.struct("turn", "name", "arguments", "conv_id", "after")).alias("c")
    with_id = calls.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(least).select("call_id", *[F.col(f"c.{f}").alias(f) for f in fields])
    levels = call_levels(with_id.select("call_id", "after"))
    known = with_id.select(F.col("call_id").alias("before"))
    best = results.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    named = with_id.join(levels, "call_id")
    after = named.filter("after is not null").join(known, F.col("after") == F.col("before"), "left")
    first = named.filter("after is null").withColumn("before", F.lit(None).cast("string"))
    rows = after.unionByName(first).join(best, "call_id", "left")
    nameless = calls.filter(F.col("call_id").isNull()).select("call_id", *fields)
    rows = rows.unionByName(nameless.withColumn("level", F.lit(0).cast("long")), allowMissingColumns=True)
    n = F.coalesce("n_results", F.lit(0))
    links = F.array_compact(F.array(
        F.when(F.col("after").isNotNull() & F.col("before").isNull() & F.col("call_id").isNotNull(), "follows an unknown call"),
        F.when(F.col("level").isNull(), "follows itself"),
        F.when((n == 0) & (F.col("name") != "instruct"), "has no result"),
        F.when(n > 1, "has several results"),
        F.when(F.col("r.turn") <= F.col("turn"), "result isn't after its call"),
    ))
    rows = rows.withColumn("errors", F.concat(argument_errors(F.col("name"), F.col("arguments"), tools), links)).withColumn("kind", F.lit("call"))

    names = calls.filter(F.col("call_id").isNotNull()).select("call_id").distinct()
    lost = results.join(names, "call_id", "left_anti").select(
        "conv_id", "call_id", "turn", F.lit("result").alias("kind"), F.struct("turn", "content").alias("r"), F.array(F.lit("has no call")).alias("errors"), F.lit(1).cast("long").alias("n_results")
    )
    rows = rows.unionByName(lost, allowMissingColumns=True)
    body = F.struct("after", F.try_parse_json("arguments").alias("arguments"), "call_id", "errors", "level", "name", F.col("r.content").alias("result"), "turn")
    # Objects of the variant type keep their keys sorted.
    json = F.to_json(F.to_variant_object(body))
    return rows.select("conv_id", "call_id", "kind", "turn", "level", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.array_join("errors", "; ").alias("errors"), json.alias("json"))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each turn but the assistant's is a call, the assistant's answers the turn before.

    A user's turn calls `ask` and follows the user's turn before it, or the system's `instruct` at turn 0.
    """
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    turn = F.col("turn")
    calls = turns.filter(~F.col("role").eqNullSafe("assistant")).select(
        "conv_id",
        "turn",
        name(turn).alias("call_id"),
        F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "instruct").otherwise(F.col("role")).alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.when(turn == 1, name(F.lit(0))).when(turn > 1, name(turn - 2)).alias("after"),
    )
    results = turns.filter(F.col("role") == "assistant").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as linked, ordered and validated calls in canonical JSON."""
    return linked_calls(*conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || '/' || turn AS call_id, CASE role WHEN 'user' THEN 'ask' WHEN 'system' THEN 'instruct' ELSE role END AS name, text,
    CASE WHEN turn = 1 THEN conv_id || '/0' WHEN turn > 1 THEN conv_id || '/' || (turn - 2) END AS after
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'
), results AS (
  SELECT conv_id, turn, conv_id || '/' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
), levels AS (
  SELECT call_id, 0 AS level FROM calls WHERE after IS NULL OR after NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, l.level + 1 FROM calls c JOIN levels l ON c.after = l.call_id
), best AS (
  SELECT call_id, count(*) AS n, min(turn) AS turn, arg_min(content, turn) AS content FROM results GROUP BY call_id
), checked AS (
  SELECT c.*, l.level, coalesce(b.n, 0) AS n, b.content, [e FOR e IN [
      CASE WHEN text IS NULL THEN 'text is missing' END,
      CASE WHEN length(text) < 1 THEN 'text is under 1' END,
      CASE WHEN length(text) > CASE name WHEN 'ask' THEN 350 ELSE 2000 END THEN 'text is over ' || CASE name WHEN 'ask' THEN 350 ELSE 2000 END END,
      CASE WHEN name = 'instruct' AND c.turn > 0 THEN 'turn is over 0' END,
      CASE WHEN after IS NOT NULL AND after NOT IN (SELECT call_id FROM calls) THEN 'follows an unknown call' END,
      CASE WHEN n IS NULL AND name <> 'instruct' THEN 'has no result' END] IF e IS NOT NULL] AS errors
  FROM calls c JOIN levels l USING (call_id) LEFT JOIN best b USING (call_id)
)
SELECT conv_id, call_id, 'call' AS kind, turn, CAST(level AS BIGINT) AS level, CAST(n AS BIGINT) AS n_results, array_to_string(errors, '; ') AS errors,
  CAST(json_object('after', after, 'arguments', json_object('text', text, 'turn', turn), 'call_id', call_id, 'errors', errors, 'level', level, 'name', name, 'result', content, 'turn', turn) AS VARCHAR) AS json
FROM checked
UNION ALL
SELECT conv_id, call_id, 'result', turn, NULL, 1, 'has no call',
  CAST(json_object('after', NULL, 'arguments', NULL, 'call_id', call_id, 'errors', ['has no call'], 'level', NULL, 'name', NULL, 'result', content, 'turn', turn) AS VARCHAR)
FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)
"""
