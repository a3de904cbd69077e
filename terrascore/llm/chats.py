"""Chat formatting: link tool calls to their results, order them, check their arguments, print canonical JSON.

Calls and results are joined by their identifier. A call may name the call after whose
result it was made; its place in the order is the number of calls before it on that
way, found by doubling: in round k every call knows the call 2^k steps back, so that
a chain of any length takes a number of rounds that is its logarithm, and a cycle is seen as a
chain that never ends. Arguments are checked against the schema of their tool. Native expressions only;
a long conversation is never gathered in one place, each message is a row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import stage, table
from terrascore.llm.registry import query

#: Types that a schema may ask for, and the kinds of JSON value that have them.
KINDS = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",),
    "object": ("OBJECT",), "array": ("ARRAY",),
}


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no blanks; null for what is no JSON (a key given twice is none)."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, str]]) -> Column:
    """What is wrong with a call's arguments, as one text: empty if nothing.

    ``schemas`` has for each tool its fields and their types; a type that ends in ``?`` may be missing or null. A tool without a
    schema, arguments that are no JSON object, missing, mistyped and additional fields are errors.
    """
    value = F.try_parse_json(arguments)
    shape = F.schema_of_variant(value)
    result = F.lit("unknown tool")
    for tool, fields in schemas.items():
        found = []
        for field, kind in fields.items():
            # the whole field, not a way into it, so that names with dots or quotes are taken as they are
            path = "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"
            kind_found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            absent = kind_found.isNull() | (kind_found == "VOID")
            fits = F.lit(False)
            for known in KINDS[kind.removesuffix("?")]:
                fits = fits | kind_found.startswith(known)
            missing = F.lit(None) if kind.endswith("?") else F.lit(f"missing {field}")
            found.append(F.when(absent, missing).when(~fits, F.lit(f"type of {field}")))
        keys = F.json_object_keys(F.to_json(value))
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, fields)).cast("array<string>")))
        found.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_join(extra, " "))))
        errors = F.when(value.isNull() | ~shape.startswith("OBJECT"), F.lit("no object")).otherwise(
            F.concat_ws("; ", *found))
        result = F.when(name == tool, errors).otherwise(result)
    return result


def call_order(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, step`` of calls (``conv_id, call_id, after``; one row per call): calls before it on its way.

    A call that names none, or one that isn't there, has step 0; calls on or behind a cycle have a null step.
    """
    key = ["conv_id", "call_id"]
    up = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there")).distinct()
    state = stage(calls.select(*key, "after").distinct().join(up, ["conv_id", "after"], "left").select(
        *key, F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("step")
    ), "calls")
    rounds = max(1, state.count().bit_length()) + 1
    for _ in range(rounds):
        if not state.where(F.col("up").isNotNull()).limit(1).count():
            break
        ahead = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("step").alias("more"))
        state = stage(state.join(ahead, ["conv_id", "up"], "left").select(
            *key, F.col("next").alias("up"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step")), "calls")
    return state.select(*key, F.when(F.col("up").isNull(), F.col("step")).alias("step"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Calls and results with their ``step``, ``status`` and canonical ``json``.

    ``calls`` have ``conv_id, turn, call_id, name, arguments, after``; ``results`` have
    ``conv_id, turn, call_id, content``. Both keep their rows and these columns. A call's
    status is the first of: ``unlinked`` (it has no id or conversation), ``duplicate`` (its id is taken by an earlier call),
    ``cyclic``, ``invalid`` (its ``errors`` say why), ``unanswered``, ``linked``. Of a call's results the
    first by turn and content is ``linked`` and the others are ``repeated``; one without its call is an ``orphan``. A
    conversation or call without an id links to nothing. Arguments that are no JSON are printed as a string.
    """
    key = ["conv_id", "call_id"]
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    # of rows with one id, the earliest stands for the call
    first = calls.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("first"), F.count(F.lit(1)).alias("n"))
    answers = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"))
    one = first.select(*key, F.col("first.after").alias("after"))
    steps = call_order(one.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()))
    known = stage(first.join(steps, key, "left").join(
        answers.select(*key, F.lit(True).alias("answered")), key, "left").select(*key, "first", "step", "answered"), "known")
    me = F.struct("turn", "name", "arguments", "after")
    status = (
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unlinked")
        .when(~me.eqNullSafe(F.col("first")), "duplicate").when(F.col("step").isNull(), "cyclic")
        .when(F.col("errors") != "", "invalid").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    )
    own = ["turn", "name", "arguments", "after"]
    linked_calls = calls.select(*key, *own, errors.alias("errors")).join(known, key, "left").select(
        *key, *own, "step", "errors", status.alias("status"))
    # keys in the order of their names; canonical arguments stand in as JSON, not as a text
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("x"))).substr(
        F.lit(6), F.length(F.to_json(F.struct(F.col("arguments").alias("x")))) - 6), F.lit("null"))
    head = F.concat(F.lit('{"arguments":'), F.when(F.col("arguments").isNull(), "null").otherwise(arguments))
    tail = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("name"), F.lit("call").alias("type")))
    linked_calls = linked_calls.withColumn("json", F.concat(head, F.lit(","), tail.substr(F.lit(2), F.length(tail))))
    first_answers = results.join(known.select(*key, "step", F.lit(True).alias("called")), key, "left").join(
        answers, key, "left")
    place = F.struct("turn", "content")
    result_status = F.when(F.col("called").isNull(), "orphan").when(place.eqNullSafe(F.col("answer")), "linked").otherwise("repeated")
    linked_results = first_answers.select(
        *key, "turn", "content", "step", result_status.alias("status"),
        F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type"))).alias("json"))
    return linked_calls, linked_results


#: Production schema: what the conversations' only tool, an assistant's reply, is asked with.
SCHEMAS = {"reply": {"text": "string", "turn": "integer"}}

SQL = r"""
WITH m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT * FROM m WHERE role = 'user'), r AS (SELECT * FROM m WHERE role = 'assistant'),
o AS (
  -- calls two turns apart are a chain: its start is where the turn before is missing
  SELECT c.conv_id, c.turn, (row_number() OVER (PARTITION BY c.conv_id, c.turn - 2 * g.n ORDER BY c.turn) - 1) AS step
  FROM c JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS n FROM c) g
  ON c.conv_id = g.conv_id AND c.turn = g.turn
)
SELECT c.conv_id, c.turn, c.role, c.conv_id || '-' || c.turn AS link, o.step,
       CASE WHEN c.text IS NULL THEN 'invalid' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       '{"arguments":{' || CASE WHEN c.text IS NULL THEN '' ELSE '"text":' || to_json(c.text) || ',' END
       || '"turn":' || c.turn || '},"id":"' || c.conv_id || '-' || c.turn || '","name":"reply","type":"call"}' AS json
FROM c JOIN o ON c.conv_id = o.conv_id AND c.turn = o.turn LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
UNION ALL
SELECT r.conv_id, r.turn, r.role, r.conv_id || '-' || (r.turn - 1), o.step,
       CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END,
       '{' || CASE WHEN r.text IS NULL THEN '' ELSE '"content":' || to_json(r.text) || ',' END
       || '"id":"' || r.conv_id || '-' || (r.turn - 1) || '","type":"result"}'
FROM r LEFT JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 LEFT JOIN o ON o.conv_id = c.conv_id AND o.turn = c.turn
UNION ALL
SELECT conv_id, turn, role, NULL, NULL, 'message',
       '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || ',' END
       || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role) || ',' END || '"type":"message"}'
FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""


@query("op9_format_chats", SQL)
def op9_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations``: a user's turn is a call of ``reply``, an assistant's turn the result of the call before it.

    A user's turn is made after the result of the one two turns earlier, if there is
    one. Other roles are plain messages. Repeated rows count once.
    """
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()

    def link(turn: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    calls = messages.where(F.col("role") == "user").select(
        "conv_id", "turn", link(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"), link(F.col("turn") - 2).alias("after"))
    results = messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", link(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    plain = messages.where(F.col("role").isNull() | ~F.col("role").isin("user", "assistant"))
    linked_calls, linked_results = link_calls(calls, results, SCHEMAS)

    def shown(frame: DataFrame, role: str) -> DataFrame:
        return frame.select("conv_id", "turn", F.lit(role).alias("role"), F.col("call_id").alias("link"), "step", "status", "json")

    return shown(linked_calls, "user").union(shown(linked_results, "assistant")).union(plain.select(
        "conv_id", "turn", "role", F.lit(None).cast("string").alias("link"), F.lit(None).cast("long").alias("step"),
        F.lit("message").alias("status"), F.to_json(F.struct(F.col("text").alias("content"), "role", F.lit("message").alias("type"))).alias("json")))
