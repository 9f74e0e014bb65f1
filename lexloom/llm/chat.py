"""Chat formatting: link tool calls to results, order them, validate arguments, serialise canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import shared_table
from lexloom.session import ship_package

MAX_PROMPT = 400
SCHEMAS = {
    "reply": {"type": "object", "required": ["prompt"], "additionalProperties": False,
              "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": MAX_PROMPT}, "system": {"type": "string"}}},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``: type, enum, required, properties, additionalProperties, items, lengths and bounds."""
    out = []
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind and not (number and (kind == "number" or isinstance(value, int) or value.is_integer()) if kind in ("number", "integer") else isinstance(value, _TYPES[kind])):
        return [f"{path}: not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: longer than {schema['maxLength']}")
    if number:
        if value < schema.get("minimum", value):
            out.append(f"{path}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{path}: above {schema['maximum']}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    return out


_SURROGATE = re.compile("[\ud800-\udfff]")


def _printable(text: str) -> str:
    """Lone surrogates, which UTF-8 has no form for, as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted names, no spaces and no needless escapes.  A number that JSON has no form for is a ValueError."""
    return _printable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON number")


def check_arguments(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str]]:
    """(canonical JSON of the arguments, or None; what is wrong with them).

    Text that is no JSON, NaN and infinities, numbers out of range and nesting too deep to read are all "no JSON"; nothing raises.
    """
    try:
        value = json.loads(arguments or "", parse_constant=_no_number)
        text = canonical(value)
        wrong = [f"no schema {name}"] if name not in schemas else violations(value, schemas[name])
    except (ValueError, RecursionError, OverflowError):
        return None, ["arguments are no JSON"]
    return text, [_printable(x) for x in wrong]


def order_calls(calls: DataFrame) -> DataFrame:
    """Adds level to (call_id, after): 0 for a call that needs no other, else one more than the highest level of those it follows; null in a cycle and behind one.

    ``after`` is an identifier or an array of them; unknown ones do not count.  Calls that follow one other are chained to the nearest call that follows
    none or several by pointer doubling, so a chain of n calls takes log2(n) joins; the latter are then levelled from the roots on, a join for each
    of them on the longest path.
    """
    after = F.col("after") if calls.schema["after"].dataType.typeName() == "array" else F.array("after")
    ids = calls.select(F.col("call_id").alias("known"))
    edges = calls.select("call_id", F.explode(F.array_distinct(after)).alias("parent")).join(ids, F.col("parent") == F.col("known"), "left_semi")
    edges = shared_table(edges, "call-edges")
    many = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).withColumnRenamed("call_id", "c")
    one = F.col("n") == 1
    state = calls.select("call_id").join(many, F.col("call_id") == F.col("c"), "left")
    state = shared_table(state.select("call_id", F.when(one, F.col("parent")).otherwise(F.col("call_id")).alias("up"), F.when(one, 1).otherwise(0).cast("long").alias("far"),
                                      F.coalesce("n", F.lit(0)).alias("n")), "call-order")
    anchors = state.where("n <> 1").select(F.col("call_id").alias("anchor"))
    for _ in range(max(1, state.count()).bit_length() + 1):
        if not state.join(anchors, F.col("up") == F.col("anchor"), "left_anti").limit(1).count():
            break
        above = state.select(F.col("call_id").alias("c"), F.col("up").alias("u"), F.col("far").alias("f"))
        state = shared_table(state.join(above, F.col("up") == F.col("c")).select("call_id", F.col("u").alias("up"), (F.col("far") + F.col("f")).alias("far"), "n"), "call-order")
    levels = state.where("n = 0").select(F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("at"))
    junctions = state.where("n > 1").select("call_id", F.col("n").alias("need"))
    steps = edges.join(junctions, "call_id").join(state.select(F.col("call_id").alias("parent"), "up", "far"), "parent")
    steps = shared_table(steps.select("call_id", "need", "up", (F.col("far") + 1).alias("far")), "call-steps")
    while steps.limit(1).count():
        ready = steps.join(levels, F.col("up") == F.col("anchor")).groupBy("call_id", "need").agg(F.count("*").alias("have"), F.max(F.col("at") + F.col("far")).alias("at"))
        ready = shared_table(ready.where("have = need").select(F.col("call_id").alias("anchor"), "at"), "call-ready")
        if not ready.limit(1).count():
            break
        levels = levels.unionByName(ready)
        steps = shared_table(steps.join(ready, F.col("call_id") == F.col("anchor"), "left_anti"), "call-steps")
    return state.join(levels, F.col("up") == F.col("anchor"), "left").select("call_id", (F.col("at") + F.col("far")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Join calls (call_id, name, arguments as JSON, after) with results (call_id, content) and serialise each pair.

    Returns call_id, level, status (linked, pending: no result, orphan: no call), valid, errors and json.  A call is level 0 or follows
    others (``after``, one identifier or an array); a result stands directly behind its call, so (level, call_id) is a topological order.  The join is a
    hash join by identifier and no conversation is gathered in one task; rows without an identifier take no part in it.  Of several calls or results with an
    identifier the smallest arguments or content count.  Null identifiers are dropped from neither side: they are pending or orphan.  Arguments that are
    no JSON (see :func:`check_arguments`), and names without a schema, are invalid.  Empty tables give no rows; further columns are ignored.
    """
    schemas = SCHEMAS if schemas is None else schemas
    one = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min_by(F.struct("name", "arguments", "after"), F.struct("arguments", "name", "after")).alias("x"))
    one = shared_table(one.select("call_id", "x.*"), "calls")
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("content").alias("content")).withColumnRenamed("call_id", "result_id")
    levels = order_calls(one).withColumnRenamed("call_id", "level_id")
    rows = one.withColumn("is_call", F.lit(True)).hint("shuffle_hash").join(answers.withColumn("is_result", F.lit(True)), F.col("call_id") == F.col("result_id"), "full")
    rows = rows.join(levels, F.col("call_id") == F.col("level_id"), "left")
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.col("is_result").isNull(), "pending").otherwise("linked")
    rows = rows.select(F.coalesce("call_id", "result_id").alias("call_id"), "name", "arguments", "after", "content", F.col("level").cast("long").alias("level"), status.alias("status"))
    alone = calls.where("call_id IS NULL").select("call_id", "name", "arguments", "after", F.lit("pending").alias("status"))
    rows = rows.unionByName(alone.unionByName(results.where("call_id IS NULL").select("call_id", "content", F.lit("orphan").alias("status")), allowMissingColumns=True), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, errors, text = [], [], []
            for r in b.to_pylist():
                called, wrong, args = r["status"] != "orphan", [], None
                if called:
                    args, wrong = check_arguments(r["name"], r["arguments"], schemas)
                call = f'{{"after":{canonical(r["after"])},"arguments":{args or "null"},"name":{canonical(r["name"])}}}' if called else "null"
                valid.append(called and not wrong)
                errors.append("; ".join(wrong))
                text.append(f'{{"call":{call},"id":{canonical(r["call_id"])},"result":{canonical(r["content"])}}}')
            yield pa.RecordBatch.from_arrays([b["call_id"], b["level"], b["status"], pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(text, pa.string())],
                                             ["call_id", "level", "status", "valid", "errors", "json"])

    ship_package(calls.sparkSession)
    return rows.mapInArrow(run, "call_id string, level long, status string, valid boolean, errors string, json string")


def turn_calls(conversations: DataFrame, system: bool = False) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation's turns stand for.

    A user turn calls ``reply`` with its text as prompt; the result is the text of the next assistant turn of the conversation, if no
    other user turn comes between.  Each call follows the previous user turn's call.  Turns that repeat a (conversation, number) count once, by the
    smallest role and text; turns without number or conversation are left out, and so are those of other roles than user and assistant.  With
    ``system`` the text of the last system turn before a user turn is its call's argument of that name.

    Turns are sorted by range over (conversation, number), so a long conversation is cut into slices that different tasks read; each slice takes over the last
    user, assistant and system turn of those before it.
    """
    rows = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.*")
    rows = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn").withColumn("slice", F.spark_partition_id())
    rows = shared_table(rows, "turn-slices")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    text = F.coalesce("text", F.lit(""))
    known = {"user": F.when(F.col("role") == "user", name), "previous": F.when(F.col("role").isin("user", "assistant"), F.col("role")), "system": F.when(F.col("role") == "system", text)}
    known = {k: c for k, c in known.items() if system or k != "system"}
    rows = rows.withColumns({f"own_{k}": c for k, c in known.items()})
    # what a slice of a conversation takes over from the slices before it
    ahead = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "slice").agg(*[F.max_by(f"own_{k}", F.when(F.col(f"own_{k}").isNotNull(), F.col("turn"))).alias(f"end_{k}") for k in known])
    ends = ends.select("conv_id", "slice", *[F.last(f"end_{k}", ignorenulls=True).over(ahead).alias(f"end_{k}") for k in known])
    before = Window.partitionBy("conv_id", "slice").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ends, ["conv_id", "slice"]).select("role", text.alias("text"), name.alias("call_id"), *[F.coalesce(F.last(f"own_{k}", ignorenulls=True).over(before), f"end_{k}").alias(k) for k in known])
    rows = shared_table(rows, "turns")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), *(["system"] if system else [])))
    calls = rows.where("role = 'user'").select("call_id", F.lit("reply").alias("name"), arguments.alias("arguments"), F.col("user").alias("after"))
    results = rows.where("role = 'assistant'").select(F.when(F.col("previous") == "user", F.col("user")).otherwise(F.concat(F.lit("stray:"), "call_id")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def link_turns(conversations: DataFrame) -> DataFrame:
    """:func:`link` on the calls and results of :func:`turn_calls`; null text is empty, turns of other roles are in no row."""
    return link(*turn_calls(conversations))


def link_all_turns(conversations: DataFrame) -> DataFrame:
    """Every turn: :func:`link_turns` with the governing system turn in the arguments, and rows for the turns that are no call or result.

    Those have status system, unlinked (another role, or none), repeated (a further turn with this conversation and number) or unplaced (no
    conversation or number), no level, and their role and text as json.  ``n_turns`` is the number of input turns a row stands for; its sum is
    the number of input rows.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    kinds = shared_table(turns.where(placed).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n_turns")), "turn-kinds")
    same = F.struct("role", "text")
    first = kinds.groupBy("conv_id", "turn").agg(F.min(same).alias("first"), F.sum("n_turns").alias("n"))
    lone = first.where(~F.coalesce(F.col("first.role").isin("user", "assistant"), F.lit(False))).select(
        "conv_id", "turn", "first.role", "first.text", F.lit(1).cast("long").alias("n_turns"), F.when(F.col("first.role") == "system", "system").otherwise("unlinked").alias("status"))
    again = kinds.join(first.where("n > 1"), ["conv_id", "turn"]).withColumn("n_turns", F.col("n_turns") - same.eqNullSafe(F.col("first")).cast("long"))
    again = again.where("n_turns > 0").select("conv_id", "turn", "role", "text", "n_turns", F.lit("repeated").alias("status"))
    stray = turns.where(~placed).withColumns({"n_turns": F.lit(1).cast("long"), "status": F.lit("unplaced")})
    name = F.when(placed, F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    others = lone.unionByName(again).unionByName(stray).select(name.alias("call_id"), "status", "role", "text", "n_turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [canonical({"id": r["call_id"], "role": r["role"], "text": r["text"]}) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b["call_id"], pa.nulls(len(b), pa.int64()), b["status"], pa.array([False] * len(b), pa.bool_()), pa.array([""] * len(b), pa.string()), pa.array(text, pa.string()), b["n_turns"]],
                                             ["call_id", "level", "status", "valid", "errors", "json", "n_turns"])

    linked = link(*turn_calls(kinds, system=True))
    linked = linked.withColumn("n_turns", F.when(F.col("status") == "linked", 2).otherwise(1).cast("long"))
    return linked.unionByName(others.mapInArrow(run, "call_id string, level long, status string, valid boolean, errors string, json string, n_turns long"))


ORACLE = """
WITH r AS (SELECT conv_id, turn, min(row(coalesce(role, ''), coalesce(text, ''))) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, x[1] AS role, x[2] AS text, conv_id || ':' || turn AS id FROM r),
w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN id END IGNORE NULLS) OVER b AS usr,
        last_value(CASE WHEN role IN ('user', 'assistant') THEN role END IGNORE NULLS) OVER b AS previous,
        count(*) FILTER (role = 'user') OVER b AS level
      FROM t WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT id, text, usr, level FROM w WHERE role = 'user'),
a AS (SELECT CASE WHEN previous = 'user' THEN usr ELSE 'stray:' || id END AS id, text FROM w WHERE role = 'assistant'),
j AS (SELECT coalesce(c.id, a.id) AS call_id, c.level, c.text AS prompt, c.usr, a.text AS content, c.id IS NOT NULL AS is_call, a.id IS NOT NULL AS is_result
      FROM c FULL JOIN a ON c.id = a.id)
SELECT call_id, CASE WHEN is_call THEN level END::BIGINT AS level,
       CASE WHEN NOT is_call THEN 'orphan' WHEN NOT is_result THEN 'pending' ELSE 'linked' END AS status,
       is_call AND length(prompt) BETWEEN 1 AND 400 AS valid,
       CASE WHEN is_call AND length(prompt) < 1 THEN '$.prompt: shorter than 1' WHEN is_call AND length(prompt) > 400 THEN '$.prompt: longer than 400' ELSE '' END AS errors,
       '{"call":' || CASE WHEN is_call THEN '{"after":' || coalesce(to_json(usr)::VARCHAR, 'null') || ',"arguments":{"prompt":' || to_json(prompt) || '},"name":"reply"}' ELSE 'null' END
         || ',"id":' || to_json(call_id) || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM j
"""

#: The same for :func:`link_all_turns`.
TURNS_ORACLE = """
WITH k AS (SELECT conv_id, turn, role, text, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
p AS (SELECT *, conv_id || ':' || turn AS id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS place FROM k),
t AS (SELECT conv_id, turn, role, text, id FROM p WHERE place = 1),
w AS (SELECT * REPLACE (coalesce(text, '') AS text), last_value(CASE WHEN role = 'user' THEN id END IGNORE NULLS) OVER b AS usr,
        last_value(CASE WHEN role IN ('user', 'assistant') THEN role END IGNORE NULLS) OVER b AS previous,
        last_value(CASE WHEN role = 'system' THEN coalesce(text, '') END IGNORE NULLS) OVER b AS sys,
        count(*) FILTER (role = 'user') OVER b AS level
      FROM t WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT id, text, usr, sys, level FROM w WHERE role = 'user'),
a AS (SELECT CASE WHEN previous = 'user' THEN usr ELSE 'stray:' || id END AS id, text FROM w WHERE role = 'assistant'),
j AS (SELECT coalesce(c.id, a.id) AS call_id, c.level, c.text AS prompt, c.usr, c.sys, a.text AS content, c.id IS NOT NULL AS is_call, a.id IS NOT NULL AS is_result
      FROM c FULL JOIN a ON c.id = a.id),
o AS (SELECT id, CASE WHEN role = 'system' THEN 'system' ELSE 'unlinked' END AS status, role, text, 1 AS n_turns FROM t WHERE coalesce(role, '') NOT IN ('user', 'assistant')
      UNION ALL SELECT id, 'repeated', role, text, n - (place = 1)::BIGINT FROM p WHERE n > (place = 1)::BIGINT
      UNION ALL SELECT NULL, 'unplaced', role, text, 1 FROM conversations WHERE conv_id IS NULL OR turn IS NULL)
SELECT call_id, CASE WHEN is_call THEN level END::BIGINT AS level,
       CASE WHEN NOT is_call THEN 'orphan' WHEN NOT is_result THEN 'pending' ELSE 'linked' END AS status,
       is_call AND length(prompt) BETWEEN 1 AND 400 AS valid,
       CASE WHEN is_call AND length(prompt) < 1 THEN '$.prompt: shorter than 1' WHEN is_call AND length(prompt) > 400 THEN '$.prompt: longer than 400' ELSE '' END AS errors,
       '{"call":' || CASE WHEN is_call THEN '{"after":' || coalesce(to_json(usr)::VARCHAR, 'null') || ',"arguments":{"prompt":' || to_json(prompt) || coalesce(',"system":' || to_json(sys), '') || '},"name":"reply"}' ELSE 'null' END
         || ',"id":' || to_json(call_id) || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json,
       CASE WHEN is_call AND is_result THEN 2 ELSE 1 END::BIGINT AS n_turns
FROM j
UNION ALL SELECT id, NULL, status, false, '', '{"id":' || coalesce(to_json(id)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}', n_turns::BIGINT FROM o
"""
