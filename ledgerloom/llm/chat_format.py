"""Chat formatting with tool-call linking, in DataFrame functions only.

Conventions of the input: an assistant's text may hold
``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`` blocks; a
turn of role ``tool`` is ``{"tool_call_id": ..., "content": ...}``; system texts
may declare ``<tools>[{"name": ..., "parameters": {JSON schema}}]</tools>``.

*Linking.*  Calls and results meet in a hash join on conversation and identifier;
the first call of an identifier owns it.  *Order.*  A result comes right after
the turn of its call, in the order of calls; everything else stays in turn
order: a topological order of "call before result" and of turns.
*Validation.*  Arguments are checked against the tool's schema: ``type``, ``enum``,
``required``, ``properties``, ``items`` and ``additionalProperties`` (a parameter that
isn't declared is reported unless it is ``true``), down to ``LEVELS`` levels of
objects and arrays; what a schema says of deeper ones is reported as unchecked.
A call of a tool that the conversation doesn't declare is reported.  *JSON.*
One object for each message, keys sorted, no white space, arguments
re-serialised with sorted keys.

The result has a row for each message (JSON lines).  Only messages that call or
answer are joined; the others never leave their partition until positions are
numbered.  Positions are a window over a conversation that streams: no
conversation is gathered into one value or task memory, but the messages of one
conversation are numbered by one task.

Defined results: null text is an empty content, null role is "unknown"; rows
that repeat a turn are messages of their own, ordered by role and text; a null
conversation id is a conversation; calls that aren't JSON objects, calls
without a result, repeated identifiers, results without a call and results that
aren't JSON objects stay where they are and are reported in ``problems``; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
TOOLS = r"(?s)<tools>(.*?)</tools>"
#: Levels of objects and arrays that validation goes down.
LEVELS = 3
_TOOLS_TYPE = "array<struct<name:string,parameters:string>>"
#: JSON schema type of a Spark variant's type, by its first word.
_KINDS = {"BIGINT": "integer", "DOUBLE": "number", "DECIMAL": "number", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object", "VOID": "null"}


def json_kind(value: Column) -> Column:
    """JSON schema type of a variant; null of null."""
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.element_at(kinds, F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)), F.when(value.isNotNull(), "other"))


def _strings(*some: Column) -> Column:
    return F.array(*some).cast("array<string>")


def schema_problems(value: Column, schema: Column, name: Column | None = None, levels: int = LEVELS) -> Column:
    """What is wrong with a JSON text under a JSON schema's text, as an array; ``name`` is the place of the value."""
    # one element, so that what is in it is an expression once and not wherever it is used
    bound = F.struct(value.alias("value"), schema.alias("schema"), (F.lit("arguments") if name is None else name).alias("own"), json_kind(F.try_parse_json(value)).alias("kind"))
    return F.flatten(F.transform(F.array(bound), lambda x: _problems(x["value"], x["schema"], x["own"], x["kind"], name is None, levels)))


def _problems(value: Column, schema: Column, own: Column, kind: Column, top: bool, levels: int) -> Column:
    told = F.get_json_object(schema, "$.type")
    child = lambda key: key if top else F.concat(own, F.lit("."), key)
    listed = F.transform(F.from_json(F.get_json_object(schema, "$.enum"), "array<variant>"), lambda v: F.to_json(v))
    given = F.coalesce(F.json_object_keys(value), _strings())
    declared = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>")
    needed = F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), _strings())
    strict = declared.isNotNull() & (F.coalesce(F.get_json_object(schema, "$.additionalProperties"), F.lit("false")) != "true")
    found = [
        F.when(told.isNotNull() & (told != kind) & ~((told == "number") & (kind == "integer")), _strings(F.concat(F.lit("type of "), own))),
        F.when(listed.isNotNull() & ~F.array_contains(listed, F.to_json(F.try_parse_json(value))), _strings(F.concat(F.lit("value of "), own))),
        F.when(kind == "object", F.transform(F.array_except(needed, given), lambda k: F.concat(F.lit("missing "), child(k)))),
        F.when((kind == "object") & strict, F.transform(F.array_except(given, F.map_keys(declared)), lambda k: F.concat(F.lit("undeclared "), child(k)))),
    ]
    items = F.get_json_object(schema, "$.items")
    if levels:
        both = F.struct(F.from_json(value, "map<string,variant>").alias("fields"), declared.alias("declared"))
        inside = F.flatten(F.transform(F.array(both), lambda b: F.flatten(F.transform(
            F.array_intersect(F.map_keys(b["declared"]), given), lambda k: schema_problems(F.to_json(F.element_at(b["fields"], k)), F.element_at(b["declared"], k), child(k), levels - 1)
        ))))
        each = F.transform(F.from_json(value, "array<variant>"), lambda x, i: schema_problems(F.to_json(x), items, F.concat(own, F.lit("["), i.cast("string"), F.lit("]")), levels - 1))
        found += [F.when((kind == "object") & declared.isNotNull(), inside), F.when((kind == "array") & items.isNotNull(), F.flatten(each))]
    else:
        found.append(F.when((kind == "object") & declared.isNotNull() | (kind == "array") & items.isNotNull(), _strings(F.concat(F.lit("unchecked "), own))))
    return F.concat(*[F.coalesce(f, _strings()) for f in found])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, ``position``, ``turn``, ``role``, ``n_calls``, ``n_linked``, ``problems``, ``message``."""
    said = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    is_call = (F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))
    is_result = F.col("role") == "tool"
    said = said.withColumn("key", F.when(is_call | is_result, F.xxhash64("conv", "turn", "role", "text")))

    # the few turns that call or answer
    declared = said.where((F.col("role") == "system") & F.contains("text", F.lit("<tools>"))).select("conv", F.explode(F.regexp_extract_all("text", F.lit(TOOLS), F.lit(1))).alias("block"))
    tools = declared.select("conv", F.explode(F.from_json("block", _TOOLS_TYPE)).alias("tool")).groupBy("conv", F.col("tool.name").alias("name")).agg(F.max(F.coalesce("tool.parameters", F.lit("{}"))).alias("schema"))
    calls = said.where(is_call).select("conv", "turn", "key").distinct()
    blocks = said.where(is_call).select("key", "text").distinct().select("key", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("at", "block"))
    calls = calls.join(blocks, "key").withColumns(
        {"id": F.get_json_object("block", "$.id"), "name": F.get_json_object("block", "$.name"), "arguments": F.coalesce(F.get_json_object("block", "$.arguments"), F.lit("{}")), "sound": F.try_parse_json("block").isNotNull()}
    )
    owners = calls.where("id IS NOT NULL").groupBy("conv", "id").agg(F.min(F.struct("turn", "at", "key")).alias("own"))
    results = said.where(is_result).select("conv", "turn", "key", "text").distinct().select("conv", "key", F.get_json_object("text", "$.tool_call_id").alias("id"), F.coalesce(F.get_json_object("text", "$.content"), F.col("text")).alias("content"), F.try_parse_json("text").isNotNull().alias("sound"))
    answered = results.where("id IS NOT NULL").groupBy("conv", "id").agg(F.count("*").alias("answers"))

    c, o, r = calls.alias("c"), owners.alias("o"), answered.alias("r")
    linked = (
        c.join(o, same_as("c", "o", "id"), "left")
        .join(r, same_as("c", "r", "id"), "left")
        .join(tools.alias("t"), same_as("c", "t", "name"), "left")
        .select("c.*", (F.col("o.own.key").eqNullSafe(F.col("c.key")) & F.col("o.own.at").eqNullSafe(F.col("c.at"))).alias("owns"), F.coalesce("r.answers", F.lit(0)).alias("answers"), F.col("t.schema").alias("schema"))
    )
    readable = F.col("sound") & F.col("name").isNotNull()
    problem = F.concat(
        F.when(~readable, _strings(F.lit("unreadable call"))).otherwise(_strings()),
        F.when(F.col("sound") & F.col("id").isNotNull() & ~F.col("owns"), _strings(F.lit("repeated identifier"))).otherwise(_strings()),
        F.when(F.col("answers") == 0, _strings(F.lit("call without result"))).otherwise(_strings()),
        F.when(readable & F.col("schema").isNull(), _strings(F.lit("undeclared tool"))).otherwise(_strings()),
        F.when(F.col("schema").isNotNull(), F.array_sort(schema_problems(F.col("arguments"), F.col("schema")))).otherwise(_strings()),
    )
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    one = F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), quoted(F.coalesce("id", F.lit(""))), F.lit(',"name":'), quoted(F.coalesce("name", F.lit(""))), F.lit("}"))
    linked = linked.withColumns({"json": one, "problem": problem})
    # calls of one message only: bounded by its text
    of_calls = linked.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("at", "json", "problem"))).alias("calls"), F.count("*").alias("n_calls"), F.count_if(F.col("owns") & (F.col("answers") > 0)).alias("n_linked")
    )
    of_results = results.alias("s").join(o, same_as("s", "o", "id"), "left").groupBy("s.key").agg(
        F.any_value("s.id").alias("result_of"), F.any_value("s.content").alias("content"), F.any_value("s.sound").alias("sound"), F.any_value("o.own").alias("own")
    )

    # messages that neither call nor answer have no key: a join would deal them all to one task
    keyed = said.where("key IS NOT NULL").join(of_calls, "key", "left").join(of_results, "key", "left")
    lines = keyed.unionByName(said.where("key IS NULL"), allowMissingColumns=True)
    body = F.when(F.col("calls").isNotNull(), F.trim(F.regexp_replace("text", CALL, ""))).otherwise(F.coalesce("content", "text"))
    message = F.concat(
        F.lit('{"content":'), quoted(body), F.lit(',"role":'), quoted(F.col("role")),
        F.coalesce(F.concat(F.lit(',"tool_call_id":'), quoted(F.col("result_of"))), F.lit("")),
        F.coalesce(F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("calls", lambda x: x["json"]), ","), F.lit("]")), F.lit("")),
        F.lit("}"),
    )
    problems = F.coalesce(F.array_join(F.flatten(F.transform("calls", lambda x: x["problem"])), "; "), F.lit(""))
    problems = F.when(is_result & ~F.coalesce("sound", F.lit(False)), "unreadable result").when(is_result & F.col("own").isNull(), "result without call").otherwise(problems)
    order = Window.partitionBy("conv").orderBy("at_turn", "after", "at_call", "turn", "role", "text")
    return (
        lines.withColumns({"at_turn": F.coalesce("own.turn", "turn"), "after": F.when(F.col("own").isNotNull(), 1).otherwise(0), "at_call": F.coalesce("own.at", F.lit(-1))})
        .withColumns({"position": F.row_number().over(order).cast("bigint"), "message": message, "problems": problems})
        .select(F.col("conv").alias(conv_col), "position", F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "problems", "message")
    )


def same_as(a: str, b: str, column: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.{column}") == F.col(f"{b}.{column}"))


def quoted(text: Column) -> Column:
    """A JSON string; null of null."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[|\]$", ""))
