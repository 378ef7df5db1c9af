"""Chat formatting with linked tool calls, as DataFrame expressions.

Messages are rows (conv_id, turn, role, text). A text may be a JSON object in place of plain prose:

* role ``assistant``: {"content", "tool_calls": [{"id", "name", "arguments": {...}, "depends_on": [ids]}]};
* role ``tool``: {"tool_call_id", "content"};
* role ``system``: {"content", "tools": [{"name", "parameters": JSON schema}]}.

Calls and results are joined by (conversation, identifier) with a hash join. Calls are ordered topologically: a
call's level is one more than the highest level among the calls that it depends on, found in rounds of joins that
touch only unsettled calls; results stand right after the calls that they answer. Arguments are checked against the
schema of the tool's name at every level of nesting (type, one or a list; enum; const; bounds of numbers, lengths, items
and members; required; properties; additionalProperties; items; allOf), by rows of values joined to rows of schemas.
Arguments that meet all this under a schema with other keywords (patterns, references, alternatives and so on) get no
verdict. Each conversation becomes one canonical JSON array: object keys sorted, no blanks, members without a value left out.

Defined results: missing arguments are an empty object; arguments that are no JSON stay as a JSON string and are not
valid, nor are those that are no object where the tool has a schema; other members of such messages than those above
are left out; of calls with one id in a conversation the first holds and the others are duplicates, neither linked
nor answered; of several results for a call the first is linked; a result without a call is an orphan and keeps its
place; a call whose dependency is missing ignores it; calls in a cycle get the level after all settled ones. A tool
without a schema leaves its calls' validity null (left out of the JSON). A text that is no such object is plain content;
null is left out. Rows without conv_id are one conversation; messages are ordered by turn (null last), ties by role and
text. The number of rounds is at most the longest chain of dependencies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import scoped, table

_CALL = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>,tool_call_id:string,tools:array<struct<name:string,parameters:string>>>"

# Keywords of JSON Schema that are checked and those that ask for nothing; its type names, by what schema_of_variant says of a value.
_CHECKED = "type enum const minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength minItems maxItems minProperties maxProperties required properties additionalProperties items allOf".split()
_NOTES = "title description default examples deprecated readOnly writeOnly format $schema $id $comment $defs definitions".split()
_TYPES = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _messages(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    rows = rows.withColumn("at", place)
    special = F.col("role").isin("assistant", "tool", "system") & F.startswith(F.ltrim("text"), F.lit("{"))
    parsed = F.when(special, F.from_json("text", _CALL))
    known = F.coalesce(parsed["tool_calls"].isNotNull() | parsed["tool_call_id"].isNotNull() | parsed["tools"].isNotNull(), F.lit(False))
    return rows.withColumn("p", F.when(known, parsed)).withColumn("content", F.when(known, parsed["content"]).otherwise(F.col("text")))


def _calls(messages: DataFrame) -> DataFrame:
    rows = messages.where("role = 'assistant' and p.tool_calls is not null").select("conv_id", "at", F.posexplode("p.tool_calls").alias("nth", "c"))
    rows = rows.select("conv_id", "at", "nth", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.coalesce(canonical(F.col("c.arguments")), _string(F.col("c.arguments")), F.lit("{}")).alias("arguments"), (F.col("c.arguments").isNotNull() & canonical(F.col("c.arguments")).isNull()).alias("broken"), F.col("c.depends_on").alias("depends_on"))
    first = F.row_number().over(Window.partitionBy("conv_id", "id").orderBy("at", "nth"))
    return rows.withColumn("is_first", F.col("id").isNotNull() & (first == 1))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of every first call; level 0 depends on none."""
    nodes = calls.where("is_first").select("conv_id", "id")
    edges = calls.where("is_first and size(depends_on) > 0").select("conv_id", "id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    edges = table(edges.join(nodes.withColumnRenamed("conv_id", "c2").withColumnRenamed("id", "i2"), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("needs") == F.col("i2"))).select("conv_id", "id", "needs"))
    settled = nodes.join(edges.select("conv_id", "id").distinct().withColumnsRenamed({"conv_id": "c2", "id": "i2"}), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("id") == F.col("i2")), "left_anti").withColumn("level", F.lit(0))
    left, level = edges.count(), 0
    while left:
        level += 1
        settled = table(settled)
        done = settled.select(F.col("conv_id").alias("c2"), F.col("id").alias("i2"))
        waiting = table(edges.join(done, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("needs") == F.col("i2")), "left_anti"))
        open_ = waiting.select(F.col("conv_id").alias("c2"), F.col("id").alias("i2")).distinct()
        ready = edges.select("conv_id", "id").distinct().join(open_, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("id") == F.col("i2")), "left_anti").withColumn("level", F.lit(level))
        remaining = waiting.count()
        if remaining == left:  # what is left waits for itself
            ready = edges.select("conv_id", "id").distinct().withColumn("level", F.lit(level))
            remaining = 0
        settled, edges, left = settled.unionByName(ready), waiting, remaining
    return settled


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is of a JSON Schema type."""
    of = F.schema_of_variant(value)
    if kind == "integer":  # a number without a fraction, however it is written
        number = F.try_variant_get(value, "$", "double")
        return _is(value, "number") & (number == F.floor(number))
    return of.rlike(_TYPES[kind])


def _meets(value: Column, schema: Column) -> Column:
    """Whether a variant meets a schema at its own level: all of _CHECKED but what asks its members or elements."""
    kinds = F.coalesce(F.try_variant_get(schema, "$.type", "array<string>"), F.array(F.try_variant_get(schema, "$.type", "string")))
    known = F.filter(kinds, lambda k: k.isin(*_TYPES, "integer"))
    of_type = (F.size(known) == 0) | reduce(lambda x, y: x | y, [F.array_contains(known, k) & _is(value, k) for k in (*_TYPES, "integer")])
    number = F.when(_is(value, "number"), F.try_variant_get(value, "$", "double"))
    literals = F.from_json(F.to_json(F.try_variant_get(schema, "$.enum", "variant")), "array<variant>")
    same = lambda e: (F.to_json(e) == F.to_json(value)) | F.coalesce(_is(e, "number") & (F.try_variant_get(e, "$", "double") == number), F.lit(False))
    listed, const = F.exists(literals, same), F.try_variant_get(schema, "$.const", "variant")
    bound = lambda name: F.when(_is(F.try_variant_get(schema, f"$.{name}", "variant"), "number"), F.try_variant_get(schema, f"$.{name}", "double"))
    within = lambda size, low, high: F.coalesce(size >= bound(low), F.lit(True)) & F.coalesce(size <= bound(high), F.lit(True))
    inside = F.coalesce(number > bound("exclusiveMinimum"), F.lit(True)) & F.coalesce(number < bound("exclusiveMaximum"), F.lit(True))
    length, items = F.when(_is(value, "string"), F.length(F.try_variant_get(value, "$", "string"))), F.json_array_length(F.to_json(value))
    bounds = inside & within(number, "minimum", "maximum") & within(length, "minLength", "maxLength") & within(items, "minItems", "maxItems")
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), none)
    required = F.coalesce(F.try_variant_get(schema, "$.required", "array<string>"), none)
    own = F.coalesce(F.json_object_keys(F.to_json(F.try_variant_get(schema, "$.properties", "variant"))), none)
    closed = F.coalesce(~F.try_variant_get(schema, "$.additionalProperties", "boolean"), F.lit(False))
    shaped = ~_is(value, "object") | (within(F.size(keys), "minProperties", "maxProperties") & (F.size(F.array_except(required, keys)) == 0) & (~closed | (F.size(F.array_except(keys, own)) == 0)))
    whole = of_type & F.coalesce(listed, literals.isNull()) & F.coalesce(same(const), const.isNull()) & bounds & shaped
    return F.when(_is(schema, "boolean"), F.try_variant_get(schema, "$", "boolean")).otherwise(whole)


def _unsure(schema: Column) -> Column:
    """Whether a schema asks for what is not checked at its own level."""
    keys = F.coalesce(F.json_object_keys(F.to_json(schema)), F.array().cast("array<string>"))
    other = F.size(F.array_except(keys, F.array(*map(F.lit, (*_CHECKED, *_NOTES))))) > 0
    is_ = lambda name, kind: F.coalesce(_is(F.try_variant_get(schema, f"$.{name}", "variant"), kind), F.lit(False))
    return other | is_("items", "array") | is_("exclusiveMinimum", "boolean") | is_("exclusiveMaximum", "boolean")


def _nested(schema: Column) -> Column:
    """Whether a schema has others for members, elements or the value itself."""
    part = lambda name: F.try_variant_get(schema, f"$.{name}", "variant")
    return part("properties").isNotNull() | part("items").isNotNull() | part("allOf").isNotNull() | _is(part("additionalProperties"), "object")


def _children(rows: DataFrame) -> DataFrame:
    """rows: (call, value, schema). The members of objects and the elements of arrays that have a schema of their own, and values again with each schema that they have to meet besides."""
    spark = rows.sparkSession
    members = lambda df, c: df.lateralJoin(spark.tvf.variant_explode(F.col(c).outer()))
    path = rows.select(F.monotonically_increasing_id().alias("at"), "call", "value", F.try_variant_get("schema", "$.properties", "variant").alias("properties"), F.try_variant_get("schema", "$.items", "variant").alias("items"), F.try_variant_get("schema", "$.allOf", "variant").alias("all_of"), F.try_variant_get("schema", "$.additionalProperties", "variant").alias("others"), _nested(F.col("schema")).alias("nested"))
    path = table(path.where("nested").withColumn("others", F.when(_is(F.col("others"), "object"), F.col("others"))))
    objects = path.where((F.col("properties").isNotNull() | F.col("others").isNotNull()) & _is(F.col("value"), "object")).select("at", "call", F.col("value").alias("v"), "properties", "others")
    values = members(objects.select("at", "call", "v", "others"), "v").select("at", "call", F.col("key").alias("k"), "value", "others")
    schemas = members(objects.where("properties is not null").select("at", "properties"), "properties").select("at", F.col("key").alias("k"), F.col("value").alias("schema"))
    arrays = path.where(F.col("items").isNotNull() & _is(F.col("value"), "array")).select("call", F.col("value").alias("v"), F.col("items").alias("schema"))
    besides = members(path.where(_is(F.col("all_of"), "array")).select("call", F.col("value").alias("own"), "all_of"), "all_of").select("call", F.col("own").alias("value"), F.col("value").alias("schema"))
    own = values.where("k is not null").join(schemas, ["at", "k"], "left").select("call", "value", F.coalesce("schema", "others").alias("schema")).where("schema is not null")
    return own.unionByName(members(arrays, "v").where("value is not null").select("call", "value", "schema")).unionByName(besides.where("schema is not null"))


def _validated(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """calls with valid: whether the arguments are an object that meets the tool's schema (null: it has none). A round of joins for each level of nesting."""
    tools = messages.where("role = 'system' and p.tools is not null").select("conv_id", "at", F.posexplode("p.tools").alias("nth", "t"))
    last = F.row_number().over(Window.partitionBy("conv_id", "t.name").orderBy(F.desc("at"), F.desc("nth")))
    tools = tools.withColumn("k", last).where("k = 1").select(F.col("conv_id").alias("c2"), F.col("t.name").alias("n2"), F.try_parse_json("t.parameters").alias("schema")).where("schema is not null")
    call = F.struct("conv_id", "at", "nth")
    rows = calls.join(tools, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("name") == F.col("n2"))).select(call.alias("call"), F.try_parse_json("arguments").alias("value"), "schema")
    checked, level = [], table(rows)
    unsure = _unsure(F.col("schema")).alias("unsure")
    checked.append(level.select("call", (_is(F.col("value"), "object") & _meets(F.col("value"), F.col("schema"))).alias("ok"), unsure))
    while level.where(_nested(F.col("schema"))).take(1):
        level = table(_children(level))
        checked.append(level.select("call", _meets(F.col("value"), F.col("schema")).alias("ok"), unsure))
    meets = F.bool_and(F.coalesce("ok", F.lit(False)))
    verdicts = reduce(DataFrame.unionByName, checked).groupBy("call").agg(F.when(meets & F.bool_or("unsure"), None).otherwise(meets).alias("meets"))
    found = calls.join(verdicts, F.col("conv_id").eqNullSafe(F.col("call.conv_id")) & (F.col("at") == F.col("call.at")) & (F.col("nth") == F.col("call.nth")), "left").drop("call")
    return found.withColumn("valid", F.when(F.col("broken"), F.lit(False)).otherwise(F.col("meets"))).drop("meets", "broken")


@scoped
def format_chat(conversations: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, n_messages, n_calls, n_linked, n_orphans, n_invalid and chat (canonical JSON)."""
    messages = table(_messages(conversations))
    calls = table(_calls(messages))
    calls = _validated(calls, messages)
    levels = _levels(calls).withColumnsRenamed({"conv_id": "c2", "id": "i2"})
    calls = table(calls.join(levels, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("id") == F.col("i2")) & F.col("is_first"), "left").drop("c2", "i2"))

    results = messages.where("role = 'tool' and p.tool_call_id is not null").select("conv_id", "at", F.col("p.tool_call_id").alias("call"))
    results = results.withColumn("nth_result", F.row_number().over(Window.partitionBy("conv_id", "call").orderBy("at")))
    firsts = calls.where("is_first").select(F.col("conv_id").alias("c2"), F.col("id").alias("i2"), F.col("at").alias("call_at"), F.col("level").alias("call_level"), F.col("nth").alias("call_nth")).hint("shuffle_hash")
    linked = results.join(firsts, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("call") == F.col("i2")), "left").select("conv_id", "at", "call_at", "call_level", "call_nth", (F.col("i2").isNotNull() & (F.col("nth_result") == 1)).alias("is_linked"))

    answered = linked.where("is_linked").select(F.col("conv_id").alias("c3"), F.col("call_at").alias("a3"), F.col("call_nth").alias("n3"))
    calls = calls.join(answered, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("at") == F.col("a3")) & (F.col("nth") == F.col("n3")), "left").withColumn("is_answered", F.col("c3").isNotNull() | F.col("a3").isNotNull())
    call_json = F.concat(F.lit('{"arguments":'), F.col("arguments"), F.when(F.length(F.to_json(F.struct("depends_on", "id", "name", "valid"))) > 2, F.concat(F.lit(","), F.substring(F.to_json(F.struct("depends_on", "id", "name", "valid")), F.lit(2), F.length(F.to_json(F.struct("depends_on", "id", "name", "valid")))))).otherwise(F.lit("}")))
    of_message = calls.groupBy("conv_id", "at").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "nth", call_json.alias("json")))).alias("own"), F.count("*").alias("calls"), F.count_if(~F.coalesce("valid", F.lit(True))).alias("invalid"))
    of_message = of_message.withColumnsRenamed({"conv_id": "c4", "at": "a4"})
    linked = linked.withColumnsRenamed({"conv_id": "c5", "at": "a5"})
    rows = messages.join(of_message, F.col("conv_id").eqNullSafe(F.col("c4")) & (F.col("at") == F.col("a4")), "left").join(linked, F.col("conv_id").eqNullSafe(F.col("c5")) & (F.col("at") == F.col("a5")), "left")
    calls_json = F.when(F.size("own") > 0, F.concat(F.lit('"tool_calls":['), F.array_join(F.transform("own", lambda c: c["json"]), ","), F.lit("]")))
    member = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), _string(value)))
    tools = F.when(F.size("p.tools") > 0, F.concat(F.lit('"tools":['), F.array_join(F.transform("p.tools", lambda t: F.concat(F.lit('{"name":'), F.coalesce(_string(t["name"]), F.lit("null")), F.lit(',"parameters":'), F.coalesce(canonical(t["parameters"]), F.lit("null")), F.lit("}"))), ","), F.lit("]")))
    json = F.concat(F.lit("{"), F.concat_ws(",", member("content", F.col("content")), member("role", F.col("role")), member("tool_call_id", F.col("p.tool_call_id")), calls_json, tools), F.lit("}"))
    moved = F.coalesce("is_linked", F.lit(False))
    place = F.struct(F.when(moved, F.col("call_at")).otherwise(F.col("at")).alias("a"), moved.alias("b"), F.when(moved, F.col("call_level")).otherwise(0).alias("c"), F.when(moved, F.col("call_nth")).otherwise(0).alias("d"), F.col("at").alias("e"), json.alias("json"))
    is_result = F.col("p.tool_call_id").isNotNull() & (F.col("role") == "tool")
    chats = rows.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.coalesce(F.sum("calls"), F.lit(0)).alias("n_calls"), F.count_if(moved).alias("n_linked"), F.count_if(F.coalesce(is_result, F.lit(False)) & ~moved).alias("n_orphans"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("n_invalid"), F.sort_array(F.collect_list(place)).alias("m"))
    return chats.withColumn("chat", F.concat(F.lit("["), F.array_join(F.transform("m", lambda x: x["json"]), ","), F.lit("]"))).drop("m")


def _string(value: Column) -> Column:
    """A JSON string literal."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), whole.substr(F.lit(6), F.length(whole) - 6))
