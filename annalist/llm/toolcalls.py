"""Tool calls in chats: linked to their results, ordered, validated, serialised.

Calls and results are joined by (conversation, identifier), a hash join whose key
is as fine as the call. A call may build on the result of an earlier one, so the
calls of a conversation are a forest; its levels come from pointer doubling: in
each round every call jumps twice as far towards its root. Arguments are
exploded, joined with the fields of the tool's schema and checked field by field.
JSON is canonical: no white space, keys in code-point order at every depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.session import cut_lineage

KEY = ["conv_id", "call_id"]


def canonical(json: Column) -> Column:
    """Canonical JSON; null for what is no JSON or names a key twice."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of ``calls`` (conv_id, call_id, after; one row
    per key): 0 without a predecessor among the calls, else one more than the
    predecessor's. Calls on a circle, or behind one, have depth null."""
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    start = calls.join(known, ["conv_id", "after"], "left").select(*KEY, F.when(F.col("known"), F.col("after")).alias("jump"), F.when(F.col("known"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"))
    state = cut_lineage(start)
    open_calls, reach, most = state.where("jump is not null").count(), 1, state.count()
    while open_calls and reach <= most:
        ahead = state.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        state = cut_lineage(state.join(ahead, ["conv_id", "jump"], "left").select(*KEY, F.col("next").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        open_calls, reach = state.where("jump is not null").count(), reach * 2
    return state.select(*KEY, F.when(F.col("jump").isNull(), F.col("depth")).alias("depth"))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors) of ``calls`` (conv_id, call_id, name,
    arguments): the sorted texts ``missing f``, ``unknown f``, ``type f``, and
    for a tool without a schema or arguments that are no JSON object ``tool``
    or ``json``. Calls without errors have no row.

    ``schemas`` (tool, field, type, required): types are ``string``,
    ``integer``, ``number``, ``boolean``, ``array``, ``object``. A JSON null
    counts as missing.
    """
    tools = schemas.select(F.col("tool").alias("name")).distinct().withColumn("listed", F.lit(True))
    read = calls.join(tools, "name", "left").withColumn("parsed", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    general = read.select(*KEY, F.explode(F.array_compact(F.array(F.when(F.col("listed").isNull(), "tool"), F.when(~is_object, "json")))).alias("error"))
    sound = read.where(F.col("listed") & is_object).select(*KEY, "name", "arguments", "parsed")
    single = F.from_json("arguments", "map<string,variant>")
    given = sound.select(*KEY, "name", F.explode(single).alias("field", "value")).select(*KEY, "name", "field", F.schema_of_variant("value").alias("shape"))
    given = given.where(F.coalesce(F.col("shape") != "VOID", F.lit(False)))
    fields = schemas.select(F.col("tool").alias("name"), "field", "type", "required")
    kind = (
        F.when(F.col("shape") == "STRING", "string")
        .when(F.col("shape") == "BOOLEAN", "boolean")
        .when(F.col("shape") == "BIGINT", "integer")
        .when(F.col("shape").startswith("ARRAY"), "array")
        .when(F.col("shape").startswith("OBJECT"), "object")
        .otherwise("number")
    )
    fits = (kind == F.col("type")) | ((F.col("type") == "number") & (kind == "integer"))
    shown = given.join(fields, ["name", "field"], "left").select(*KEY, F.when(F.col("type").isNull(), F.concat(F.lit("unknown "), "field")).when(~fits, F.concat(F.lit("type "), "field")).alias("error"))
    needed = sound.select(*KEY, "name").join(fields.where("required"), "name").select(*KEY, "field")
    missing = needed.join(given, [*KEY, "field"], "left_anti").select(*KEY, F.concat(F.lit("missing "), "field").alias("error"))
    every = general.unionByName(shown.where("error is not null")).unionByName(missing)
    return every.groupBy(*KEY).agg(F.sort_array(F.collect_set("error")).alias("errors"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per different call and result: conv_id, level, turn, kind,
    call_id, status, errors, copies and its canonical ``json``.

    ``calls`` (conv_id, turn, call_id, name, arguments, after) and ``results``
    (conv_id, turn, call_id, content). (conv_id, level, turn, call_id) is a
    topological order: a call has level 2 * depth, its result the next one, and
    a call comes after the result that it builds on.

    ``status`` of a call: ``answered``, ``unanswered``, ``duplicate`` (an
    earlier turn used the identifier; of one turn's calls the first by text
    counts), ``circular`` (level null) or ``nameless`` (null conversation or
    identifier, level null). Of a result: ``answer``, ``duplicate``, ``orphan``
    (no such call, level null), ``nameless``; a circular call's results have a
    null level as well. Equal rows are one row with their number as ``copies``.
    ``errors`` is empty for valid calls, duplicates and results. Arguments that are no
    JSON are kept in ``json`` as a string. Other columns are not read; empty
    input gives no rows.
    """
    calls = calls.groupBy("conv_id", "turn", "call_id", "name", "arguments", "after").agg(F.count(F.lit(1)).alias("copies"))
    results = results.groupBy("conv_id", "turn", "call_id", "content").agg(F.count(F.lit(1)).alias("copies"))
    calls, results = cut_lineage(calls), cut_lineage(results)
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first_call = cut_lineage(calls.where(named).groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("first")))
    first_result = results.where(named).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("first_result"))
    plain = first_call.select(*KEY, "first.*")
    about = (
        first_call.join(levels(plain.select(*KEY, "after")), KEY)
        .join(argument_errors(plain.select(*KEY, "name", "arguments"), schemas), KEY, "left")
        .join(first_result, KEY, "left")
        .select(*KEY, "first", "first_result", (F.col("depth") * 2).alias("level"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
    )
    about = cut_lineage(about)
    none = F.array().cast("array<string>")
    own = F.struct("turn", "name", "arguments", "after")
    call_status = (
        F.when(~named, "nameless")
        .when(~own.eqNullSafe(F.col("first")), "duplicate")
        .when(F.col("level").isNull(), "circular")
        .when(F.col("first_result").isNotNull(), "answered")
        .otherwise("unanswered")
    )
    body = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("text"))))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    shown = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce(body, F.lit("null")), F.lit(',"id":'), shown("call_id"), F.lit(',"name":'), shown("name"), F.lit(',"type":"call"}'))
    result_json = F.concat(F.lit('{"content":'), shown("content"), F.lit(',"id":'), shown("call_id"), F.lit(',"type":"result"}'))
    told = calls.join(about, KEY, "left").select("conv_id", "level", "turn", F.lit("call").alias("kind"), "call_id", call_status.alias("status"), F.when(call_status != "duplicate", F.coalesce("errors", none)).otherwise(none).alias("errors"), "copies", call_json.alias("json"))
    result_status = (
        F.when(~named, "nameless")
        .when(F.col("first").isNull(), "orphan")
        .when(F.struct("turn", "content").eqNullSafe(F.col("first_result")), "answer")
        .otherwise("duplicate")
    )
    answered = results.join(about, KEY, "left").select("conv_id", (F.col("level") + 1).alias("level"), "turn", F.lit("result").alias("kind"), "call_id", result_status.alias("status"), none.alias("errors"), "copies", result_json.alias("json"))
    return told.unionByName(answered)
