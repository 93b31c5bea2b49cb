"""Chat formatting: linking tool calls to results, ordering, checking and canonical JSON. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workdir import looked_up
from .common import materialise, n_words, text_of

KEY = ["conv_id", "call_id"]
#: What schema_of_variant says of a value, by the type that a schema asks for.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def parsed(text: Column) -> Column:
    """The JSON value of a text as a variant, null where it isn't one value.

    try_parse_json ignores what follows a value, so the text is parsed within a
    list and within an object; what closes the one early is a fault in the other.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    other = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(items) == 1) & other.isNotNull(), F.try_element_at(items, F.lit(1)))


def argument_errors(arguments: Column, spec: Column) -> Column:
    """Sorted ``missing:x``, ``type:x`` and ``unlisted:x`` of a map of variants against array<struct<arg,type,required>>."""

    def one(s: Column) -> Column:
        value = F.try_element_at(arguments, s["arg"])
        kind = F.schema_of_variant(value)
        fits = F.lit(False)
        for name, pattern in TYPES.items():
            fits = F.when(s["type"] == name, kind.rlike(pattern)).otherwise(fits)
        return F.when(value.isNull(), F.when(s["required"], F.concat(F.lit("missing:"), s["arg"]))).when(~fits, F.concat(F.lit("type:"), s["arg"]))

    listed = F.filter(F.transform(spec, one), lambda x: x.isNotNull())
    extra = F.transform(F.array_except(F.map_keys(arguments), F.transform(spec, lambda s: s["arg"])), lambda k: F.concat(F.lit("unlisted:"), k))
    return F.array_sort(F.concat(listed, extra))


def call_order(calls: DataFrame) -> DataFrame:
    """From one row per call (KEY, pos, last, parent): KEY, order_pos, hops; hops is null on a cycle or below one.

    ``last`` is the place of the call's last event that a dependent call waits
    for. Each round doubles the way that a row looks up its ancestors, so a chain
    of n calls takes log2(n) rounds. A row that is at its root is closed: it is
    looked up by others, but not written again. What is still open after as many
    rounds as the longest conversation can need is on a cycle or below one.
    """
    up = calls.select("conv_id", F.col("call_id").alias("parent"), F.col("last").alias("above")).hint("merge")
    linked = calls.join(up, ["conv_id", "parent"], "left").select(*KEY, "pos", F.when(F.col("above").isNotNull(), F.col("parent")).alias("ptr"), "above", F.when(F.col("above").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("hops"))
    first = materialise(linked, "calls")
    closed, opened = first.where("ptr IS NULL"), first.where("ptr IS NOT NULL")
    longest = calls.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(math.ceil(math.log2(longest + 1)) + 1):
        if not opened.limit(1).count():
            break
        every = closed.unionByName(opened)
        p = every.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("next"), F.col("above").alias("more"), F.col("hops").alias("steps")).hint("merge")
        jumped = opened.join(p, ["conv_id", "ptr"], "left").select(*KEY, "pos", F.col("next").alias("ptr"), F.greatest("above", "more").alias("above"), (F.col("hops") + F.coalesce("steps", F.lit(0))).alias("hops"))
        new = materialise(jumped, "calls")
        closed, opened = closed.unionByName(new.where("ptr IS NULL")), new.where("ptr IS NOT NULL")
    ends = closed.select(*KEY, F.greatest("pos", F.coalesce("above", "pos")).alias("order_pos"), "hops")
    return ends.unionByName(opened.select(*KEY, F.col("pos").alias("order_pos"), F.lit(None).cast("long").alias("hops")))


def link_tool_calls(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per event with its place in topological order, its status, errors and canonical JSON.

    events: conv_id, pos, kind ('call' or 'result'), call_id, name, arguments
    (JSON text), parent_id (the call whose result a call needs), content.
    schemas: tool, arg, type (a key of TYPES), required; a catalogue of tools.

    Results are hash-joined to calls on (conv_id, call_id). Events of a
    conversation stand in the order (order_pos, depth, pos): a result after its
    call, a call after the result of its parent, otherwise as logged. Of several
    calls with one id the first by pos is the call, others are duplicate_id;
    equal rows share their outcome and stay repeated. Status of a call: no_id,
    duplicate_id, cycle, unknown_tool, bad_json, not_object, invalid, unanswered
    or ok; of a result: no_id, orphan, late (not the first) or ok; of any other
    kind: ignored. A parent that is not there counts as none and is flagged by
    missing_parent. A null conv_id links nothing. Other columns are ignored.
    """
    e = events.select("conv_id", "pos", "kind", "call_id", "name", "arguments", "parent_id", "content")
    named = e.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    results = named.where("kind = 'result'").groupBy(*KEY).agg(F.min("pos").alias("result_pos"))
    first = named.where("kind = 'call'").groupBy(*KEY).agg(F.min(F.struct("pos", "parent_id")).alias("f"))
    first = first.select(*KEY, F.col("f.pos").alias("pos"), F.col("f.parent_id").alias("parent"))
    calls = first.join(results.hint("merge"), KEY, "left").withColumn("last", F.greatest("pos", F.coalesce("result_pos", "pos")))
    calls = materialise(calls, "first_calls")
    facts = calls.select(*KEY, F.col("pos").alias("first_pos"), "result_pos", "parent").join(call_order(calls).hint("merge"), KEY)
    known = calls.select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("parent_there")).hint("merge")
    facts = facts.join(known, ["conv_id", "parent"], "left").select(*KEY, "first_pos", "result_pos", "order_pos", "hops", (F.col("parent").isNotNull() & F.col("parent_there").isNull()).alias("missing_parent"))

    # rows without an id match nothing, so they stay out of the join, where they would all go to one task
    blank = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns if c not in KEY]
    nameless = e.where(F.col("conv_id").isNull() | F.col("call_id").isNull()).select("*", *blank)
    df = named.join(facts.hint("merge"), KEY, "left").select(*nameless.columns).unionByName(nameless)
    specs = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("arg", "type", "required"))).alias("spec"))
    df = df.join(looked_up(specs), F.col("name") == F.col("tool"), "left")
    df = df.withColumn("value", parsed(F.col("arguments"))).withColumn("map", F.try_variant_get("value", "$", "map<string,variant>"))
    call, result, here = F.col("kind") == "call", F.col("kind") == "result", F.col("first_pos").isNotNull()
    errors = F.when(call & F.col("map").isNotNull() & F.col("spec").isNotNull(), argument_errors(F.col("map"), F.col("spec")))
    df = df.withColumn("errors", F.coalesce(errors, F.array().cast("array<string>")))
    no_id = F.col("conv_id").isNull() | F.col("call_id").isNull()
    status = (
        F.when(~F.coalesce(call | result, F.lit(False)), "ignored")
        .when(no_id, "no_id")
        .when(result, F.when(~here, "orphan").when(F.col("pos") > F.col("result_pos"), "late").otherwise("ok"))
        .when(F.col("pos") > F.col("first_pos"), "duplicate_id")
        .when(F.col("hops").isNull(), "cycle")
        .when(F.col("spec").isNull(), "unknown_tool")
        .when(F.col("value").isNull(), "bad_json")
        .when(F.col("map").isNull(), "not_object")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("result_pos").isNull(), "unanswered")
        .otherwise("ok")
    )
    order_pos = F.when(call | result, F.greatest(F.col("pos"), F.col("order_pos")))
    depth = F.col("hops") * 2 + F.when(result, 1).otherwise(0)
    as_call = F.to_json(F.struct(F.col("value").alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("tool_call").alias("type")))
    as_result = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("tool_result").alias("type")))
    return df.select(
        "conv_id", "pos", "kind", "call_id", status.alias("status"), F.array_join("errors", ",").alias("errors"), F.coalesce("missing_parent", F.lit(False)).alias("missing_parent"),
        F.coalesce(order_pos, F.col("pos")).alias("order_pos"), F.coalesce(depth, F.lit(0)).cast("long").alias("depth"), F.when(call, as_call).when(result, as_result).alias("json"),
    )


#: The tools of the query: tool, argument, type, required.
TOOLS = [
    ("lookup", "query", "string", True),
    ("lookup", "limit", "integer", True),
    ("count", "unit", "string", True),
    ("count", "of", "array", True),
    ("count", "exact", "boolean", False),
    ("translate", "text", "string", True),
    ("translate", "formal", "boolean", True),
    ("schedule", "when", "object", True),
    ("schedule", "ratio", "number", True),
]


def events_of(conversations: DataFrame) -> DataFrame:
    """A log of tool events that follows from a table of turns, with the faults that such logs have.

    An assistant's turn calls one of five tools, one of them not in TOOLS, with
    its whole text as an argument; the user's turn after it is the result. Some
    calls need the result of the call before, some logs hold results before
    calls, some arguments lack their first brace, are of a wrong type, missing or
    not listed.
    """
    n, pick, turn = n_words(), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)), F.col("turn")
    listed = F.to_json(F.array(text_of()))
    h = F.substr(listed, F.lit(2), F.length(listed) - 2)  # the text as a JSON string
    word = lambda s: F.lit(s)
    limit = F.when(n % 7 == 0, F.concat(word('"'), n.cast("string"), word('"'))).otherwise(n.cast("string"))
    flag = F.when(n % 2 == 0, "true").otherwise("false")
    body = (
        F.when(pick == 0, F.concat(word('{ "query": '), h, word(', "limit": '), limit, word(" }")))
        .when(pick == 1, F.concat(word('{"unit":"words", "of" : ['), h, word(","), n.cast("string"), word("]"), F.when(n % 5 == 0, ', "depth": 1').otherwise(""), word("}")))
        .when(pick == 2, F.concat(word('{"text": '), h, F.when(n % 3 == 0, "").otherwise(F.concat(word(', "formal":'), flag)), word("}")))
        .when(pick == 3, F.concat(word('{ "when" : {"hour": '), (n % 24).cast("string"), word(', "day": '), (n % 7).cast("string"), word('}, "ratio": '), n.cast("string"), word(".50}")))
        .otherwise(F.concat(word('{"q":'), h, word("}")))
    )
    body = F.when(n % 11 == 0, F.substr(body, F.lit(2))).otherwise(body)
    tool = F.element_at(F.array(*map(F.lit, ("lookup", "count", "translate", "schedule", "unlisted"))), (pick + 1).cast("int"))
    swap = F.when(F.col("conv_id") % 4 == 1, turn + F.when(turn % 2 == 0, 1).otherwise(-1)).otherwise(turn)
    call = F.col("role") == "assistant"
    result = (F.col("role") == "user") & (turn > 0)
    return conversations.where(call | result).select(
        "conv_id", swap.cast("long").alias("pos"), F.when(call, "call").otherwise("result").alias("kind"),
        F.concat(F.lit("c"), F.when(call, turn).otherwise(turn - 1).cast("string")).alias("call_id"),
        F.when(call, tool).alias("name"), F.when(call, body).alias("arguments"),
        F.when(call & (turn >= 2) & (F.pmod(F.col("conv_id") + turn, F.lit(3)) != 0), F.concat(F.lit("c"), (turn - 2).cast("string"))).alias("parent_id"),
        F.when(result, text_of()).alias("content"),
    )
