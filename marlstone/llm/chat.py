"""Operator 7: chat formatting with linked tool calls; DataFrame and SQL functions only.

Turns hold plain text or a JSON object.  A system turn may declare tools,
{"tools": [{"name", "parameters": {"properties": {...}, "required": [...]}}]};
an assistant turn may call them, {"content", "tool_calls": [{"id", "name",
"arguments": {...}}]}; a tool turn answers, {"tool_call_id", "content"}.

Calls and results are linked by a hash join on conversation, identifier and the
how-manieth use of the identifier.  Arguments are validated against the
schemas that their conversation declares: required and unknown parameters, and
types.  A tool that is declared more than once counts as declared last, by turn and
then by text.  A call may refer to earlier results as "$ref:<id>" in an argument;
rounds of joins release a call once all it refers to is released, so that the order
of events (anchor turn, step, place) puts dependencies first and each result
after its call.  A round reads the calls released by the one before it and the
references still open, not all calls.  Events are serialised as canonical JSON: keys sorted, no blanks,
arguments through VARIANT, which sorts the keys of objects at every depth.

There is one row for each event and no conversation is gathered: the columns
anchor, step, turn, place sort the events of a conversation.

Status of an event: message, linked, unanswered (call), orphan (result) or cycle
(calls that refer to each other, or to an identifier that isn't called).  Text
that is no such JSON object is a message.  Null texts are messages with null
content; null identifiers link with nothing; null conversations or turns stay and
link with nothing.  Repeated rows give repeated messages; a repeated identifier
links in order of turn and place.  An empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, scratch, table

CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string>>"
RESULT = "tool_call_id string, content string"
TOOLS = "tools array<struct<name:string,parameters:string>>"
#: JSON schema types and the VARIANT types that fit them.
FITS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def parse(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Messages, calls, results and tools of turns (conv, turn, role, text)."""
    json = F.ltrim("text").startswith("{")
    read = turns.select(
        "*", F.when((F.col("role") == "assistant") & json, F.from_json("text", CALLS)).alias("c"),
        F.when((F.col("role") == "tool") & json, F.from_json("text", RESULT)).alias("r"), F.when((F.col("role") == "system") & json, F.from_json("text", TOOLS)).alias("t"),
    )
    calls = read.where("size(c.tool_calls) > 0").select("conv", "turn", F.posexplode("c.tool_calls").alias("place", "x")).select("conv", "turn", "place", F.col("x.id").alias("id"), F.col("x.name").alias("name"), F.col("x.arguments").alias("arguments"))
    results = read.where("r.tool_call_id IS NOT NULL").select("conv", "turn", F.lit(0).alias("place"), F.col("r.tool_call_id").alias("id"), F.col("r.content").alias("content"))
    tools = read.where("size(t.tools) > 0").select("conv", "turn", F.explode("t.tools").alias("x")).select("conv", "turn", F.col("x.name").alias("name"), F.col("x.parameters").alias("parameters"))
    is_call, is_result = F.coalesce(F.size("c.tool_calls") > 0, F.lit(False)), F.col("r.tool_call_id").isNotNull()
    messages = read.where(~is_result & (~is_call | F.col("c.content").isNotNull())).select("conv", "turn", "role", F.when(is_call, F.col("c.content")).otherwise(F.col("text")).alias("content"))
    return messages, calls, results, tools


def numbered(events: DataFrame) -> DataFrame:
    """use: the how-manieth event with that identifier in that conversation; 1 where either is null, as those link with nothing."""
    named = F.col("conv").isNotNull() & F.col("id").isNotNull()
    order = W.partitionBy("conv", "id").orderBy("turn", "place", *(c for c in ("name", "arguments", "content") if c in events.columns))
    return events.where(named).withColumn("use", F.row_number().over(order)).unionByName(events.where(~named).withColumn("use", F.lit(1)))


def problems(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(key, problems): sorted complaints about the arguments of calls whose tool is declared, or that it isn't."""
    schema = tools.groupBy("conv", "name").agg(F.max_by("parameters", F.struct("turn", "parameters")).alias("parameters")).withColumn("declared", F.lit(True))
    both = calls.join(schema, ["conv", "name"], "left").select("key", "declared", F.try_parse_json("arguments").alias("a"), F.from_json("parameters", "properties map<string,struct<type:string>>, required array<string>").alias("s"))
    shape = F.schema_of_variant("a")
    given = both.where(shape.startswith("OBJECT")).select("key", F.from_json(F.to_json("a"), "map<string,variant>").alias("g"))
    both = both.join(given, "key", "left")
    unfit = F.filter(
        F.map_entries("g"),
        lambda e: F.try_element_at(F.col("s.properties"), e["key"])["type"].isNotNull() & ~F.regexp_like(F.schema_of_variant(e["value"]), F.concat(F.lit("^("), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FITS.items() for x in kv]), F.try_element_at(F.col("s.properties"), e["key"])["type"]), F.lit(".*")), F.lit(")$"))),
    )
    keys = F.coalesce(F.map_keys("g"), F.array().cast("array<string>"))
    found = F.when(F.col("declared").isNull(), F.array(F.lit("undeclared tool"))).when(F.col("g").isNull(), F.array(F.lit("arguments are no object"))).otherwise(
        F.concat(
            F.transform(F.array_except(F.coalesce("s.required", F.array().cast("array<string>")), keys), lambda x: F.concat(F.lit("missing "), x)),
            F.transform(F.array_except(keys, F.coalesce(F.map_keys("s.properties"), F.array().cast("array<string>"))), lambda x: F.concat(F.lit("unknown "), x)),
            F.transform(F.coalesce(unfit, F.expr("array()").cast("array<struct<key:string,value:variant>>")), lambda e: F.concat(F.lit("type of "), e["key"])),
        )
    )
    return both.select("key", F.array_sort(found).alias("problems"))


def ordered(calls: DataFrame) -> DataFrame:
    """(key, step, anchor, cycle): in rounds, calls whose references are all released get the greatest step and turn of these."""
    refs = calls.select("key", "conv", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref:([^"]+)"'), F.lit(1)))).alias("id"))
    firsts = calls.where("use = 1").select("conv", "id", F.col("key").alias("on"))
    open_ = scratch(refs.join(firsts, ["conv", "id"], "left").select("key", "on"), "chat-edges")
    turns = calls.select("key", "turn")
    waiting = scratch(open_.groupBy("key").agg(F.count("*").alias("needs")).join(turns, "key").select("key", "needs", F.lit(0).alias("step"), F.col("turn").alias("anchor")), "chat-waiting")
    newest = scratch(calls.join(waiting, "key", "left_anti").select("key", F.lit(0).alias("step"), F.col("turn").alias("anchor")), "chat-order")
    released = [newest]
    while not newest.isEmpty() and not open_.isEmpty():
        met = open_.join(newest.withColumnRenamed("key", "on"), "on").groupBy("key").agg(F.count("*").alias("met"), (F.max("step") + 2).alias("s"), F.max("anchor").alias("a"))
        now = scratch(waiting.join(met, "key", "left").select("key", (F.col("needs") - F.coalesce("met", F.lit(0))).alias("needs"), F.greatest("step", "s").alias("step"), F.greatest("anchor", "a").alias("anchor")), "chat-waiting")
        still = scratch(open_.join(newest.select(F.col("key").alias("on")), "on", "left_anti"), "chat-edges")
        newest = scratch(now.where("needs = 0").drop("needs"), "chat-order")
        forget(open_)
        forget(waiting)
        released, waiting, open_ = [*released, newest], now.where("needs > 0"), still
        if len(released) > 16:
            # the many small tables of a long chain become one, so that no plan grows with its length
            old = released
            released = [scratch(reduce(DataFrame.unionByName, old), "chat-order")]
            for d in old[:-1]:
                forget(d)
    done = reduce(DataFrame.unionByName, released)
    return turns.join(done, "key", "left").select("key", F.coalesce("step", F.lit(0)).alias("step"), F.coalesce("anchor", "turn").alias("anchor"), F.col("step").isNull().alias("cycle"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each event: conv, anchor, step, turn, place, role, status, call id, problems, canonical JSON."""
    read = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    messages, calls, results, tools = parse(read)
    calls = scratch(numbered(calls).withColumn("key", F.monotonically_increasing_id()), "chat-calls")
    results = scratch(numbered(results).withColumn("answer", F.monotonically_increasing_id()), "chat-results")
    order, complaints = ordered(calls), problems(calls, tools)
    placed = calls.join(order, "key").join(complaints, "key", "left")
    linked = placed.hint("shuffle_hash").join(results.select("conv", "id", "use", "answer").withColumn("answered", F.lit(True)), ["conv", "id", "use"], "left")
    body = F.to_json(F.struct(F.coalesce(canonical(F.col("arguments")), F.col("arguments")).alias("arguments"), F.col("id"), F.col("name"), F.lit("assistant").alias("role")))
    status = F.when(F.col("cycle"), "cycle").when(F.col("answered"), "linked").otherwise("unanswered")
    no_problems = F.array().cast("array<string>")
    as_calls = linked.select("conv", "anchor", "step", "turn", "place", F.lit("assistant").alias("role"), status.alias("status"), F.col("id").alias("call_id"), "problems", body.alias("json"))
    answers = results.hint("shuffle_hash").join(placed.select("conv", "id", "use", F.col("anchor").alias("call_anchor"), F.col("step").alias("call_step"), F.col("place").alias("call_place")), ["conv", "id", "use"], "left")
    as_results = answers.select(
        "conv", F.coalesce("call_anchor", "turn").alias("anchor"), F.coalesce(F.col("call_step") + 1, F.lit(0)).alias("step"), "turn", F.coalesce("call_place", "place").alias("place"), F.lit("tool").alias("role"),
        F.when(F.col("call_step").isNull(), "orphan").otherwise("linked").alias("status"), F.col("id").alias("call_id"), no_problems.alias("problems"),
        F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("id").alias("tool_call_id")), {"ignoreNullFields": "false"}).alias("json"),
    )
    as_messages = messages.select(
        "conv", F.col("turn").alias("anchor"), F.lit(-1).alias("step"), "turn", F.lit(0).alias("place"), "role", F.lit("message").alias("status"), F.lit(None).cast("string").alias("call_id"), no_problems.alias("problems"),
        F.to_json(F.struct("content", "role"), {"ignoreNullFields": "false"}).alias("json"),
    )
    return as_messages.unionByName(as_calls).unionByName(as_results).withColumnRenamed("conv", conv_col)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
