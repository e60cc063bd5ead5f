"""Chat formatting: tool calls linked to their results, with DataFrame and SQL functions only.

A message whose text is a JSON object may carry ``tool_calls`` (a list of id, name and arguments); one of role ``tool``
carries ``tool_call_id``.  Calls and results are hash-joined by conversation and identifier and ordered topologically, along
chains of any length, so that every result comes after its call.  Arguments are checked against the tools' schemas, a table or what
the conversations declare, and every message becomes one line of canonical JSON: keys sorted, no white space, numbers and strings in one form.

While JSON is taken apart, a number is a string that begins with MARK, as variants would round long ones; a string that begins
with MARK itself gets a second one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What begins a number, and how JSON writes it.
MARK, MARK_JSON = "\x01", r"\u0001"
#: Digits up to which a number is written without an exponent.
PLAIN_DIGITS = 64
# The tokens of JSON; anything between strings and numbers stays as it is.
TOKEN = r'"(?:[^"\\]|\\.)*+"|-?[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|[^"0-9-]++|[\s\S]'
SCHEMA_COLUMNS = (
    "name string, path array<string>, types array<string>, options array<string>, required array<string>, keys array<string>, closed boolean, "
    "least double, most double, least_size int, most_size int"
)
OUT = ["conv_id", "turn", "role", "sort_turn", "sort_rank", "n_calls", "n_answered", "n_invalid", "link", "message_json"]
MESSAGE = ["conv_id", "turn", "h"]
#: Path element of an array's items.
ITEMS = "*"


def schema_table(spark, tools: dict[str, dict]) -> DataFrame:
    """Tools' JSON schemas as rows of SCHEMA_COLUMNS, one for each place in the arguments; the empty path is the arguments themselves.

    type, enum, const, required, properties, items, additionalProperties (false), minimum, maximum, and lengths of strings and
    arrays are checked, at any depth; other keywords are not.
    """
    rows = []

    def walk(name, path, s):
        kinds = s.get("type")
        kinds = [kinds] if isinstance(kinds, str) else kinds
        options = [s["const"]] if "const" in s else s.get("enum")
        options = options and [json.dumps(x) for x in options]
        props = s.get("properties", {})
        size = [s.get(f"{m}Length", s.get(f"{m}Items")) for m in ("min", "max")]
        bound = [None if s.get(f"{m}imum") is None else float(s[f"{m}imum"]) for m in ("min", "max")]
        rows.append((name, path, kinds, options, sorted(s.get("required", [])), sorted(props), s.get("additionalProperties") is False, *bound, *size))
        for key, below in sorted(props.items()):
            walk(name, [*path, "/" + key], below)
        if isinstance(s.get("items"), dict):
            walk(name, [*path, ITEMS], s["items"])

    for name, schema in sorted(tools.items()):
        walk(name, [], {"type": "object", **schema})
    table = spark.createDataFrame(rows, SCHEMA_COLUMNS.replace("options array<string>", "raw array<string>"))
    return table.withColumn("options", F.transform("raw", lambda x: canonical(x))).select(*[c.split()[0] for c in SCHEMA_COLUMNS.split(", ")])


def _some(condition: Column, array: Column) -> Column:
    return F.when(condition, array).otherwise(F.array())


def declared(messages: DataFrame) -> DataFrame:
    """Schemas that conversations declare themselves: SCHEMA_COLUMNS with conv_id before them, checked as those of ``schema_table``.

    A message whose text is a JSON object may carry ``tools``: objects with a name and a schema in ``parameters`` or
    ``input_schema``, or such an object in ``function``; without a schema any object fits.  Of declarations that repeat a name in a conversation the first
    counts, for all its calls.  A null conv_id declares nothing.  A round a level of the deepest schema.
    """
    like = F.col("conv_id").isNotNull() & F.ltrim("text").startswith("{") & (F.contains("text", F.lit("tools")) | F.contains("text", F.lit("\\u")))
    tools = F.try_variant_get(F.when(like, _variant(F.col("text"))), "$.tools", "array<variant>")
    one = messages.where(like).select("conv_id", F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), F.xxhash64("role", "text").alias("h"), F.posexplode(tools).alias("at", "t"))
    get = lambda *paths: F.coalesce(*[F.try_variant_get("t", f"$.{p}", "variant") for p in paths])
    name = F.coalesce(F.try_variant_get("t", "$.name", "string"), F.try_variant_get("t", "$.function.name", "string"))
    schema = get("parameters", "input_schema", "function.parameters", "function.input_schema")
    one = one.select("conv_id", "turn", "h", "at", name.alias("name"), F.when(_kind(schema) == "object", F.to_json(schema)).otherwise("{}").alias("schema")).where("name is not null")
    here = one.groupBy("conv_id", "name").agg(F.min(F.struct("turn", "h", "at", "schema"))["schema"].alias("schema")).select("conv_id", "name", F.expr("cast(array() as array<string>)").alias("path"), "schema")
    table = None
    while True:
        here = common.staged(here, "tool-schemas")
        if table is not None and here.isEmpty():
            return table
        s = here.withColumn("s", F.parse_json("schema"))
        rules = s.select("conv_id", "name", "path", *_rules())
        table = rules if table is None else table.unionByName(rules)
        items = F.try_variant_get("s", "$.items", "variant")
        below = F.concat(
            F.coalesce(F.transform(_entries(F.try_variant_get("s", "$.properties", "variant")), lambda e: F.struct(F.concat(F.lit("/"), e["key"]).alias("step"), F.when(_kind(e["value"]) == "object", F.to_json(e["value"])).otherwise("{}").alias("schema"))), F.array()),
            _some(_kind(items) == "object", F.array(F.struct(F.lit(ITEMS).alias("step"), F.to_json(items).alias("schema")))),
        )
        here = s.select("conv_id", "name", "path", F.explode(below).alias("b")).select("conv_id", "name", F.concat("path", F.array("b.step")).alias("path"), "b.schema")


def _rules() -> list[Column]:
    """The rest of SCHEMA_COLUMNS from a schema ``s``, a variant with marked numbers."""
    get = lambda key, kind="variant": F.try_variant_get("s", f"$.{key}", kind)
    has = lambda key: F.array_contains(F.transform(_entries(F.col("s")), lambda e: e["key"]), key)
    text = lambda v: F.coalesce(_json(v), F.lit("null"))
    number = lambda key: F.when(_kind(get(key)).isin("integer", "number"), F.substring(get(key, "string"), F.lit(2), F.length(get(key, "string"))).try_cast("double"))
    types = F.when(_kind(get("type")) == "string", F.array(get("type", "string"))).when(_kind(get("type")) == "array", get("type", "array<string>"))
    return [
        F.coalesce(types, F.when(F.size("path") == 0, F.array(F.lit("object")))).alias("types"),
        F.when(has("const"), F.array(text(get("const")))).when(_kind(get("enum")) == "array", F.transform(get("enum", "array<variant>"), text)).alias("options"),
        F.coalesce(F.when(_kind(get("required")) == "array", get("required", "array<string>")), F.expr("cast(array() as array<string>)")).alias("required"),
        F.coalesce(F.transform(_entries(get("properties")), lambda e: e["key"]), F.expr("cast(array() as array<string>)")).alias("keys"),
        F.coalesce((_kind(get("additionalProperties")) == "boolean") & ~get("additionalProperties", "boolean"), F.lit(False)).alias("closed"),
        *[number(f"{m}imum").alias(c) for m, c in (("min", "least"), ("max", "most"))],
        *[F.coalesce(number(f"{m}Length"), number(f"{m}Items")).cast("int").alias(c) for m, c in (("min", "least_size"), ("max", "most_size"))],
    ]


def _number(token: Column) -> Column:
    """A JSON number in its canonical form: 1, 1.0 and 1e0 are alike, and no digit is lost."""
    part = lambda k: F.regexp_extract(token, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", k)
    whole, fraction = part(2), part(3)
    power = F.when(part(4) == "", 0).otherwise(part(4).try_cast("int"))
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    # value = 0.short * 10^point
    point = power + F.length(whole) - (F.length(F.concat(whole, fraction)) - F.length(digits))
    zeros = lambda n: F.repeat(F.lit("0"), n)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), short))
        .when(point >= F.length(short), F.concat(short, zeros(point - F.length(short))))
        .otherwise(F.concat(F.substring(short, F.lit(1), point), F.lit("."), F.substring(short, point + 1, F.length(short))))
    )
    tail = F.substring(short, F.lit(2), F.length(short))
    exponent = F.concat(F.substring(short, 1, 1), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.lit("e"), (point - 1).cast("string"))
    form = F.when(F.greatest(point, F.length(short) - point, F.length(short)) <= PLAIN_DIGITS, plain).otherwise(exponent)
    # an exponent beyond 32 bits is left as it is
    return F.when(power.isNull(), token).when(short == "", "0").otherwise(F.concat(part(1), form))


def _variant(text: Column) -> Column:
    """A text's JSON as a variant with marked numbers, or null: not JSON, or an object with a key twice."""
    valid = F.try_parse_json(text).isNotNull()
    marked = F.transform(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        lambda t: F.when(t.rlike("^-?[0-9]"), F.concat(F.lit('"' + MARK_JSON), _number(t), F.lit('"'))).when(t.startswith('"' + MARK_JSON), F.concat(F.lit('"' + MARK_JSON + MARK_JSON), F.substring(t, F.lit(8), F.length(t)))).otherwise(t),
    )
    return F.when(valid, F.try_parse_json(F.array_join(marked, "")))


def _json(v: Column) -> Column:
    """Canonical JSON of a variant with marked numbers; variants keep their keys sorted."""
    return _unmarked(F.to_json(v))


def _unmarked(text: Column) -> Column:
    """JSON without marks: they are taken off whole strings only, as they were put on."""
    strings = F.transform(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        lambda t: F.when(t.startswith('"' + MARK_JSON + MARK_JSON), F.concat(F.lit('"'), F.substring(t, F.lit(8), F.length(t)))).when(t.startswith('"' + MARK_JSON), F.substring(t, F.lit(8), F.length(t) - 8)).otherwise(t),
    )
    return F.array_join(strings, "")


def canonical(text: Column) -> Column:
    """A JSON text in canonical form; null if it isn't JSON."""
    return _json(_variant(text))


def _kind(v: Column) -> Column:
    """The JSON schema type of a variant with marked numbers."""
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    text = F.try_variant_get(v, "$", "string")
    number = F.when(text.rlike(f"^{MARK}-?[0-9]+$"), "integer").otherwise("number")
    return F.when(kind == "STRING", F.when(text.rlike(f"^{MARK}[-0-9]"), number).otherwise("string")).when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").when(kind == "BOOLEAN", "boolean").otherwise("null")


def _entries(v: Column) -> Column:
    """array<struct<key,value>> of an object; null for anything else."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _quoted(key: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(key.alias("k")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _object(fields: Column) -> Column:
    """JSON of an object from array<struct<key,json>>."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(fields), lambda f: F.concat(_quoted(f["key"]), F.lit(":"), f["json"])), ","), F.lit("}"))


def _fields(v: Column, without: list[str]) -> Column:
    """array<struct<key,json>> of an object's entries but some."""
    return F.transform(F.filter(_entries(v), lambda e: ~e["key"].isin(without)), lambda e: F.struct(e["key"].alias("key"), F.coalesce(_json(e["value"]), F.lit("null")).alias("json")))


def _field(key: str, text: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), text.alias("json"))


def _order(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, h, sort_turn, sort_rank) of results from (conv_id, turn, h, parent), their calls' messages (turn, h).

    A result that isn't later than what its call's message is sorted by comes a rank behind it.  Pointers along chains double each
    round, so rounds grow with the logarithm of the longest.  A cycle is cut before its first message.
    """
    spark = parents.sparkSession
    while True:
        links = common.staged(parents, "tool-parents")
        inner = links.select("conv_id", F.struct("turn", "h").alias("parent"), F.lit(True).alias("chained"))
        # of the chain so far: its greatest turn, the farthest step that has it, its length, its first message and the next
        at = links.join(inner, ["conv_id", "parent"], "left").select(
            "conv_id", "turn", "h", "parent",
            F.when(F.col("chained") | (F.col("turn") > F.col("parent.turn")), F.col("turn")).otherwise(F.col("parent.turn")).alias("top"),
            F.when(F.col("chained") | (F.col("turn") > F.col("parent.turn")), 0).otherwise(1).cast("long").alias("step"),
            F.lit(1).cast("long").alias("length"), F.struct("turn", "h").alias("least"), F.when(F.col("chained"), F.col("parent")).alias("up"),
        )
        at = common.staged(at, "tool-chains")
        waiting, length = at.where("up is not null").count(), 1
        most = waiting
        while waiting and length <= 2 * most + 2:
            far = at.select("conv_id", F.struct("turn", "h").alias("up"), F.col("top").alias("top_2"), F.col("step").alias("step_2"), F.col("length").alias("length_2"), F.col("least").alias("least_2"), F.col("up").alias("up_2"))
            beyond = F.col("top_2") >= F.col("top")
            at = at.join(far, ["conv_id", "up"], "left").select(
                "conv_id", "turn", "h", "parent",
                F.when(beyond, F.col("top_2")).otherwise(F.col("top")).alias("top"), F.when(beyond, F.col("length") + F.col("step_2")).otherwise(F.col("step")).alias("step"),
                (F.col("length") + F.coalesce("length_2", F.lit(0))).alias("length"), F.least("least", "least_2").alias("least"), F.col("up_2").alias("up"),
            )
            at = common.staged(at, "tool-chains")
            waiting, length = at.where("up is not null").count(), 2 * length
        if not waiting:
            return at.select(*MESSAGE, F.col("top").alias("sort_turn"), F.col("step").cast("int").alias("sort_rank"))
        # what is still followed is on a cycle; a pointer that has gone round covers all of it
        around = at.where("up is not null").select("conv_id", F.col("up.turn").alias("turn"), F.col("up.h").alias("h")).distinct()
        first = at.join(around, MESSAGE, "left_semi").where((F.col("least.turn") == F.col("turn")) & (F.col("least.h") == F.col("h"))).select(*MESSAGE)
        parents = links.join(first, MESSAGE, "left_anti")


def _invalid(call: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, turn, h, at) of calls of an unknown tool, or whose arguments don't fit its schema."""
    call_key = [*MESSAGE, "at"]
    tool = [c for c in ("conv_id", "name") if c in tools.columns]
    known = tools.select(*tool).distinct()
    out = call.join(known, tool, "left_anti").select(*call_key)
    levels = tools.agg(F.max(F.size("path"))).first()[0]
    here = call.join(known, tool, "left_semi").select(*call_key, "name", F.expr("cast(array() as array<string>)").alias("path"), F.col("args").alias("value"))
    for level in range((-1 if levels is None else levels) + 1):
        rules = tools.where(F.size("path") == level)
        met = here.join(rules, [*tool, "path"])
        kind, keys = _kind(F.col("value")), F.transform(_entries(F.col("value")), lambda e: e["key"])
        text = F.try_variant_get("value", "$", "string")
        number = F.substring(text, F.lit(2), F.length(text)).try_cast("double")
        size = F.when(kind == "array", F.size(F.try_variant_get("value", "$", "array<variant>"))).when(kind == "string", F.length(text))
        bad = [
            F.col("value").isNull(),
            F.col("types").isNotNull() & ~F.array_contains("types", kind) & ~((kind == "integer") & F.array_contains("types", "number")),
            F.col("options").isNotNull() & ~F.array_contains("options", _json(F.col("value"))),
            (kind == "object") & (F.size(F.array_except("required", keys)) > 0),
            (kind == "object") & F.col("closed") & (F.size(F.array_except(keys, "keys")) > 0),
            kind.isin("integer", "number") & ((number < F.col("least")) | (number > F.col("most"))),
            (size < F.col("least_size")) | (size > F.col("most_size")),
        ]
        fails = F.lit(False)
        for b in bad:
            fails = fails | F.coalesce(b, F.lit(False))
        out = out.unionByName(met.where(fails).select(*call_key))
        # the values one level down, only those that some schema has a place for
        below = F.concat(
            F.coalesce(F.transform(_entries(F.col("value")), lambda e: F.struct(F.concat(F.lit("/"), e["key"]).alias("step"), e["value"].alias("value"))), F.array()),
            F.coalesce(F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda x: F.struct(F.lit(ITEMS).alias("step"), x.alias("value"))), F.array()),
        )
        here = met.select(*call_key, "name", "path", F.explode(below).alias("b")).select(*call_key, "name", F.concat("path", F.array("b.step")).alias("path"), "b.value")
    return out.distinct()


def link(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row (OUT) for each row of ``messages`` (conv_id, turn, role, text; other columns are not read).

    ``tools`` has SCHEMA_COLUMNS, and conv_id where a schema holds for one conversation only.  sort_turn, sort_rank and turn order a conversation topologically: a result that stands before its
    call moves behind it, and what answers a call in that result behind it in turn; a cycle of messages that answer each other is
    cut before the first of them.  ``link`` is 'call' for messages with calls, for results 'linked' or 'orphan', else null.  n_calls counts
    a message's calls, n_answered those with a result, n_invalid those whose tool is unknown, whose arguments aren't an
    object or don't fit the schema.  Of calls that repeat an identifier in a conversation the first is linked; several results of a
    call are all linked.  Linked messages keep all their keys and any kind of content; arguments sent as a string of JSON become JSON.
    A call's name and arguments may stand in an object ``function``, where they stay.  A null text counts as empty, a null role is written as null, null conv_id or identifiers link nothing, a null turn comes first, and
    repeated rows are all returned alike.
    """
    json_like = F.ltrim("text").startswith("{") & (F.contains("text", F.lit("tool_call")) | F.contains("text", F.lit("\\u")))
    v = F.when(json_like, _variant(F.col("text")))
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), v.alias("v"))
    called = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    answers = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    base = base.withColumns({"calls": called, "answers": answers})
    special = (F.coalesce(F.size("calls"), F.lit(-1)) > 0) | F.col("answers").isNotNull()
    zero = F.lit(0).cast("long")
    plain = base.where(~special).select(
        "conv_id", "turn", "role", F.col("turn").alias("sort_turn"), F.lit(0).alias("sort_rank"), zero.alias("n_calls"), zero.alias("n_answered"), zero.alias("n_invalid"),
        F.lit(None).cast("string").alias("link"), F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("message_json"),
    )
    some = base.where(special).withColumns({"h": F.xxhash64("role", "text"), "real_turn": F.col("turn"), "turn": F.coalesce("turn", F.lit(-(1 << 63)))})
    some = common.staged(some.select("conv_id", "turn", "real_turn", "role", "h", "answers", F.to_json("v").alias("vj"), F.transform("calls", lambda c: F.to_json(c)).alias("cj")), "tool-messages")
    some = some.withColumn("v", F.parse_json("vj"))
    rows = some.dropDuplicates(MESSAGE)
    call = rows.select(*MESSAGE, F.posexplode("cj").alias("at", "c")).withColumn("c", F.parse_json("c"))

    def arguments(at):
        args, text = F.try_variant_get("c", at, "variant"), F.try_variant_get("c", at, "string")  # many systems send arguments as a string of JSON
        return F.when(_kind(args) == "string", F.coalesce(_variant(text), args)).otherwise(args)

    name = F.coalesce(F.try_variant_get("c", "$.name", "string"), F.try_variant_get("c", "$.function.name", "string"))
    call = call.select(*MESSAGE, "at", "c", F.try_variant_get("c", "$.id", "string").alias("id"), name.alias("name"), arguments("$.arguments").alias("own_args"), F.coalesce(arguments("$.arguments"), arguments("$.function.arguments")).alias("args"))
    result = rows.where("answers is not null").select(*MESSAGE, F.col("answers").alias("id"))
    first = call.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "h", "at")).alias("first"))
    linked = common.staged(result.join(first, ["conv_id", "id"], "left").select(*MESSAGE, "first"), "tool-links")
    answered = linked.where("first is not null").select("conv_id", "first.turn", "first.h", "first.at").distinct().withColumn("answered", F.lit(1))
    parents = linked.where("first is not null").select(*MESSAGE, F.struct("first.turn", "first.h").alias("parent"))
    order = _order(parents.where((F.col("parent.turn") != F.col("turn")) | (F.col("parent.h") != F.col("h"))))
    invalid = _invalid(call, tools).withColumn("invalid", F.lit(1))
    renamed = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns})
    same = lambda p: F.col("conv_id").eqNullSafe(F.col(f"{p}_conv_id")) & (F.col("turn") == F.col(f"{p}_turn")) & (F.col("h") == F.col(f"{p}_h"))
    own = F.when(_kind(F.col("c")) == "object", _object(F.concat(_fields(F.col("c"), ["arguments"]), F.when(F.col("own_args").isNull(), F.array().cast("array<struct<key:string,json:string>>")).otherwise(F.array(_field("arguments", _json(F.col("own_args")))))))).otherwise(_json(F.col("c")))
    per_call = call.join(renamed(invalid, "i"), same("i") & (F.col("at") == F.col("i_at")), "left").select(*call.columns, F.col("i_invalid").alias("invalid")).join(answered, [*MESSAGE, "at"], "left")
    per_message = per_call.groupBy(*MESSAGE).agg(
        F.count("*").alias("n_calls"), F.count("answered").alias("n_answered"), F.count("invalid").alias("n_invalid"),
        F.sort_array(F.collect_list(F.struct("at", own.alias("j")))).alias("js"),  # the calls of one message
    )
    tooly = some.join(renamed(per_message, "m"), same("m"), "left").join(renamed(linked, "r"), same("r"), "left").join(renamed(order, "o"), same("o"), "left")
    calls_json = F.concat(F.lit("["), F.array_join(F.transform("m_js", lambda x: x["j"]), ","), F.lit("]"))
    content = F.coalesce(_json(F.try_variant_get("v", "$.content", "variant")), F.lit('""'))
    nothing = F.array().cast("array<struct<key:string,json:string>>")
    whole = F.concat(
        _fields(F.col("v"), ["content", "role", "tool_calls"]),
        F.array(_field("content", content), _field("role", F.coalesce(_quoted(F.col("role")), F.lit("null")))),
        F.when(F.col("m_js").isNull(), nothing).otherwise(F.array(_field("tool_calls", calls_json))),
    )
    tooly = tooly.select(
        "conv_id", F.col("real_turn").alias("turn"), "role",
        F.when(F.col("o_sort_turn") > F.col("turn"), F.col("o_sort_turn")).otherwise(F.col("real_turn")).alias("sort_turn"),
        F.coalesce("o_sort_rank", F.lit(0)).alias("sort_rank"),
        *[F.coalesce(F.col(f"m_{c}"), zero).cast("long").alias(c) for c in ("n_calls", "n_answered", "n_invalid")],
        F.when(F.col("answers").isNotNull(), F.when(F.col("r_first").isNotNull(), "linked").otherwise("orphan")).otherwise("call").alias("link"),
        _object(whole).alias("message_json"),
    )
    return plain.unionByName(tooly)


def op5_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Every message of conversations as canonical JSON, with its tool calls linked and checked against the schemas that their conversation declares."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return link(messages, declared(messages))


# Holds for tables in which no message carries tool calls or results; tests cover those by hand-made conversations.
OP5_SQL = """
select conv_id, turn, role, turn as sort_turn, cast(0 as integer) as sort_rank, cast(0 as bigint) as n_calls, cast(0 as bigint) as n_answered,
       cast(0 as bigint) as n_invalid, cast(null as varchar) as link,
       cast(to_json(struct_pack(content := coalesce(text, ''), role := role)) as varchar) as message_json
from conversations"""
