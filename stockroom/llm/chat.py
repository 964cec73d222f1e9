"""Chat formatting with tool calls: link calls and results, order them, validate arguments, write canonical JSON. DataFrame functions only.

What a turn's text may hold, besides plain text:

- assistant: `{"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...}, "depends_on": [ids]}, ...]}`;
- tool: `{"tool_call_id": ..., "content": ...}`;
- system: `{"content": ..., "tools": [{"name": ..., "parameters": <JSON schema>}, ...]}`.

Nothing gathers a conversation: calls and results meet by a hash join on conversation and id, levels of dependent calls come from joins of calls alone,
arguments go down their schema one depth a round, and the output is one message a row with the key to order it by. A conversation of a third of all
turns is as parallel as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: order_level of calls that are in a cycle or depend on one: behind all others of their turn.
UNSETTLED = (1 << 31) - 1
# Names of a JSON schema's types.
TYPES = ("string", "integer", "number", "boolean", "object", "array", "null")
# Keywords of JSON schemas that are checked, in the order in which what breaks them is told, ...
CHECKED = ("required", "type", "enum", "const", "additionalProperties", "minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties")
# ... and those that are not, but bear on what is valid.
UNSUPPORTED = ("$ref", "$dynamicRef", "anyOf", "oneOf", "not", "if", "pattern", "patternProperties", "propertyNames", "prefixItems", "contains", "dependentRequired", "dependentSchemas", "unevaluatedItems", "unevaluatedProperties")
_FOUND = "array<struct<rank: int, kind: string, path: string>>"
_BELOW = "array<struct<path: string, s: string, v: string>>"


def _get(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and `body`: the text's JSON object as a variant, or null if it holds nothing of the above."""
    base = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parsed = base.withColumn("v", F.when(F.ltrim("text").startswith("{") & F.col("text").rlike('"(tool_calls|tool_call_id|tools)"'), F.try_parse_json("text")))
    call = (F.col("role") == "assistant") & _get("v", "$.tool_calls", "array<variant>").isNotNull()
    result = (F.col("role") == "tool") & _get("v", "$.tool_call_id", "string").isNotNull()
    tools = (F.col("role") == "system") & _get("v", "$.tools", "array<variant>").isNotNull()
    return parsed.select("conv_id", "turn", "role", "text", F.when(call | result | tools, F.col("v")).alias("body"))


def calls(parsed: DataFrame) -> DataFrame:
    """One row for each tool call: conv_id, turn, at (place in its turn), call_id, name, arguments (variant), depends_on."""
    found = parsed.where("role = 'assistant' and body is not null").select("conv_id", "turn", F.posexplode(_get("body", "$.tool_calls", "array<variant>")).alias("at", "call"))
    return found.select("conv_id", "turn", "at", _get("call", "$.id", "string").alias("call_id"), _get("call", "$.name", "string").alias("name"), _get("call", "$.arguments", "variant").alias("arguments"), F.coalesce(_get("call", "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"))


def levels(found: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 for calls that depend on none, else 1 more than the highest level they depend on; null in or behind a cycle.

    Ids that no call has are not waited for. Each round settles the calls whose needs are all settled; then a need that itself has one need only is
    replaced by that one, with the steps between added up, so a chain takes rounds by the logarithm of its length. The lowest call that is not in or
    behind a cycle is settled in every round, so a round that settles none leaves cycles alone. Steps stay within the number of calls, as
    those of any path without a cycle do. Tables without dependencies need no round.
    """
    nodes = found.where("call_id is not null").select("conv_id", "call_id").distinct()
    needs = found.where("call_id is not null").select("conv_id", "call_id", F.explode("depends_on").alias("need")).distinct()
    needs = scratch.save(needs.join(nodes.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi").withColumn("steps", F.lit(1)), "needs")
    now = scratch.save(nodes.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    most = nodes.count() if needs.limit(1).count() else 0
    while needs.limit(1).count():
        state = needs.join(now.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"], "left").groupBy("conv_id", "call_id")
        ready = state.agg(F.count("*").alias("all"), F.count("level").alias("known"), F.max(F.col("level") + F.col("steps")).alias("level")).where("all = known")
        ready = scratch.save(ready.select("conv_id", "call_id", "level"), "ready")
        if not ready.limit(1).count():
            break
        now = scratch.save(now.unionByName(ready), "levels")
        left = needs.join(ready, ["conv_id", "call_id"], "left_anti")
        only = left.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("need").alias("to"), F.min("steps").alias("more")).where("n = 1").select("conv_id", F.col("call_id").alias("need"), "to", "more")
        jump = F.col("more").isNotNull() & (F.col("steps").cast("long") + F.col("more") <= most)
        after = left.join(only, ["conv_id", "need"], "left").select("conv_id", "call_id", F.when(jump, F.col("to")).otherwise(F.col("need")).alias("need"), F.when(jump, F.col("steps") + F.col("more")).otherwise(F.col("steps")).alias("steps"))
        needs = scratch.save(after.groupBy("conv_id", "call_id", "need").agg(F.max("steps").alias("steps")), "needs")
    return nodes.join(now, ["conv_id", "call_id"], "left")


def _number(v: Column) -> tuple[Column, Column]:
    """A number as a double, and as a whole number for telling apart those whose doubles are equal."""
    return F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "decimal(38,0)")


def _less(a: Column, b: Column) -> Column:
    (x, i), (y, j) = _number(a), _number(b)
    return F.coalesce((x < y) | ((x == y) & (F.abs(x) >= float(1 << 53)) & (i < j)), F.lit(False))


def _is_number(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")


def _equal(a: Column, b: Column) -> Column:
    return (F.to_json(a) == F.to_json(b)) | (_is_number(a) & _is_number(b) & ~_less(a, b) & ~_less(b, a))


def _one_level(todo: DataFrame) -> DataFrame:
    """call, found, below: of values (v) and schemas (s), both JSON, what breaks the schema right here, and the pairs one step further in."""
    t = todo.select("call", "path", F.parse_json("s").alias("s"), F.parse_json("v").alias("v"), F.col("v").alias("as_json"))
    s, v, path = F.col("s"), F.col("v"), F.col("path")
    maps = lambda c: F.try_variant_get(c, "$", "map<string,variant>")
    t = t.select("*", maps(s).alias("sm"), maps(v).alias("vm"), F.try_variant_get(v, "$", "array<variant>").alias("va"), F.schema_of_variant(v).alias("kind"), _get("s", "$.properties", "map<string,variant>").alias("props"), _get("s", "$.additionalProperties", "variant").alias("more"))
    kind, sm, vm, va, props, more = (F.col(c) for c in ("kind", "sm", "vm", "va", "props", "more"))
    is_object, is_array, is_string = kind.startswith("OBJECT"), kind.startswith("ARRAY"), kind == "STRING"
    whole = (kind == "BIGINT") | (kind.startswith("DECIMAL") & F.col("as_json").rlike(r"^-?\d+(\.0*)?$")) | (kind.isin("DOUBLE", "FLOAT") & (F.rint(_number(v)[0]) == _number(v)[0]))
    of_type = dict(zip(TYPES, (is_string, whole, _is_number(v), kind == "BOOLEAN", is_object, is_array, kind == "VOID"), strict=True))
    types = F.coalesce(_get("s", "$.type", "array<string>"), F.when(F.schema_of_variant(sm["type"]) == "STRING", F.array(_get("s", "$.type", "string"))))
    fits = F.lit(False)
    for name in TYPES:
        fits = fits | (F.array_contains(types, name) & of_type[name])
    at = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
    keys = F.when(is_object, F.map_keys(vm)).otherwise(F.array().cast("array<string>"))
    named = F.coalesce(F.map_keys(props), F.array().cast("array<string>"))
    here = F.when(path == "", F.lit("$")).otherwise(path)
    given = lambda name: F.coalesce(F.map_contains_key(sm, name), F.lit(False))
    size = lambda name: F.coalesce(_get("s", f"$.{name}", "long"), F.lit(None).cast("long"))
    number = _is_number(v)
    step, x = _get("s", "$.multipleOf", "decimal(38,12)"), _get("v", "$", "decimal(38,12)")
    odd = F.array_except(F.coalesce(types, F.array().cast("array<string>")), F.array(*map(F.lit, TYPES)))
    broken = {
        "type": types.isNotNull() & ~fits & (F.size(odd) == 0),
        "enum": _get("s", "$.enum", "array<variant>").isNotNull() & ~F.exists(_get("s", "$.enum", "array<variant>"), lambda e: _equal(e, v)),
        "const": given("const") & ~_equal(sm["const"], v),
        "minimum": number & _less(v, sm["minimum"]), "exclusiveMinimum": number & _is_number(sm["exclusiveMinimum"]) & ~_less(sm["exclusiveMinimum"], v),
        "maximum": number & _less(sm["maximum"], v), "exclusiveMaximum": number & _is_number(sm["exclusiveMaximum"]) & ~_less(v, sm["exclusiveMaximum"]),
        "multipleOf": number & (step > 0) & (F.try_mod(x, step) != 0),
        "minLength": is_string & (F.length(_get("v", "$", "string")) < size("minLength")), "maxLength": is_string & (F.length(_get("v", "$", "string")) > size("maxLength")),
        "minItems": is_array & (F.size(va) < size("minItems")), "maxItems": is_array & (F.size(va) > size("maxItems")),
        "uniqueItems": is_array & _get("s", "$.uniqueItems", "boolean") & (F.size(F.array_distinct(F.transform(va, lambda e: F.to_json(e)))) < F.size(va)),
        "minProperties": is_object & (F.size(vm) < size("minProperties")), "maxProperties": is_object & (F.size(vm) > size("maxProperties")),
    }
    one = lambda kind_, where: F.struct(F.lit(CHECKED.index(kind_) if kind_ in CHECKED else len(CHECKED)).alias("rank"), F.lit("missing" if kind_ == "required" else kind_).alias("kind"), where.alias("path"))
    none = F.array().cast(_FOUND)
    found = [F.when(F.coalesce(c, F.lit(False)), F.array(one(k, here))).otherwise(none) for k, c in broken.items()]
    absent = F.filter(F.coalesce(_get("s", "$.required", "array<string>"), F.array().cast("array<string>")), lambda n: is_object & ~F.array_contains(keys, n))
    found.append(F.transform(absent, lambda n: one("required", at(n))))
    rest = F.array_except(keys, named)
    closed = F.coalesce(F.try_variant_get(more, "$", "boolean") == F.lit(False), F.lit(False)) & (F.schema_of_variant(more) == "BOOLEAN")
    found.append(F.when(closed, F.transform(rest, lambda k: one("additionalProperties", at(k)))).otherwise(none))
    found.append(F.when((F.schema_of_variant(s) == "BOOLEAN") & (F.try_variant_get(s, "$", "boolean") == F.lit(False)), F.array(one("type", here))).otherwise(none))
    strange = F.array_intersect(F.coalesce(F.map_keys(sm), F.array().cast("array<string>")), F.array(*map(F.lit, UNSUPPORTED)))
    strange = F.concat(strange, F.when(F.size(odd) > 0, F.array(F.lit("type"))).otherwise(F.array().cast("array<string>")))
    found.append(F.transform(strange, lambda k: F.struct(F.lit(len(CHECKED)).alias("rank"), F.lit("unsupported").alias("kind"), F.concat(here, F.lit(": "), k).alias("path"))))

    nothing = F.array().cast(_BELOW)
    pair = lambda p, a, b: F.struct(p.alias("path"), F.to_json(a).alias("s"), F.to_json(b).alias("v"))
    items, every = _get("s", "$.items", "variant"), _get("s", "$.allOf", "array<variant>")
    below = [
        F.transform(F.array_intersect(keys, named), lambda k: pair(at(k), props[k], vm[k])),
        F.when(more.isNotNull() & ~closed, F.transform(rest, lambda k: pair(at(k), more, vm[k]))).otherwise(nothing),
        F.when(is_array & items.isNotNull() & ~F.schema_of_variant(items).startswith("ARRAY"), F.transform(va, lambda e, i: pair(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), items, e))).otherwise(nothing),
        F.when(every.isNotNull(), F.transform(every, lambda e: pair(path, e, v))).otherwise(nothing),
    ]
    all_of = lambda parts, kind_: F.concat(*(F.coalesce(p.cast(kind_), F.array().cast(kind_)) for p in parts))
    return t.select("call", all_of(found, _FOUND).alias("found"), all_of(below, _BELOW).alias("below"))


def validity(found: DataFrame, parsed: DataFrame, n: int) -> DataFrame:
    """`found` (`n` calls, each with its number in `call`), with problem and valid: arguments against the JSON schema that the conversation's system turns give
    for the tool's name.

    problem, the first of: `no id`, `no schema`, `not an object`, `missing: places`, then `keyword: places` of the schema keywords broken, in the order of
    CHECKED; null if none. A place is as `a.b[0].c`, `$` for the arguments as a whole. valid: whether there is no problem. Where a schema has keywords of
    UNSUPPORTED, or types of unknown names, and nothing else is wrong, problem is `unsupported: place: keyword` and valid is null. Formats and other remarks
    are not checked. If a tool is declared twice, the declaration of the smallest (turn, place, text) holds; one without parameters allows all objects.

    One round a depth of the arguments, for all calls at once.
    """
    tools = parsed.where("role = 'system' and body is not null").select("conv_id", "turn", F.posexplode(_get("body", "$.tools", "array<variant>")).alias("at", "tool"))
    tools = tools.select("conv_id", _get("tool", "$.name", "string").alias("name"), F.struct("turn", "at", F.to_json(_get("tool", "$.parameters", "variant")).alias("schema")).alias("t"))
    schemas = tools.where("name is not null").groupBy("conv_id", "name").agg(F.min("t").alias("t")).select("conv_id", "name", F.coalesce("t.schema", F.lit("{}")).alias("schema"))
    schemas = schemas.join(found.groupBy("conv_id", "name").agg(F.count("*").alias("n_calls")), ["conv_id", "name"])
    joined = scratch.save(scratch.split_join(found, schemas, ["conv_id", "name"], "n_calls", n, "left").drop("n_calls").withColumn("is_object", F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))), "with-schemas")
    todo = joined.where("call_id is not null and schema is not null and is_object").select("call", F.lit("").alias("path"), F.col("schema").alias("s"), F.col("arguments").alias("v"))
    broken = None
    while not todo.isEmpty():
        level = scratch.save(_one_level(todo), "level")
        here = level.select("call", F.explode("found").alias("f")).distinct()
        broken = here if broken is None else broken.unionByName(here)
        todo = level.select("call", F.explode("below").alias("b")).select("call", "b.*")
    known = F.when(F.col("call_id").isNull(), "no id").when(F.col("schema").isNull(), "no schema").when(~F.col("is_object"), "not an object")
    if broken is None:
        return joined.select(*found.columns, known.alias("problem"), known.isNull().alias("valid"))
    kinds = broken.groupBy("call", "f.rank", "f.kind").agg(F.array_sort(F.collect_set("f.path")).alias("paths"))
    first = kinds.groupBy("call").agg(F.min(F.struct("rank", F.concat("kind", F.lit(": "), F.array_join("paths", ", ")).alias("text"))).alias("first"))
    problem = F.coalesce(known, F.col("first.text"))
    unknown = known.isNull() & (F.col("first.rank") == len(CHECKED))
    return joined.join(first, "call", "left").select(*found.columns, problem.alias("problem"), F.when(F.coalesce(unknown, F.lit(False)), F.lit(None)).otherwise(problem.isNull()).alias("valid"))


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row for each message of `conversations` (conv_id, turn, role, text): a turn, or one of the tool calls of a turn.

    conv_id; kind (`message`, `call`, `result`); order_turn, order_level, order_at, order_kind (0 call or message, 1 result), turn: the order within the
    conversation; a result stands behind its call, a call behind those it depends on; call_id; status (`linked`, `unanswered` for calls, `orphan` for
    results without a call, `cycle` for calls that wait for each other, null for messages); valid and problem (see validity(); null for others);
    json: canonical, with keys in order at every depth, no white space outside strings, and nulls left out of the envelope.

    A call id used twice in a conversation: results link to the first call by (turn, place). Several results of one call all link to it. A null role
    is written as "unknown", a null text as "". Rows with a null conv_id form no links. Repeated rows, and rows that repeat conv_id and turn with another
    text, each give their own messages, with their own calls' validity. Text that isn't valid JSON, or whose role doesn't fit what it holds, is a plain
    message. An empty table gives no rows. Other columns are not looked at.
    """
    parsed = turns(conversations)
    structured = scratch.save(parsed.where("body is not null").withColumn("body", F.to_json("body")), "structured").withColumn("body", F.parse_json("body"))
    found = scratch.save(calls(structured).withColumn("arguments", F.to_json("arguments")).withColumn("call", F.monotonically_increasing_id()), "calls")
    n = found.count()
    results = scratch.save(structured.where("role = 'tool'").select("conv_id", "turn", _get("body", "$.tool_call_id", "string").alias("call_id"), F.to_json(_get("body", "$.content", "variant")).alias("content")), "results")
    key = ["conv_id", "call_id"]
    answered = results.groupBy(*key).agg(F.count("*").alias("n_results"))
    info = found.where("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "at")).alias("c"), F.count("*").alias("n_calls"))
    info = scratch.save(info.join(levels(found), key, "left").join(answered, key, "left"), "links")

    checked = validity(found, structured, n)
    c = scratch.split_join(checked, info, key, "n_calls", n, "left").withColumn("arguments", F.try_parse_json("arguments"))
    linked = (F.col("n_results") > 0) & (F.col("c.turn") == F.col("turn")) & (F.col("c.at") == F.col("at"))
    cycle = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("level").isNull()
    order = [F.col("turn").alias("order_turn"), F.coalesce("level", F.lit(UNSETTLED)).alias("order_level"), F.col("at").alias("order_at"), F.lit(0).alias("order_kind"), "turn"]
    as_json = lambda **parts: F.to_json(F.struct(*(v.alias(k) for k, v in sorted(parts.items()))))
    call_rows = c.select("conv_id", F.lit("call").alias("kind"), *order, "call_id", F.when(cycle, "cycle").when(F.coalesce(linked, F.lit(False)), "linked").otherwise("unanswered").alias("status"), "valid", "problem", as_json(role=F.lit("assistant"), tool_call=F.struct(F.col("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"))).alias("json"))

    r = scratch.split_join(results, info, key, "n_results", results.count(), "left").withColumn("content", F.try_parse_json("content"))
    order = [F.coalesce("c.turn", "turn").alias("order_turn"), F.when(F.col("c").isNull(), 0).otherwise(F.coalesce("level", F.lit(UNSETTLED))).alias("order_level"), F.coalesce("c.at", F.lit(0)).alias("order_at"), F.lit(1).alias("order_kind"), "turn"]
    empty = [F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("problem")]
    result_rows = r.select("conv_id", F.lit("result").alias("kind"), *order, "call_id", F.when(F.col("c").isNull(), "orphan").otherwise("linked").alias("status"), *empty, as_json(content=F.col("content"), role=F.lit("tool"), tool_call_id=F.col("call_id")).alias("json"))

    content = F.when(F.col("body").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.coalesce(_get("body", "$.content", "string"), F.lit("")))
    plain = parsed.where("body is null or role in ('assistant', 'system')")
    order = [F.col("turn").alias("order_turn"), F.lit(-1).alias("order_level"), F.lit(0).alias("order_at"), F.lit(0).alias("order_kind"), "turn"]
    messages = plain.select("conv_id", F.lit("message").alias("kind"), *order, F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("status"), *empty, as_json(content=content, role=F.coalesce("role", F.lit("unknown"))).alias("json"))
    return messages.unionByName(call_rows).unionByName(result_rows)
