"""Tool calls and results of conversations: linked, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import shared

#: tool -> argument -> (type, required)
SCHEMAS = {"reply": {"chars": ("integer", True), "turn": ("integer", True)}}
TYPES = {"integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
#: More than any level.
FAR = 1 << 40
CONTROLS = [c for c in map(chr, range(32)) if c not in "\b\t\n\f\r"]


def json_string(c: Column) -> Column:
    """A JSON string with the shortest escapes, lower-case hex; null is null."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(a), F.lit(b))
    marks = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(f"\\u{ord(x):04x}").alias("b")) for x in CONTROLS])
    others = F.aggregate(marks, c, lambda a, m: F.replace(a, m["a"], m["b"]))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), others).otherwise(c), F.lit('"'))


def canonical(arguments: Column) -> Column:
    """JSON text with sorted keys (by UTF-8), no white space and plain numbers; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(arguments))


def violations(tool: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """What the arguments break of the tool's schema, as a sorted array of ``reason:name``."""
    v = F.try_parse_json(arguments)
    wrong: list[Column] = [F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.lit("not_an_object"))]
    wrong.append(F.when(~F.coalesce(tool.isin(*schemas), F.lit(False)), F.lit("unknown_tool")))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    extra = F.array().cast("array<string>")
    for name, schema in schemas.items():
        for arg, (kind, required) in schema.items():
            found = F.schema_of_variant(F.try_variant_get(v, f"$['{arg}']", "variant"))
            fits = F.lit(False)
            for t in TYPES[kind]:
                fits = fits | found.startswith(t)
            bad = F.when(found.isNull() | (found == "VOID"), F.lit(f"missing:{arg}") if required else F.lit(None)).when(~fits, F.lit(f"type:{arg}"))
            wrong.append(F.when(tool == name, bad))
        known = F.array(*map(F.lit, schema)) if schema else F.array().cast("array<string>")
        extra = F.when(tool == name, F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))).otherwise(extra)
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*wrong)), extra)))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls with ``after`` (ids whose results they use): one more than the highest of those.

    Open calls are edges with a weight and a floor under the call's level. A round raises the floors by the levels known
    since the last one; a call without open edges has its level. An edge to a call of one open edge skips it (the weights
    add up, its floor carries over), so a chain halves each round and edges never get more. Only a run of calls that all
    need two or more open calls takes as many rounds as it is long. A call in or behind a circle gets no level (null).
    Unknown ids and the call's own id in ``after`` are no dependencies.
    """
    own, at = ["conv_id", "call_id"], ["conv_id", "dep"]
    nodes = calls.select(*own).distinct()
    needs = calls.select(*own, F.explode("after").alias("dep")).where("call_id <> dep").distinct()
    needs = needs.join(nodes.withColumnRenamed("call_id", "dep"), at, "left_semi")
    edges = shared(needs.select(*own, "dep", F.lit(1).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("floor")))
    fresh = shared(nodes.join(edges, own, "left_anti").withColumn("level", F.lit(0).cast("bigint")))
    known = [fresh]
    while edges.limit(1).count():
        met = edges.join(fresh.select("conv_id", F.col("call_id").alias("dep"), "level"), at, "left")
        open_ = F.col("level").isNull()
        states = met.groupBy(*own).agg(F.greatest(F.max("floor"), F.coalesce(F.max(F.col("level") + F.col("w")), F.lit(0))).alias("floor"), F.count_if(open_).alias("open"), F.max(F.when(open_, F.struct("dep", "w"))).alias("edge"))
        states = shared(states)
        fresh = states.where("open = 0").select(*own, F.col("floor").alias("level"))
        if not fresh.limit(1).count():
            break
        known = [*known, fresh] if len(known) < 16 else [shared(reduce(DataFrame.unionByName, [*known, fresh]))]
        single = states.where("open = 1").select("conv_id", F.col("call_id").alias("dep"), F.col("edge.dep").alias("next"), F.col("edge.w").alias("more"), F.col("floor").alias("under"))
        left = met.where(open_).drop("level", "floor").join(states.select(*own, "floor"), own).join(shared(single), at, "left")
        far = lambda c: F.least(c, F.lit(FAR))  # noqa: E731  (a circle's weights double each round)
        left = left.select(*own, F.coalesce("next", "dep").alias("dep"), far(F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), far(F.greatest("floor", F.coalesce(F.col("under") + F.col("w"), F.lit(0)))).alias("floor"))
        edges = shared(left.groupBy(*own, "dep").agg(F.max("w").alias("w"), F.max("floor").alias("floor")))
    return nodes.join(reduce(DataFrame.unionByName, known), own, "left")


def link(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Each row of ``messages(conv_id, turn, role, text, kind, call_id, tool, arguments[, after])`` linked and written.

    ``kind`` is call, result or message. Adds ``status``: a call is answered, unanswered or cyclic; a result is linked or
    orphan. Adds ``level``, ``anchor_turn`` and ``phase``: ordered by these and turn, calls come after what they depend
    on and before their results, and all else stays in its place. Adds ``errors`` (the arguments' violations) and
    ``json``, canonical: sorted keys, no white space, shortest escapes.

    Calls and results meet by a hash join of (conv_id, call_id), each side summed to a row for each id first: repeated
    ids (however many) cost no pairs, and one conversation with a third of all rows is a hot key of no sort or window.

    A null id links nothing: orphan, unanswered. Null text is written as null; a null conversation or turn keeps its
    row, unlinked. Repeated rows stay, each linked. Empty in, empty out. Other columns are ignored.
    """
    cols = ["conv_id", "turn", "role", "text", "kind", "call_id", "tool", "arguments"]
    m = messages.select(*cols)
    calls = m.where((F.col("kind") == "call") & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("turn").alias("called"))
    results = m.where((F.col("kind") == "result") & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("results"))
    ids = calls.join(results, ["conv_id", "call_id"], "left")
    if "after" in messages.columns:
        ids = ids.join(levels(messages.where("kind = 'call' and call_id is not null").select("conv_id", "call_id", "after")), ["conv_id", "call_id"], "left")
    else:
        ids = ids.withColumn("level", F.lit(0))
    # Written, so that the join reads both sides from exchanges and a hot conversation's rows can be split.
    out = m.join(shared(ids), ["conv_id", "call_id"], "left")
    kind, called = F.col("kind"), F.col("called").isNotNull()
    status = F.when(kind == "call", F.when(called & F.col("level").isNull(), "cyclic").when(F.col("results") > 0, "answered").otherwise("unanswered")).when(kind == "result", F.when(called, "linked").otherwise("orphan")).otherwise("message")
    pair = lambda k, c: F.concat(F.lit(f'"{k}":'), F.coalesce(c, F.lit("null")))
    parts = F.array_compact(F.array(F.when(kind == "call", pair("arguments", canonical(F.col("arguments")))), pair("content", json_string(F.col("text"))), F.when(kind != "message", pair("id", json_string(F.col("call_id")))), pair("role", json_string(F.col("role"))), F.when(kind == "call", pair("tool", json_string(F.col("tool"))))))
    errors = F.when(kind == "call", violations(F.col("tool"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    return out.select(
        "conv_id", "turn", "role", "kind", "call_id", status.alias("status"), F.coalesce(F.when(called, F.col("level")), F.lit(0)).alias("level"),
        F.coalesce(F.when(kind == "result", F.col("called")), F.col("turn")).alias("anchor_turn"), (kind == "result").cast("int").alias("phase"),
        F.array_join(errors, ",").alias("errors"), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json"),
    )


def as_calls(conversations: DataFrame, long: int = 300) -> DataFrame:
    """Plain conversations as calls: a user's turn calls ``reply``, the assistant's next turn is the result.

    A call comes after the call two turns before. Its arguments are those of the schema, but for three kinds of call that
    break it: a text of over ``long`` code points gives its length as a string, a null text as null, and every fourth turn
    has an argument that the schema doesn't know.
    """
    turn, text = F.col("turn").cast("bigint"), F.col("text").cast("string")
    base = conversations.select(F.col("conv_id").cast("bigint"), turn.alias("turn"), F.col("role").cast("string"), text.alias("text"))
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    asked = F.when(kind == "call", F.col("turn")).when(kind == "result", F.col("turn") - 1)
    chars = F.length("text").cast("string")
    chars = F.when(F.length("text") > long, F.concat(F.lit('"'), chars, F.lit('"'))).otherwise(F.coalesce(chars, F.lit("null")))
    draft = F.when(F.col("turn") % 4 == 0, F.lit(',"draft":true')).otherwise("")
    arguments = F.when(kind == "call", F.concat(F.lit('{"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit(',"chars":'), chars, draft, F.lit("}")))
    after = F.when(kind == "call", F.array_compact(F.array((F.col("turn") - 2).cast("string"))))
    return base.select("*", kind.alias("kind"), asked.cast("string").alias("call_id"), F.when(kind == "call", "reply").alias("tool"), arguments.alias("arguments"), after.alias("after"))
