"""Chat formatting: messages, and tool calls linked to their results, as canonical JSON.

DataFrame operations only. Calls and results meet in a hash join by identifier. A call may name
other calls in its arguments (``{"$ref": id}``); calls are ordered so that each comes after
those it names. Calls that name one other form chains, which are followed by pointer doubling, so
rounds grow with the logarithm of a chain's length; only calls that name several are settled level
by level, every round those all of whose names are settled.
Arguments are checked against the schema of their tool and written as canonical JSON: no white
space, keys in order at every depth. One row is one message, so a conversation of any size is
never in one task; its messages are ordered by ``turn, level, call_id``.

Definitions: calls are told apart by conversation and identifier; of repeated calls or results
the first by turn counts, then the first by text; a result without call is an orphan, a call
without result unanswered; a name that no call of the conversation has is a missing reference;
calls that name each other in a circle, or depend on such calls, have no level. Arguments that
are null or aren't a JSON object are invalid. Null texts are written as JSON null; texts of any
length are written whole. A call without identifier is unanswered and a result without one is an
orphan, each with an error; those alike in all their columns are one. All rows without conversation
are one conversation. A null turn comes first. Other columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, narrow, one_row, replace
from tidemark.session import staging_dir

CALLS = {"conv_id": "bigint", "turn": "bigint", "call_id": "string", "tool": "string", "arguments": "string"}
RESULTS = {"conv_id": "bigint", "turn": "bigint", "call_id": "string", "content": "string"}
NO_CONVERSATION = -(2**63)
# What stands for a missing identifier starts so.
NAMELESS = "\0"
REFERENCE = '"\\$ref":"((?:[^"\\\\]|\\\\.)*)"'


@dataclass(frozen=True)
class Field:
    """One argument of a tool: its name, JSON type (integer, number, string, boolean, object or
    array), whether it must be there, and the largest number allowed."""

    name: str
    kind: str
    required: bool = True
    maximum: int | None = None


# How Spark names the types of JSON values.
KINDS = {
    "integer": "^BIGINT|^DECIMAL\\([0-9]+,0\\)", "number": "^(BIGINT|DECIMAL|DOUBLE)", "string": "^STRING",
    "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY",
}


def first_per_call(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per conversation and identifier. What is compared is an aggregate, so that a
    repeated call is one row per task."""
    others = [c for c in rows.columns if c not in ("conv_id", "call_id")]
    order = [*by, *(c for c in others if c not in by)]
    firsts = rows.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order)).alias("first"))
    return firsts.select("conv_id", "call_id", *(F.col(f"first.{c}").alias(c) for c in others))


def problems(arguments: Column, tool: Column, schemas: dict[str, list[Field]]) -> Column:
    """What is wrong with a call, as an array of texts in the order of the schema."""
    checks = [F.when(F.coalesce(~F.startswith(F.to_json(arguments), F.lit("{")), F.lit(True)), F.lit("arguments: not an object"))]
    known = F.lit(False)
    for name, fields in sorted(schemas.items()):
        is_tool = tool == name
        known = known | F.coalesce(is_tool, F.lit(False))
        for field in fields:
            value = F.try_variant_get(arguments, f"$.{field.name}", "variant")
            kind = F.schema_of_variant(value)
            absent = value.isNull()
            if field.required:
                checks.append(F.when(is_tool & absent, F.lit(f"{field.name}: missing")))
            checks.append(F.when(is_tool & ~absent & ~F.rlike(kind, F.lit(KINDS[field.kind])), F.lit(f"{field.name}: not {field.kind}")))
            if field.maximum is not None:
                number = F.try_variant_get(arguments, f"$.{field.name}", "double")
                checks.append(F.when(is_tool & (number > field.maximum), F.lit(f"{field.name}: above {field.maximum}")))
    checks.insert(0, F.when(~known, F.lit("tool: unknown")))
    return F.array_compact(F.array(*checks))


def references(arguments: Column) -> Column:
    """Identifiers that a call names, from its arguments as canonical JSON. A quote within a
    string is escaped there, so what looks like a reference inside a text isn't one."""
    quoted = F.transform(F.regexp_extract_all(arguments, F.lit(REFERENCE), 1), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.array_distinct(F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>"))


KEY = ["conv_id", "call_id"]


def followed(steps: DataFrame) -> DataFrame:
    """Chains by pointer doubling. ``steps``: ``conv_id, call_id, target, dist, open``, each call
    with the one call it names; ``open`` where that one names one call too. Every round a step
    takes on its target's step, so they double in length; those still open when a round closes
    none go in circles."""
    steps = keep(steps, "steps")
    before = None
    while True:
        left = one_row(steps.agg(F.count(F.when(F.col("open"), 1)).alias("n")))["n"]
        if not left or left == before:
            return steps
        before = left
        onward = steps.select("conv_id", F.col("call_id").alias("target"), F.col("target").alias("further"), F.col("dist").alias("more"), F.col("open").alias("still"))
        longer = steps.where("open").join(onward, ["conv_id", "target"]).select(*KEY, F.col("further").alias("target"), (F.col("dist") + F.col("more")).alias("dist"), F.col("still").alias("open"))
        steps = replace(steps, steps.where("not open").unionByName(longer), "steps")


def joints(links: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of calls that name several others. ``links``: ``conv_id, call_id,
    base, more, value``, one per name: ``value`` is the level it asks for, null as long as that of
    ``base`` isn't known. A round settles the calls all of whose links have values."""
    links = keep(links, "links")
    folder, rounds = staging_dir(links.sparkSession, "settled"), 0
    schema = "conv_id bigint, call_id string, level int"
    while True:
        ready = links.groupBy(*KEY).agg(F.max("value").alias("level"), F.count(F.when(F.col("value").isNull(), 1)).alias("open"))
        path = f"{folder}/round={rounds}"
        ready.where("open = 0").select(*KEY, F.col("level").cast("int").alias("level")).write.parquet(path)
        fresh = links.sparkSession.read.schema(schema).parquet(path)
        if not one_row(fresh.agg(F.count(F.lit(1)).alias("n")))["n"]:
            break
        rounds += 1
        known = fresh.select("conv_id", F.col("call_id").alias("base"), "level")
        waiting = links.join(fresh.select(*KEY), KEY, "left_anti").join(known, ["conv_id", "base"], "left")
        links = replace(links, waiting.select(*KEY, "base", "more", F.coalesce("value", F.col("level") + F.col("more")).alias("value")), "links")
    # All rounds are read as one table, so the plan doesn't grow with their number.
    return links.sparkSession.read.schema(f"{schema}, round int").parquet(folder).drop("round")


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level, missing``: 0 for calls that name no other, otherwise one more
    than the highest call named; null within and behind circles. ``arguments`` are canonical."""
    calls = calls.select(*KEY, "arguments")
    named = calls.select(*KEY, F.explode(references(F.col("arguments"))).alias("needs"))
    known = calls.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("known"))
    edges = keep(named.join(known, ["conv_id", "needs"], "left"), "references")
    counts = edges.groupBy(*KEY).agg(F.count("known").alias("waits"), F.count(F.when(F.col("known").isNull(), 1)).alias("missing"))
    nodes = calls.select(*KEY).join(counts, KEY, "left").fillna(0, ["waits", "missing"])
    nodes = keep(nodes, "nodes")
    edges = edges.where("known").join(nodes.select(*KEY, "waits"), KEY)
    single = edges.where("waits = 1").select(*KEY, F.col("needs").alias("target"))
    is_open = nodes.where("waits = 1").select("conv_id", F.col("call_id").alias("target"), F.lit(True).alias("open"))
    steps = followed(single.join(is_open, ["conv_id", "target"], "left").select(*KEY, "target", F.lit(1).alias("dist"), F.coalesce("open", F.lit(False)).alias("open")))
    # What a call with several names waits for: the end of the chain that each name starts.
    ends = steps.select("conv_id", F.col("call_id").alias("needs"), "target", "dist", "open")
    links = edges.where("waits > 1").join(ends, ["conv_id", "needs"], "left").select(
        *KEY, F.coalesce("target", "needs").alias("base"), (F.coalesce("dist", F.lit(0)) + 1).alias("more"), "open"
    )
    roots = nodes.where("waits = 0").select("conv_id", F.col("call_id").alias("base"), F.lit(True).alias("root"))
    links = links.join(roots, ["conv_id", "base"], "left")
    links = links.select(*KEY, "base", "more", F.when(F.col("root") & ~F.coalesce("open", F.lit(False)), F.col("more")).alias("value"))
    settled = nodes.where("waits = 0").select(*KEY, F.lit(0).alias("level")).unionByName(joints(links))
    settled = keep(settled, "levels")
    onward = settled.select("conv_id", F.col("call_id").alias("target"), "level")
    chains = steps.where("not open").join(onward, ["conv_id", "target"]).select(*KEY, (F.col("level") + F.col("dist")).cast("int").alias("level"))
    return nodes.drop("waits").join(settled.unionByName(chains), KEY, "left")


def canonical(variant: Column) -> Column:
    """JSON text without white space, keys in order at every depth: a variant holds its keys so."""
    return F.to_json(variant)


def nameless(kind: str, *columns: str) -> Column:
    """Stands for a missing identifier, and differs where the row does; no result has a call's."""
    return F.concat(F.lit(NAMELESS + kind), F.to_json(F.struct(*columns)))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, list[Field]]) -> DataFrame:
    """One row per call, and one per orphan result: ``conv_id, turn, call_id, tool, arguments``
    (canonical), ``level, status, errors, result, result_turn``."""
    # A missing conversation id is one like any other, and joins as such.
    conversation = F.coalesce("conv_id", F.lit(NO_CONVERSATION))
    calls = narrow(calls, **CALLS).withColumn("conv_id", conversation)
    calls = calls.withColumn("call_id", F.coalesce("call_id", nameless("call", "turn", "tool", "arguments")))
    calls = first_per_call(calls, ["turn", "tool", "arguments"])
    calls = keep(calls.withColumn("arguments", canonical(F.try_parse_json("arguments"))), "calls")
    results = narrow(results, **RESULTS).withColumn("conv_id", conversation)
    results = results.withColumn("call_id", F.coalesce("call_id", nameless("result", "turn", "content")))
    results = first_per_call(results, ["turn", "content"])
    results = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.col("content").alias("result"))
    both = calls.withColumn("is_call", F.lit(True)).join(results, ["conv_id", "call_id"], "full")
    rows = both.join(levels(calls), ["conv_id", "call_id"], "left")
    parsed = F.try_parse_json("arguments")
    rows = rows.withColumn("_parsed", parsed)
    errors = problems(F.col("_parsed"), F.col("tool"), schemas)
    errors = F.when(F.col("missing") > 0, F.array_append(errors, F.lit("reference: missing"))).otherwise(errors)
    errors = F.when(F.col("level").isNull(), F.array_append(errors, F.lit("reference: circular"))).otherwise(errors)
    errors = F.when(F.col("is_call"), errors).otherwise(F.array().cast("array<string>"))
    unnamed = F.startswith("call_id", F.lit(NAMELESS))
    errors = F.when(unnamed, F.array_append(errors, F.lit("call_id: missing"))).otherwise(errors)
    status = (
        F.when(F.col("is_call").isNull(), "orphan")
        .when(unnamed, "unanswered")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("result_turn").isNull() & F.col("result").isNull(), "unanswered")
        .otherwise("linked")
    )
    rows = rows.withColumn("errors", errors)
    return rows.select(
        F.nullif("conv_id", F.lit(NO_CONVERSATION)).alias("conv_id"), "turn", F.when(~unnamed, F.col("call_id")).alias("call_id"), "tool", "arguments", "level",
        status.alias("status"), "errors", "result", "result_turn",
    )


def formatted(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, list[Field]]) -> DataFrame:
    """``conv_id, turn, level, call_id, kind, json``: every message and every linked call as one
    line of canonical JSON."""
    said = narrow(messages, conv_id="bigint", turn="bigint", role="string", text="string").select(
        "conv_id", "turn", F.lit(-1).alias("level"), F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("kind"),
        line(F.struct(F.col("text").alias("content"), "role", "turn")).alias("json"),
    )
    tied = linked(calls, results, schemas)
    record = F.struct(
        F.col("arguments"), F.col("call_id").alias("id"), F.col("errors"), F.col("level"),
        F.col("result"), F.col("status"), F.col("tool"),
    )
    acts = tied.select(
        "conv_id", F.coalesce("turn", "result_turn").alias("turn"), "level", "call_id",
        F.lit("call").alias("kind"), line(record).alias("json"),
    )
    return said.unionByName(acts)


def line(record: Column) -> Column:
    """A struct whose fields are in order, as JSON with its nulls."""
    return F.to_json(record, {"ignoreNullFields": "false"})
