"""Typed reads from loosely typed JSON held as VARIANT.

Each helper returns values the way the change feed means them, and a separate validity
test tells a value that must be rejected from one that is simply absent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of a JSON value, as the leading word of its variant schema.
ABSENT, NULL, TEXT, BOOL, ARRAY, OBJECT = "", "VOID", "STRING", "BOOLEAN", "ARRAY", "OBJECT"
NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE"]

# Texts that count as true, and the magnitudes above which a number is read
# as microseconds or as milliseconds since 1970.
TRUE_TEXTS = ["1", "true", "t", "yes"]
MICROS_ABOVE = 1e14
MILLIS_ABOVE = 1e11
# Fixed value: the last millisecond of the year 9999.
LAST_MILLIS = 253_402_300_799_999

ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
)
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"

# What a plain message is: bytes, opening brackets and digits of a number at most.
PLAIN_BYTES = 50_000
PLAIN_BRACKETS = 500
PLAIN_DIGITS = 18


def member(source: Column, name: str) -> Column:
    """A field of a variant object as a variant; null when absent or not an object."""
    return F.try_variant_get(source, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """The JSON kind of a variant."""
    return F.coalesce(
        F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(ABSENT)
    )


def bind(rows: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A plain projection is copied into every later condition that mentions it, which for
    nested JSON reads multiplies the work and the plan. A generator of exactly one row is a
    boundary the optimiser keeps.
    """
    fields = [value.alias(name) for name, value in values.items()]
    kept = [name for name in rows.columns if name not in values]
    return rows.select(*kept, F.inline(F.array(F.struct(*fields))))


def with_fields(rows: DataFrame, source: str, names: Sequence[str]) -> DataFrame:
    """Read fields of a variant object: ``k_<name>`` is the kind, ``t_<name>`` the text.

    All fields are taken in one cast and described by one lambda, which keeps the generated
    code small however many fields there are. Where ``with_plain`` has read a row, its reading
    counts.
    """
    shape = ", ".join(f"{name} variant" for name in names)
    rows = bind(rows, _taken=F.try_variant_get(F.col(source), "$", f"struct<{shape}>"))
    described = F.transform(
        F.array(*[F.col("_taken").getField(name) for name in names]),
        lambda v: F.struct(kind(v).alias("k"), F.try_variant_get(v, "$", "string").alias("t")),
    )
    rows = bind(rows, _facts=F.when(F.col("_taken").isNotNull(), described))
    columns = {}
    for at, name in enumerate(names):
        fact = F.get(F.col("_facts"), F.lit(at))
        found = {"k": F.coalesce(fact.getField("k"), F.lit(ABSENT)), "t": fact.getField("t")}
        for part, column in found.items():
            if f"p{part}_{name}" in rows.columns:
                column = F.when(F.col("plain"), F.col(f"p{part}_{name}")).otherwise(column)
            columns[f"{part}_{name}"] = column
    read = [f"p{part}_{name}" for part in "kt" for name in names]
    return bind(rows, **columns).drop("_taken", "_facts", *read)


class NotThere:
    """A field that a message doesn't have."""


class Holder:
    """An object with members, whose text nobody asks for."""


NOT_THERE, HOLDER = NotThere(), Holder()
PLAIN_KINDS = {str: TEXT, int: NUMBERS[0], bool: BOOL, type(None): NULL, NotThere: ABSENT, Holder: OBJECT}


def whole_number(digits: str) -> int:
    if len(digits) > PLAIN_DIGITS:
        raise ValueError("a long number")
    return int(digits)


def refuse(text: str) -> None:
    raise ValueError("not plain")


def plain_object(raw: bytes | None, decode: Callable[[str], Any]) -> dict | None:
    """The object of a plain message, else None."""
    if raw is None or len(raw) > PLAIN_BYTES or b"\\u" in raw or raw.count(b"{") + raw.count(b"[") > PLAIN_BRACKETS:
        return None
    try:
        found = decode(raw.decode())
    except (ValueError, RecursionError):
        return None
    return found if type(found) is dict else None


def plain_text(value: Any) -> str | None:
    """The text of a value as a variant's cast gives it."""
    if type(value) is str:
        return value
    if type(value) is bool:
        return "true" if value else "false"
    if type(value) is int:
        return str(value)
    return "{...}" if type(value) is Holder else None


def with_plain(rows: DataFrame, names: Sequence[str], find: Callable[[dict], list | None]) -> DataFrame:
    """Read the fields of plain messages, ``value``, in one pass over their bytes: ``plain`` tells
    which these are, ``pk_<name>`` and ``pt_<name>`` are kind and text of their fields.

    ``find`` takes a message's object to the values of ``names``, or to None. Variants cost many
    times as much as the text they come from, so they are left to messages for which the two
    readers could differ: broken ones, those that are no object, escapes by number, fractions and
    long numbers, arrays and objects in a field, very long or deeply nested ones.
    """
    width = 2 * len(names)
    added = [f"p{part}_{name}" for part in "kt" for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = json.JSONDecoder(parse_float=refuse, parse_int=whole_number, parse_constant=refuse).decode
        nothing = [None] * width
        for batch in batches:
            if not batch.num_rows:
                continue
            plain, facts = [], []
            for raw in batch.column("value").cast(pa.large_binary()).to_pylist():
                message = plain_object(raw, decode)
                values = None if message is None else find(message)
                kinds = [None] if values is None else [PLAIN_KINDS.get(type(value)) for value in values]
                plain.append(None not in kinds)
                facts.append([*kinds, *map(plain_text, values)] if plain[-1] else nothing)
            columns = [pa.array(column, pa.string()) for column in zip(*facts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(plain, pa.bool_()), *columns], names=[*batch.schema.names, "plain", *added]
            )

    kept = [f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema]
    return rows.mapInArrow(run, ", ".join([*kept, "plain boolean", *(f"{name} string" for name in added)]))


def missing(value_kind: Column) -> Column:
    return value_kind.isin(ABSENT, NULL)


def truthy(text: Column, value_kind: Column) -> Column:
    """Whether a loosely typed value counts as present and non-empty."""
    return (
        F.when(value_kind == TEXT, text != "")
        .when(value_kind.isin(NUMBERS), text.try_cast("double") != 0)
        .when(value_kind == BOOL, text == "true")
        .when(value_kind.isin(ARRAY, OBJECT), ~text.isin("[]", "{}"))
        .otherwise(F.lit(False))
    )


def to_flag(text: Column, value_kind: Column) -> Column:
    """Booleans as they are, numbers as non-zero, a few texts as true, the rest false."""
    return (
        F.when(value_kind == BOOL, text == "true")
        .when(value_kind.isin(NUMBERS), text.try_cast("double") != 0)
        .when(value_kind == TEXT, F.lower(text).isin(TRUE_TEXTS))
        .otherwise(F.lit(False))
    )


def to_whole(text: Column, value_kind: Column, default: int) -> Column:
    """Integer reading of ``value or default``; null only when it cannot be read."""
    whole = (
        F.when(
            value_kind.isin(NUMBERS),
            F.regexp_extract(text.try_cast("decimal(38,9)").cast("string"), r"^-?\d+", 0),
        )
        .when(value_kind == BOOL, F.lit("1"))
        .when((value_kind == TEXT) & text.rlike(INTEGER_TEXT), F.trim(text))
    )
    return F.when(truthy(text, value_kind), whole.try_cast("bigint")).otherwise(
        F.lit(default).cast("bigint")
    )


def optional_text(text: Column, value_kind: Column) -> Column:
    return F.when(value_kind == TEXT, text)


def bad_optional_text(value_kind: Column) -> Column:
    return ~value_kind.isin(ABSENT, NULL, TEXT)


def text_or_empty(text: Column, value_kind: Column) -> Column:
    return F.coalesce(optional_text(text, value_kind), F.lit(""))


def bad_text_or_empty(text: Column, value_kind: Column) -> Column:
    """A non-text value is acceptable only when it is falsy, which reads as empty."""
    return (value_kind != TEXT) & truthy(text, value_kind)


def optional_whole(text: Column, value_kind: Column) -> Column:
    """An integer, a float without fraction, a flag or integer text; else null."""
    plain = F.when(value_kind == BOOL, F.when(text == "true", "1").otherwise("0")).otherwise(
        F.regexp_replace(F.trim(text), r"\.0*$", "")
    )
    readable = value_kind.isin([*NUMBERS, BOOL]) | (
        (value_kind == TEXT) & text.rlike(INTEGER_TEXT)
    )
    return F.when(readable & plain.rlike(INTEGER_TEXT), plain.try_cast("int"))


def bad_optional_whole(text: Column, value_kind: Column) -> Column:
    return ~missing(value_kind) & optional_whole(text, value_kind).isNull()


def iso_time(text: Column) -> Column:
    """ISO date or date-time, a missing zone meaning UTC; anything else is null."""
    return F.when(text.rlike(ISO_TIME), text.try_cast("timestamp"))


def decode_time(text: Column, value_kind: Column) -> Column:
    """Epoch number of any magnitude, or ISO text, as a timestamp."""
    number = text.try_cast("double")
    scale = F.when(number > MICROS_ABOVE, 1.0).when(number > MILLIS_ABOVE, 1e3).otherwise(1e6)
    return F.when(
        value_kind.isin(NUMBERS), F.timestamp_micros(F.rint(number * scale).cast("bigint"))
    ).when(value_kind == TEXT, iso_time(text))


def millis_time(millis: Column) -> Column:
    """Epoch milliseconds, such as the source time of a change, as a timestamp; null beyond the
    years that a calendar date has."""
    return F.when(F.abs(millis) <= LAST_MILLIS, F.timestamp_millis(millis))


def epoch_seconds_time(text: Column, value_kind: Column) -> Column:
    micros = F.rint(text.try_cast("double") * 1e6).cast("bigint")
    return F.when(value_kind.isin(NUMBERS), F.timestamp_micros(micros))
