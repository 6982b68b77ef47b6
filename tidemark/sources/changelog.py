"""Change messages: unwrapping, validation, the dead-letter split, row to document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.coercion import (
    ABSENT,
    BOOL,
    NOT_THERE,
    NULL,
    OBJECT,
    bad_optional_text,
    bad_optional_whole,
    bad_text_or_empty,
    bind,
    decode_time,
    kind,
    member,
    missing,
    optional_text,
    optional_whole,
    text_or_empty,
    to_flag,
    to_whole,
    truthy,
    with_fields,
    with_plain,
)
from tidemark.schemas import DOC_FIELDS

# Operation codes of the feed (create, update, snapshot read; delete).
UPSERT_OPS = ["c", "u", "r"]
DELETE_OP = "d"

ROW_NAMES = [
    "id", "wiki", "title", "title_url", "last_comment", "last_user", "event_type", "namespace",
    "is_bot", "is_minor", "length_new", "edit_count", "event_time",
]


def unwrap(message: Column, message_kind: Column) -> Column:
    """The change itself: the ``payload`` member when it is present and ``op`` is not."""
    payload = member(message, "payload")
    wrapped = (kind(payload) != ABSENT) & (kind(member(message, "op")) == ABSENT)
    return F.when((message_kind == OBJECT) & wrapped, payload).otherwise(message)


def find_change(message: dict) -> list | None:
    """The values of a plain message's ``op``, ``ts_ms`` and row image; None where the change or
    its row image is no object with members."""
    change = message.get("payload") if "payload" in message and "op" not in message else message
    if type(change) is not dict:
        return None
    op = change.get("op", NOT_THERE)
    row = change.get("before" if op == DELETE_OP else "after")
    if type(row) is not dict or not row:
        return None
    return [op, change.get("ts_ms", NOT_THERE), *[row.get(name, NOT_THERE) for name in ROW_NAMES]]


def parse_changelog(messages: DataFrame) -> DataFrame:
    """One validation pass over ``(seq, key, value)``.

    Tombstones (null value) and JSON nulls carry nothing and are left out. Every other
    message comes back with its document fields and ``error``, null when it is sound.
    """
    f = messages.where(F.col("value").isNotNull()).select("seq", "key", "value")
    f = with_plain(f, ["op", "ts_ms", *ROW_NAMES], find_change)
    plain = F.col("plain")
    f = bind(f, message=F.when(~plain, F.try_parse_json(F.col("value"))))
    f = bind(f, message_kind=kind(F.col("message")))
    f = bind(f, change=unwrap(F.col("message"), F.col("message_kind")))
    f = bind(f, change_kind=F.when(plain, OBJECT).otherwise(kind(F.col("change"))))
    f = f.where(plain | F.col("message").isNull() | (F.col("change_kind") != NULL))
    f = with_fields(f, "change", ["op", "ts_ms"])
    f = bind(f, op=optional_text(F.col("t_op"), F.col("k_op")))
    is_delete = F.col("op") == DELETE_OP
    image = F.when(is_delete, member(F.col("change"), "before")).otherwise(
        member(F.col("change"), "after")
    )
    f = bind(f, row=image)
    f = bind(
        f, row_kind=F.when(plain, OBJECT).otherwise(kind(F.col("row"))),
        row_text=F.try_variant_get(F.col("row"), "$", "string"),
    )
    f = with_fields(f, "row", ROW_NAMES)

    def of(reader, name: str, *args) -> Column:
        return reader(F.col(f"t_{name}"), F.col(f"k_{name}"), *args)

    id_text = F.col("t_id")
    id_text = F.when(F.col("k_id") == BOOL, F.initcap(id_text)).otherwise(id_text)
    no_id = missing(F.col("k_id")) | (id_text == "None")
    version = of(to_whole, "ts_ms", 0)
    namespace = of(to_whole, "namespace", 0).try_cast("int")
    edit_count = of(to_whole, "edit_count", 1).try_cast("int")
    bad_field = (
        of(bad_text_or_empty, "wiki")
        | of(bad_text_or_empty, "title")
        | bad_optional_text(F.col("k_title_url"))
        | bad_optional_text(F.col("k_last_comment"))
        | bad_optional_text(F.col("k_last_user"))
        | bad_optional_text(F.col("k_event_type"))
        | namespace.isNull()
        | edit_count.isNull()
        | of(bad_optional_whole, "length_new")
    )
    error = (
        F.when(~plain & F.col("message").isNull(), "parse: invalid JSON")
        .when(F.col("change_kind") != OBJECT, "parse: change is not an object")
        .when(
            ~F.coalesce(F.col("op").isin([*UPSERT_OPS, DELETE_OP]), F.lit(False)),
            "parse: unsupported op",
        )
        .when(version.isNull(), "parse: invalid ts_ms")
        .when(~plain & ~truthy(F.col("row_text"), F.col("row_kind")), "parse: missing row image")
        .when(F.col("row_kind") != OBJECT, "parse: row image is not an object")
        .when(no_id, "parse: missing row id")
        .when(bad_field, "parse: invalid field")
    )
    return f.select(
        "seq",
        "key",
        "value",
        F.when(plain, F.try_parse_json(F.col("value"))).otherwise(F.col("message")).alias("message"),
        error.alias("error"),
        "op",
        id_text.alias("id"),
        of(text_or_empty, "wiki").alias("wiki"),
        of(text_or_empty, "title").alias("title"),
        of(optional_text, "title_url").alias("title_url"),
        of(optional_text, "last_comment").alias("last_comment"),
        F.lit(None).cast("string").alias("summary"),
        of(optional_text, "last_user").alias("last_user"),
        of(optional_text, "event_type").alias("event_type"),
        namespace.alias("namespace"),
        of(to_flag, "is_bot").alias("is_bot"),
        of(to_flag, "is_minor").alias("is_minor"),
        of(optional_whole, "length_new").alias("length_new"),
        edit_count.alias("edit_count"),
        of(decode_time, "event_time").alias("event_time"),
        version.alias("version"),
        is_delete.alias("deleted"),
    )


def changes_of(parsed: DataFrame) -> DataFrame:
    """The sound changes as documents with their log position and operation."""
    return parsed.where(F.col("error").isNull()).select("seq", "op", *DOC_FIELDS)


def dead_letters_of(parsed: DataFrame) -> DataFrame:
    """The rejected messages: what was wrong, and what was received."""
    payload = F.coalesce(
        F.to_json(F.col("message")), F.to_json(F.struct(F.col("value").alias("_raw")))
    )
    return parsed.where(F.col("error").isNotNull()).select(
        "error", payload.alias("payload"), F.col("value").alias("raw"), "key", "seq"
    )


def split_dead_letters(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = parse_changelog(messages)
    return changes_of(parsed), dead_letters_of(parsed)


def kafka_messages(spark, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """A change topic as a stream; needs the Kafka connector on the class path.

    ``seq`` is the offset: a row's messages share a key and so a partition, which makes the
    offset their order. ``partition`` and ``offset`` say where a message lies, for a handoff
    (see ``streaming.handoff``), whose ``starting_offsets`` are a value for ``starting``.
    """
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )
    return stream.select(
        F.col("offset").alias("seq"),
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def file_messages(spark, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed change files (``seq``, ``key``, ``value``) as a stream."""
    reader = spark.readStream.schema("seq BIGINT, key STRING, value STRING")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
