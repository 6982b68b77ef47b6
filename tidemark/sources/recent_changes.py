"""Encyclopedia edit firehose: raw lines to normalised edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.coercion import (
    HOLDER,
    NOT_THERE,
    OBJECT,
    TEXT,
    bad_optional_text,
    bad_optional_whole,
    bind,
    epoch_seconds_time,
    iso_time,
    kind,
    member,
    optional_text,
    optional_whole,
    to_whole,
    truthy,
    with_fields,
    with_plain,
)
from tidemark.functions.text import none_if_empty

# The event types that describe a change of a page.
RELEVANT_TYPES = ["edit", "new", "categorize", "log"]

SOURCE = "recent_changes"


EVENT_NAMES = [
    "type", "wiki", "title", "title_url", "comment", "user", "namespace", "bot", "minor",
    "length", "timestamp", "meta",
]
META_NAMES, LENGTH_NAMES = ["uri", "dt"], ["new"]


def find_edit(event: dict) -> list | None:
    """The values of a plain line's fields; None where ``meta`` or ``length`` is something other
    than null or an object with members."""
    found, held = [], []
    for holder, names in (("meta", META_NAMES), ("length", LENGTH_NAMES)):
        inner = event.get(holder) or {}
        if type(inner) is not dict or (not inner and event.get(holder) is not None):
            return None
        held += [inner.get(name, NOT_THERE) for name in names]
    for name in EVENT_NAMES:
        value = event.get(name, NOT_THERE)
        found.append(HOLDER if type(value) is dict and name in ("meta", "length") else value)
    return found + held


def _fields(raw: DataFrame) -> DataFrame:
    f = with_plain(raw, [*EVENT_NAMES, *META_NAMES, *LENGTH_NAMES], find_edit)
    f = bind(f, event=F.when(~F.col("plain"), F.try_parse_json(F.col("value"))))
    f = bind(
        f,
        event_kind=F.when(F.col("plain"), OBJECT).otherwise(kind(F.col("event"))),
        meta=member(F.col("event"), "meta"),
        length=member(F.col("event"), "length"),
    )
    f = with_fields(f, "event", EVENT_NAMES)
    return with_fields(with_fields(f, "meta", META_NAMES), "length", LENGTH_NAMES)


def _truthy(name: str) -> Column:
    return truthy(F.col(f"t_{name}"), F.col(f"k_{name}"))


def _bad_text(name: str) -> Column:
    """A value kept only when non-empty must then be text."""
    return _truthy(name) & (F.col(f"k_{name}") != TEXT)


def _text(name: str) -> Column:
    return none_if_empty(optional_text(F.col(f"t_{name}"), F.col(f"k_{name}")))


def classify_recent_changes(raw: DataFrame, wikis: Sequence[str] = ()) -> DataFrame:
    """Every line as an edit plus ``drop_reason``, which is null for the edits to keep.

    ``raw`` holds ``seq``, ``arrived_at`` (stands in for "now", so that a replay gives the
    same times) and ``value``. An empty ``wikis`` admits every site.
    """
    f = _fields(raw)
    wiki = F.coalesce(_text("wiki"), F.lit(""))
    kind_text = optional_text(F.col("t_type"), F.col("k_type"))
    namespace = to_whole(F.col("t_namespace"), F.col("k_namespace"), 0)
    length = optional_whole(F.col("t_new"), F.col("k_new"))
    url = F.when(_truthy("uri"), _text("uri")).otherwise(
        optional_text(F.col("t_title_url"), F.col("k_title_url"))
    )
    odd_holder = F.lit(False)
    for name in ("meta", "length"):
        odd_holder = odd_holder | (_truthy(name) & (F.col(f"k_{name}") != OBJECT))
    invalid = (
        _bad_text("wiki") | _bad_text("title") | _bad_text("comment") | _bad_text("user")
        | _bad_text("uri")
        | (~_truthy("uri") & bad_optional_text(F.col("k_title_url")))
        | namespace.try_cast("int").isNull()
        | bad_optional_whole(F.col("t_new"), F.col("k_new"))
        | odd_holder
    )
    reason = (
        F.when(F.coalesce(F.col("value"), F.lit("")) == "", "empty")
        .when(~F.col("plain") & F.col("event").isNull(), "malformed")
        .when(F.col("event_kind") != OBJECT, "not an object")
        .when(~F.coalesce(kind_text.isin(RELEVANT_TYPES), F.lit(False)), "type")
    )
    if wikis:
        reason = reason.when(~wiki.isin(list(wikis)), "wiki")
    reason = reason.when(~_truthy("title"), "no title").when(invalid, "invalid")
    dt = iso_time(optional_text(F.col("t_dt"), F.col("k_dt")))
    when = F.coalesce(
        epoch_seconds_time(F.col("t_timestamp"), F.col("k_timestamp")), dt, F.col("arrived_at")
    )
    return f.select(
        "seq",
        "arrived_at",
        wiki.alias("wiki"),
        _text("title").alias("title"),
        url.alias("title_url"),
        _text("comment").alias("last_comment"),
        _text("user").alias("last_user"),
        kind_text.alias("event_type"),
        namespace.try_cast("int").alias("namespace"),
        _truthy("bot").alias("is_bot"),
        _truthy("minor").alias("is_minor"),
        length.alias("length_new"),
        when.alias("event_time"),
        reason.alias("drop_reason"),
    )


def read_recent_changes(raw: DataFrame, wikis: Sequence[str] = ()) -> DataFrame:
    kept = classify_recent_changes(raw, wikis).where(F.col("drop_reason").isNull())
    return kept.drop("drop_reason")
