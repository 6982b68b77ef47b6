"""Live change events and the latest-events feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.coercion import (
    ABSENT,
    BOOL,
    OBJECT,
    bind,
    kind,
    member,
    missing,
    truthy,
    with_fields,
)

# Fixed value: how many events the feed shows.
FEED_LENGTH = 60

LIVE_ROW_FIELDS = ["wiki", "title", "title_url", "last_user", "event_type", "edit_count"]


def live_events(messages: DataFrame) -> DataFrame:
    """Change messages as live events. Neither operation nor id is validated here, so an
    event without an id shows the text ``None``; what cannot be read is left out."""
    f = bind(
        messages.where(F.col("value").isNotNull()).select("seq", "value"),
        message=F.try_parse_json(F.col("value")),
    )
    f = f.where(kind(F.col("message")) == OBJECT)
    payload = member(F.col("message"), "payload")
    f = bind(
        f, change=F.when(kind(payload) != ABSENT, payload).otherwise(F.col("message"))
    )
    f = f.where(kind(F.col("change")) == OBJECT)
    f = bind(
        f, after=member(F.col("change"), "after"), before=member(F.col("change"), "before")
    )
    f = with_fields(f, "change", ["op", "ts_ms", "after", "before"])
    after = truthy(F.col("t_after"), F.col("k_after"))
    before = truthy(F.col("t_before"), F.col("k_before"))
    empty = F.parse_json(F.lit("{}"))
    f = bind(f, row=F.when(after, F.col("after")).when(before, F.col("before")).otherwise(empty))
    f = with_fields(f.where(kind(F.col("row")) == OBJECT), "row", ["id", *LIVE_ROW_FIELDS])
    ident = (
        F.when(missing(F.col("k_id")), F.lit("None"))
        .when(F.col("k_id") == BOOL, F.initcap("t_id"))
        .otherwise(F.col("t_id"))
    )
    return f.select(
        "seq",
        F.col("t_op").alias("op"),
        ident.alias("id"),
        *[F.col(f"t_{name}").alias(name) for name in LIVE_ROW_FIELDS],
        F.col("t_ts_ms").alias("ts_ms"),
    )


def latest_feed(events: DataFrame, length: int = FEED_LENGTH) -> DataFrame:
    """The newest titled events, newest first."""
    titled = events.where(F.col("title") != "")
    return titled.orderBy(F.col("seq").desc()).limit(length)
