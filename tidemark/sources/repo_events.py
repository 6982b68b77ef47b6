"""Public events of a code-hosting site: raw lines to normalised edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.coercion import (
    OBJECT,
    TEXT,
    bad_optional_text,
    bind,
    iso_time,
    kind,
    member,
    optional_text,
    truthy,
    with_fields,
)
from tidemark.functions.text import none_if_empty

# The site name given to these edits and the address of a repository page.
WIKI = "github"
PAGE_ADDRESS = "https://github.com/"

SOURCE = "repo_events"


def classify_repo_events(raw: DataFrame) -> DataFrame:
    """Every line as an edit with its ``event_id`` and ``drop_reason``; repeats not yet removed."""
    f = bind(raw, event=F.try_parse_json(F.col("value")))
    f = bind(
        f,
        event_kind=kind(F.col("event")),
        repo=member(F.col("event"), "repo"),
        actor=member(F.col("event"), "actor"),
    )
    f = with_fields(f, "event", ["id", "type", "repo", "actor", "created_at"])
    f = with_fields(with_fields(f, "repo", ["name"]), "actor", ["login"])

    def there(name: str):
        return truthy(F.col(f"t_{name}"), F.col(f"k_{name}"))

    def text(name: str):
        return optional_text(F.col(f"t_{name}"), F.col(f"k_{name}"))

    invalid = (
        (there("name") & (F.col("k_name") != TEXT))
        | (there("repo") & (F.col("k_repo") != OBJECT))
        | (there("actor") & (F.col("k_actor") != OBJECT))
        | bad_optional_text(F.col("k_type"))
        | bad_optional_text(F.col("k_login"))
        | (there("created_at") & (F.col("k_created_at") != TEXT))
    )
    reason = (
        F.when(F.coalesce(F.col("value"), F.lit("")) == "", "empty")
        .when(F.col("event").isNull(), "malformed")
        .when(F.col("event_kind") != OBJECT, "not an object")
        .when(~there("id"), "no id")
        .when(~there("repo") | (~there("name") & (F.col("k_repo") == OBJECT)), "no repository")
        .when(invalid, "invalid")
    )
    repo = none_if_empty(text("name"))
    return f.select(
        "seq",
        "arrived_at",
        F.col("t_id").alias("event_id"),
        F.lit(WIKI).alias("wiki"),
        repo.alias("title"),
        F.concat(F.lit(PAGE_ADDRESS), repo).alias("title_url"),
        text("type").alias("last_comment"),
        text("login").alias("last_user"),
        text("type").alias("event_type"),
        F.lit(0).alias("namespace"),
        F.lit(False).alias("is_bot"),
        F.lit(False).alias("is_minor"),
        F.lit(None).cast("int").alias("length_new"),
        F.coalesce(iso_time(text("created_at")), F.col("arrived_at")).alias("event_time"),
        reason.alias("drop_reason"),
    )


def repo_drop_counts(classified: DataFrame) -> DataFrame:
    """Dropped lines by reason. Every arrival of an id after its first is a repeat; they are
    counted per id, so neither a hot id nor the lines without one gather in a task."""
    known = F.coalesce(F.col("event_id") != "", F.lit(False))
    groups = classified.groupBy(
        F.when(known, F.col("event_id")).alias("event_id"),
        F.when(~known, F.col("drop_reason")).alias("nameless"),
    ).agg(F.min_by("drop_reason", "seq").alias("first"), F.count(F.lit(1)).alias("n"))
    nameless = F.col("nameless").isNotNull()
    rows = groups.select(
        F.inline(
            F.array(
                F.struct(
                    F.coalesce("nameless", "first").alias("reason"),
                    F.when(nameless, F.col("n")).otherwise(1).alias("n"),
                ),
                F.struct(
                    F.lit("repeat").alias("reason"),
                    F.when(nameless, 0).otherwise(F.col("n") - 1).alias("n"),
                ),
            )
        )
    )
    dropped = rows.where(F.col("reason").isNotNull() & (F.col("n") > 0))
    return dropped.groupBy("reason").agg(F.sum("n").alias("events")).select(
        F.lit(SOURCE).alias("source"), "reason", "events"
    )


def first_arrivals(classified: DataFrame) -> DataFrame:
    """The first arrival of each event id, combined before the shuffle."""
    fields = [c for c in classified.columns if c != "event_id"]
    first = classified.groupBy("event_id").agg(F.min_by(F.struct(*fields), "seq").alias("row"))
    return first.select("row.*")


def read_repo_events(raw: DataFrame) -> DataFrame:
    """Edits of a batch of lines, one per event id. Lines without an id are dropped first, so
    they never gather under one key."""
    named = classify_repo_events(raw).where(F.col("event_id").isNotNull())
    kept = first_arrivals(named).where(F.col("drop_reason").isNull())
    return kept.drop("drop_reason")


def stream_repo_events(raw: DataFrame, horizon: str = "7 days") -> DataFrame:
    """The same for a stream: an id is remembered for ``horizon`` of arrival time, so the
    state stays bounded. Repeats further apart than the horizon are not recognised."""
    named = classify_repo_events(raw).where(F.col("event_id").isNotNull())
    marked = named.withWatermark("arrived_at", horizon)
    # As in a batch, an id counts as seen whether or not its first line is of use.
    kept = marked.dropDuplicatesWithinWatermark(["event_id"]).where(F.col("drop_reason").isNull())
    return kept.drop("event_id", "drop_reason")
