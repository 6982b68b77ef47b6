"""State of record from edits: the upsert fold and the change log it emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import (
    COMMENT_LIMIT,
    TITLE_KEY_LIMIT,
    TITLE_LIMIT,
    cut,
    none_if_empty,
)
from tidemark.schemas import KEPT_FIELDS, PAGE_FIELDS, REFRESHED_FIELDS
from tidemark.session import staged

# Page keys ignore case, accents and trailing spaces.
KEY_COLLATION = "UNICODE_CI_AI_RTRIM"

# Widths of the stored columns that are not cut on write.
URL_WIDTH = 1024
USER_WIDTH = 255
WIKI_WIDTH = 64
TYPE_WIDTH = 32

# Positions per part when a page's history is divided; see ``derive_changelog``.
PART_POSITIONS = 1_000_000


def write_form(edits: DataFrame) -> DataFrame:
    """Edits cut to the stored widths."""
    return edits.withColumns(
        {
            "title": cut(F.col("title"), TITLE_LIMIT),
            "last_comment": none_if_empty(cut(F.col("last_comment"), COMMENT_LIMIT)),
        }
    )


def too_wide() -> Column:
    """Edits whose uncut columns the table cannot hold."""

    def over(name: str, width: int) -> Column:
        return F.coalesce(F.length(name) > width, F.lit(False))

    return (
        over("title_url", URL_WIDTH) | over("last_user", USER_WIDTH) | over("wiki", WIKI_WIDTH)
        | over("event_type", TYPE_WIDTH)
    )


def split_too_wide(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits to fold, edits to set aside with the reason)."""
    rejected = edits.where(too_wide()).withColumn("error", F.lit("write: value too long"))
    return edits.where(~too_wide()), rejected


def with_page_key(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "wiki_key": F.collate(F.col("wiki"), KEY_COLLATION),
            "title_key": F.collate(cut(F.col("title"), TITLE_KEY_LIMIT), KEY_COLLATION),
        }
    )


def page_id(wiki: Column, title: Column) -> Column:
    """Surrogate id of a page from its first site and title, which never change."""
    return F.md5(F.concat_ws("\u0000", wiki, title).cast("binary"))


def _as_state(edits: DataFrame) -> DataFrame:
    """Each edit as the state of a page seen once."""
    kept = F.struct(*KEPT_FIELDS, F.col("event_time").alias("first_seen"))
    return with_page_key(write_form(edits)).select(
        "wiki_key",
        "title_key",
        F.col("seq").alias("first_seq"),
        F.col("seq").alias("last_seq"),
        F.lit(1).cast("bigint").alias("edits"),
        kept.alias("kept"),
        F.struct(*REFRESHED_FIELDS).alias("refreshed"),
    )


def _pages_as_state(pages: DataFrame) -> DataFrame:
    return with_page_key(pages).select(
        "wiki_key",
        "title_key",
        "first_seq",
        "last_seq",
        F.col("edit_count").cast("bigint").alias("edits"),
        F.struct(*KEPT_FIELDS, "first_seen").alias("kept"),
        F.struct(*REFRESHED_FIELDS).alias("refreshed"),
    )


def _combine(states: DataFrame) -> DataFrame:
    folded = states.groupBy("wiki_key", "title_key").agg(
        F.min_by("kept", "first_seq").alias("kept"),
        F.max_by("refreshed", "last_seq").alias("refreshed"),
        F.sum("edits").cast("int").alias("edit_count"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
    )
    flat = folded.select("kept.*", "refreshed.*", "edit_count", "first_seq", "last_seq")
    return flat.select(
        page_id(F.col("wiki"), F.col("title")).alias("id"), *PAGE_FIELDS, "first_seq", "last_seq"
    )


def fold_edits(edits: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per page: kept fields from the first arrival, refreshed fields from the last
    arrival (nulls included), and the number of arrivals.

    A stored page and a single edit are both states, and states combine associatively, so
    the work is combined before the shuffle and ``existing`` simply joins the union.
    """
    states = _as_state(edits)
    if existing is not None:
        states = states.unionByName(_pages_as_state(existing))
    return _combine(states)


def combine_pages(parts: DataFrame) -> DataFrame:
    """Pages from several folds of different stretches of the log."""
    return _combine(_pages_as_state(parts))


def derive_changelog(edits: DataFrame, part_positions: int = PART_POSITIONS) -> DataFrame:
    """The change log the upsert emits: ``c`` for the first sight of a page, ``u`` after it,
    with full row images before and after.

    A page that receives a third of all edits cannot be one window. Its history is divided
    into parts of consecutive log positions, none with more than ``part_positions`` edits.
    Inside a part, counting and looking back are local; a small table with one row per page
    and part carries the count so far and the last row of the part before.
    """
    part = F.floor(F.col("seq") / F.lit(part_positions)).alias("part")
    rows = with_page_key(write_form(edits)).select("*", part)
    # Read twice below, so the lines are parsed once beforehand.
    rows = staged(rows, "keyed-edits")
    keys = ["wiki_key", "title_key", "part"]
    tail = F.struct(*REFRESHED_FIELDS)
    parts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("edits"),
        F.min_by(
            F.struct(*KEPT_FIELDS, F.col("event_time").alias("first_seen")), "seq"
        ).alias("head"),
        F.max_by(tail, "seq").alias("tail"),
    )
    history = W.partitionBy("wiki_key", "title_key").orderBy("part")
    until_now = history.rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(
        *keys,
        F.coalesce(F.sum("edits").over(until_now), F.lit(0)).alias("edits_before"),
        F.first("head").over(history).alias("kept"),
        F.lag("tail").over(history).alias("previous_tail"),
    )
    local = W.partitionBy(*keys).orderBy("seq")
    numbered = rows.select(
        *keys,
        "seq",
        "arrived_at",
        tail.alias("refreshed"),
        F.row_number().over(local).alias("local_no"),
        F.lag(tail).over(local).alias("local_previous"),
    )
    joined = numbered.join(carried, keys)
    number = F.col("edits_before") + F.col("local_no")
    previous = F.coalesce(F.col("local_previous"), F.col("previous_tail"))
    ident = page_id(F.col("kept.wiki"), F.col("kept.title"))

    def image(refreshed: Column, edit_count: Column) -> Column:
        fields = []
        for name in PAGE_FIELDS:
            if name in REFRESHED_FIELDS:
                fields.append(refreshed.getField(name).alias(name))
            elif name == "edit_count":
                fields.append(edit_count.cast("int").alias(name))
            else:
                fields.append(F.col(f"kept.{name}").alias(name))
        return F.struct(ident.alias("id"), *fields)

    return joined.select(
        "seq",
        F.when(number == 1, "c").otherwise("u").alias("op"),
        F.unix_millis("arrived_at").alias("ts_ms"),
        F.when(number > 1, image(previous, number - 1)).alias("before"),
        image(F.col("refreshed"), number).alias("after"),
    )


def changelog_messages(derived: DataFrame) -> DataFrame:
    """The derived change log as JSON messages, for the sync job to read."""

    def with_micros(image: str) -> Column:
        row = F.col(image)
        for name in ("first_seen", "event_time"):
            row = row.withField(name, F.unix_micros(F.col(f"{image}.{name}")))
        return row

    shaped = F.struct(
        "op", with_micros("before").alias("before"), with_micros("after").alias("after"), "ts_ms"
    )
    return derived.select(
        "seq",
        F.col("after.id").alias("key"),
        F.to_json(shaped, {"ignoreNullFields": "false"}).alias("value"),
    )
