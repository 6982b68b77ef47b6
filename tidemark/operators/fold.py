"""Newest state per document: batch collapse, guarded merge, replay, live view, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import ADDITIVE_DOC_FIELDS, DOC_FIELDS

# Order of writes to one document. ``stage`` is 0 for an indexed change and 1 for the same
# change with its summary added, so enrichment follows its own change and nothing newer.
ORDER_FIELDS = ["version", "seq", "stage"]


def with_stage(changes: DataFrame) -> DataFrame:
    if "stage" in changes.columns:
        return changes
    return changes.withColumn("stage", F.lit(0))


def latest_per_id(changes: DataFrame) -> DataFrame:
    """The newest write per document id: highest version, then latest arrival.

    Collapsing a batch and guarding a stored row by ``incoming.version >= stored.version``
    are both this maximum, which is associative: any split of the log gives the same state.
    It is aggregated before the shuffle, so a document changed a billion times still sends
    one row per map task.
    """
    staged_changes = with_stage(changes)
    order = F.struct(*ORDER_FIELDS)
    newest = staged_changes.groupBy("id").agg(
        F.max_by(F.struct(*[c for c in staged_changes.columns if c != "id"]), order).alias("row")
    )
    return newest.select("id", "row.*")


def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Version-guarded merge: whole documents replace older or equally old ones, new ids are
    added, late ones are ignored."""
    return latest_per_id(
        with_stage(stored).unionByName(with_stage(incoming), allowMissingColumns=True)
    )


def merge_report(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many incoming documents the guard lets through and how many it skips."""
    newest = latest_per_id(incoming).select("id", F.struct(*ORDER_FIELDS).alias("incoming"))
    held = with_stage(stored).select("id", F.struct(*ORDER_FIELDS).alias("stored"))
    joined = newest.join(held, "id", "left")
    wins = F.col("stored").isNull() | (F.col("incoming") >= F.col("stored"))
    return joined.agg(
        F.count(F.when(wins, True)).alias("written"), F.count(F.when(~wins, True)).alias("skipped")
    )


def bootstrap(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Initial snapshot rows followed by live changes, as one log."""
    return snapshot.unionByName(changes)


def is_live() -> Column:
    """Not deleted; an unknown flag counts as live."""
    return ~F.coalesce(F.col("deleted"), F.lit(False))


def live(docs: DataFrame, **terms) -> DataFrame:
    """Live documents that equal every given field value; a value of None is no condition."""
    found = docs.where(is_live())
    for field, value in terms.items():
        if value is not None:
            found = found.where(F.col(field) == F.lit(value))
    return found


def live_count(docs: DataFrame) -> DataFrame:
    return docs.where(is_live()).agg(F.count(F.lit(1)).alias("documents"))


def lookup(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents by id; unknown and deleted ids give nothing."""
    return docs.where(is_live()).join(ids.select("id").distinct(), "id", "left_semi")


def conform(docs: DataFrame, dims: int | None = None) -> DataFrame:
    """A stored index in today's shape: later fields are added, and a vector of another
    length stops the job when it is read."""
    for name, kind in ADDITIVE_DOC_FIELDS.items():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    if dims is not None and "embedding" in docs.columns:
        fits = F.col("embedding").isNull() | (F.size("embedding") == dims)
        message = F.lit(f"stored vectors do not have {dims} dimensions; rebuild the index")
        docs = docs.withColumn(
            "embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(message))
        )
    return docs


def source_form(docs: DataFrame) -> DataFrame:
    """Documents as written: comments cleaned, boilerplate comments removed."""
    from tidemark.functions.text import clean_comment, none_if_empty

    return docs.withColumn("last_comment", none_if_empty(clean_comment(F.col("last_comment"))))


def source_json(docs: DataFrame, with_embedding: bool = True) -> DataFrame:
    """One JSON text per document, null fields left out."""
    fields = [*DOC_FIELDS]
    if with_embedding and "embedding" in docs.columns:
        fields.append("embedding")
    shaped = source_form(docs)
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    return shaped.select("id", body.alias("source"))
