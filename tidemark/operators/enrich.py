"""Summary enrichment: a lookup by site and title, written back under the same version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import SUMMARY_LIMIT, cut, none_if_empty, strip
from tidemark.operators.fold import is_live, with_stage
from tidemark.session import hot_key_join

# Titles that are not articles, and summary kinds without an extract.
SKIPPED_TITLES = ["User:", "Talk:", "Wikipedia:", "Template:", "Category:"]
NO_EXTRACT_TYPES = ["disambiguation", "no-extract"]


def site_language(wiki: Column) -> Column:
    """Language of an encyclopedia site, such as ``en`` for ``enwiki``; null for others."""
    return none_if_empty(F.regexp_extract(wiki, "^(.+)wiki$", 1))


def is_article_title(title: Column) -> Column:
    return (title != "") & ~title.rlike("^(?:" + "|".join(SKIPPED_TITLES) + ")")


def summary_text(kind: Column, extract: Column, description: Column) -> Column:
    """The text to use from a summary record, or null."""
    plain = F.coalesce(kind.isin(NO_EXTRACT_TYPES), F.lit(False))
    chosen = F.when(plain, description).otherwise(
        F.coalesce(none_if_empty(extract), description)
    )
    return none_if_empty(cut(strip(F.coalesce(chosen, F.lit(""))), SUMMARY_LIMIT))


def enrichable(docs: DataFrame) -> DataFrame:
    """Live main-namespace articles that have no summary yet."""
    return docs.where(
        is_live()
        & (F.col("namespace") == 0)
        & is_article_title(F.col("title"))
        & (F.coalesce(F.col("summary"), F.lit("")) == "")
        & site_language(F.col("wiki")).isNotNull()
    )


def enrich(docs: DataFrame, summaries: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """The enrichable documents for which a summary exists, with that summary.

    ``summaries`` holds ``wiki, title, type, extract, description``; an empty table is a
    provider that knows nothing. It is reduced to one record per page before the join, so a
    page listed many times does not multiply its documents, and titles that very many
    documents share do not gather in one task. The documents keep their
    version and are marked as the later write, and so go through the guarded merge: a newer
    edit wins, and enriching twice changes nothing. Vectors are recomputed from the new text.
    """
    text = summary_text(F.col("type"), F.col("extract"), F.col("description"))
    useful = summaries.withColumn("new_summary", text).where(F.col("new_summary").isNotNull())
    # Of the records with a text, the least by type, extract and description.
    record = F.struct("type", "extract", "description", "new_summary")
    one = useful.groupBy("wiki", "title").agg(F.min(record).alias("found"))
    known = one.select("wiki", "title", F.col("found.new_summary").alias("new_summary"))
    joined = hot_key_join(with_stage(enrichable(docs)), known, ["wiki", "title"], hot_rows)
    return joined.withColumns({"summary": F.col("new_summary"), "stage": F.lit(1)}).drop(
        "new_summary", "embedding"
    )
