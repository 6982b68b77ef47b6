"""Term-keyed postings: BM25 that reads only the lists of its queries' terms.

The inverted table has a row per live document and tagged term: how often it occurs, the field's
length, the columns that searches filter by and, of titles, the places where it stands. It is
stored in folders by the hash of the term, ordered by term, so a search opens the folders of its
terms and skips row groups of others. A list of any length is spread over several files.

A search gathers the lists of its terms by document, each posting once, and documents are scored
from them block by block as they are from the index: pairs of query and document never leave a
task, but for the best of a block. Titles are put together from the places of their terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import is_live
from tidemark.session import MAX_BROADCAST_ROWS, equi_join

# Rows of one folder that are aimed at, the fewest and the most folders, and the files that the
# lists of a folder are spread over.
BUCKET_ROWS = 2_000_000
FEWEST, MOST = 16, 4096
SPREAD = 4
POSTING = "term string, id string, tf int, length int, wiki string, namespace int, places array<int>"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def inverted(docs: DataFrame) -> DataFrame:
    """``term, id, tf, length, wiki, namespace, places`` of live analysed documents."""
    pairs = docs.where(is_live()).select(
        "id", "wiki", "namespace", "title_terms", "t_len", "s_len", "c_len", F.inline(F.arrays_zip("terms", "tfs"))
    )
    tag = F.substring("terms", 1, 1)
    length = F.when(tag == "t", F.col("t_len")).when(tag == "s", F.col("s_len")).otherwise(F.col("c_len"))
    word = F.col("terms").substr(F.lit(3), F.length("terms"))
    all_places = F.transform("title_terms", lambda term, at: F.when(term == word, at))
    return pairs.select(
        F.col("terms").alias("term"), "id", F.col("tfs").alias("tf"), length.alias("length"), "wiki", "namespace",
        F.when(tag == "t", F.array_compact(all_places)).alias("places"),
    )


def write_inverted(docs: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """Store the inverted table of a stored index; return the number of its folders and of the
    postings of all documents."""
    rows = docs.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    buckets = min(MOST, max(FEWEST, math.ceil(rows / bucket_rows)))
    lists = inverted(docs).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # The id takes part, so a term that most documents have is never in one task or file.
    dealt = lists.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return buckets, rows


def lists_of(postings: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The folders that hold any wanted term; how many there are is bounded, so they are named in
    the plan and the others are never listed or opened."""
    found = wanted.select(bucket_of(F.col("term"), buckets).alias("bucket")).distinct().collect()
    return postings.where(F.col("bucket").isin(sorted(row.bucket for row in found)))


def gathered(postings: DataFrame, plans: DataFrame, buckets: int, list_terms: int, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The documents on the lists of the plans' terms, in the form of the index but with those terms
    alone: ``id, wiki, namespace, title_terms, terms, tfs`` and the fields' lengths. A posting is
    shuffled once, however many queries ask for its term. A place of a title whose term isn't
    asked for is null, and the length of a field where none is counts as zero. Documents that share
    an id are one, with the words and places of all in ``placed``, which is null otherwise."""
    said = F.transform("q_terms", lambda term: F.concat(F.lit("t:"), term))
    wanted = plans.select(F.explode(F.array_union(F.col("entries.term"), said)).alias("term")).distinct()
    lists = lists_of(postings, wanted, buckets).drop("bucket")
    met = equi_join(lists, wanted, ["term"], spread=F.col("id"), small_rows=list_terms, how="left_semi", max_broadcast_rows=max_broadcast_rows)
    tag = F.substring("term", 1, 1)
    lengths = [F.coalesce(F.max(F.when(tag == name, F.col("length"))), F.lit(0)).alias(f"{name}_len") for name in "tsc"]
    word = F.col("term").substr(F.lit(3), F.length("term"))
    rows = met.groupBy("id").agg(
        F.first("wiki").alias("wiki"), F.first("namespace").alias("namespace"), *lengths,
        F.collect_list(F.struct("term", "tf")).alias("found"),
        F.collect_list(F.when(F.col("places").isNotNull(), F.struct("places", word.alias("word")))).alias("titled"),
    )
    placed = F.flatten(F.transform("titled", lambda t: F.transform(t["places"], lambda at: F.struct(at.alias("at"), t["word"].alias("word")))))
    rows = rows.withColumn("placed", placed)

    def word_at(at: Column) -> Column:
        return F.get(F.filter("placed", lambda p: p["at"] == at), F.lit(0))["word"]

    title = F.when(F.col("t_len") > 0, F.transform(F.sequence(F.lit(0), F.col("t_len") - 1), word_at))
    return rows.select(
        "id", "wiki", "namespace", F.coalesce(title, F.array().cast("array<string>")).alias("title_terms"),
        F.col("found.term").alias("terms"), F.col("found.tf").alias("tfs"), "t_len", "s_len", "c_len",
        F.when(F.size(F.array_distinct("placed.at")) < F.size("placed"), F.col("placed")).alias("placed"),
    )
