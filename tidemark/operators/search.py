"""Ranked retrieval: admission, query-aware weights, rank fusion, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import strip, words
from tidemark.operators.index import HASH_PROVIDER, ContractError, TextIndex
from tidemark.operators.blocks import UNITS
from tidemark.operators.lexical import bm25_matches, top_per_query
from tidemark.operators.nearest import embed_queries, nearest
from tidemark.session import MAX_BROADCAST_ROWS, equi_join

# Candidates per retriever, the rank constant, retriever weights, the lowest
# vector score admitted, page size bounds and the namespace searched by default.
CANDIDATES = 50
RANK_CONSTANT = 60
BM25_WEIGHT = 1.15
KNN_WEIGHT = 0.85
KNN_FLOOR = 0.72
MIN_SIZE, MAX_SIZE, DEFAULT_SIZE = 1, 50, 10
DEFAULT_NAMESPACE = 0

# Factors on the two weights for queries that look like a title, and for long
# ones, with the word counts that tell them apart.
TITLE_FACTORS = (1.25, 0.75)
LONG_FACTORS = (0.85, 1.2)
SHORT_WORDS = 2
LONG_WORDS = 6


def admit(queries: DataFrame) -> DataFrame:
    """Requests that are searched: blank ones are left out, sizes are brought into bounds,
    absent settings get their defaults, and a negative namespace means all of them."""
    defaults = {
        "mode": F.lit("hybrid"), "size": F.lit(DEFAULT_SIZE),
        "wiki": F.lit(None).cast("string"), "namespace": F.lit(DEFAULT_NAMESPACE),
    }
    for name, value in defaults.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, value)
    size = F.least(F.greatest(F.col("size"), F.lit(MIN_SIZE)), F.lit(MAX_SIZE))
    space = F.when(F.col("namespace") >= 0, F.col("namespace"))
    admitted = queries.where(strip(F.col("query")) != "")
    return admitted.select(
        "query_id", "query", "mode", size.cast("int").alias("size"), "wiki",
        space.cast("int").alias("namespace"),
    )


def query_weights(
    query: Column, bm25_weight: float = BM25_WEIGHT, knn_weight: float = KNN_WEIGHT
) -> tuple[Column, Column]:
    """Retriever weights by the shape of the query: short, quoted and title-like queries lean
    on words, long ones on meaning."""
    text = strip(query)
    tokens = words(text)
    count = F.size(tokens)
    capitals = F.size(F.filter(tokens, lambda token: token.rlike(r"^\p{IsUppercase}")))
    enough = F.greatest(F.lit(1), F.floor(count / 2))
    quoted = text.startswith('"') & text.endswith('"')
    title_like = quoted | (count <= SHORT_WORDS) | (capitals >= enough)

    def weight(base: float, at: int) -> Column:
        return (
            F.when(count == 0, F.lit(base))
            .when(title_like, F.lit(base * TITLE_FACTORS[at]))
            .when(count >= LONG_WORDS, F.lit(base * LONG_FACTORS[at]))
            .otherwise(F.lit(base))
        )

    return weight(bm25_weight, 0), weight(knn_weight, 1)


def fuse(
    bm25: DataFrame,
    knn: DataFrame,
    queries: DataFrame,
    query_rows: int,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    weights: tuple[float, float] = (BM25_WEIGHT, KNN_WEIGHT),
) -> DataFrame:
    """Fuse two ranked lists ``(query_id, id, rank, units)`` into hits.

    A document in both lists is one row after a single grouping. Hybrid queries are scored
    by weighted reciprocal rank with the ranks counted from zero; single-retriever queries
    keep that retriever's own score. Equal scores keep list order, words first.
    """
    none = F.lit(None).cast("int")
    both = bm25.select(
        "query_id", "id", F.col("rank").alias("bm25_rank"), none.alias("knn_rank"), "units"
    ).unionByName(
        knn.select("query_id", "id", none.alias("bm25_rank"), F.col("rank").alias("knn_rank"), "units")
    )
    joined = both.groupBy("query_id", "id").agg(
        F.max("bm25_rank").alias("bm25_rank"),
        F.max("knn_rank").alias("knn_rank"),
        F.max("units").alias("units"),
    )
    w_bm25, w_knn = query_weights(F.col("query"), *weights)
    settings = queries.select(
        "query_id", "mode", "size", w_bm25.alias("w_bm25"), w_knn.alias("w_knn")
    )
    joined = equi_join(
        joined, settings, ["query_id"], spread=F.col("id"), small_rows=query_rows,
        max_broadcast_rows=max_broadcast_rows,
    )

    def part(weight: str, rank: str) -> Column:
        share = F.col(weight) / (F.lit(float(RANK_CONSTANT)) + (F.col(rank) - 1))
        return F.when(F.col(rank).isNotNull(), share).otherwise(F.lit(0.0))

    fused = part("w_bm25", "bm25_rank") + part("w_knn", "knn_rank")
    scored = joined.withColumn(
        "raw", F.when(F.col("mode") == "hybrid", fused).otherwise(F.col("units") / UNITS)
    )
    order = W.partitionBy("query_id").orderBy(
        F.col("raw").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("knn_rank").asc_nulls_last()
    )
    placed = scored.withColumn("position", F.row_number().over(order))
    # The constant bound lets each task drop what no page can show; the other is per query.
    kept = placed.where((F.col("position") <= MAX_SIZE) & (F.col("position") <= F.col("size")))
    return kept.select(
        "query_id", "position", "id", F.round("raw", 6).alias("score"), "bm25_rank", "knn_rank"
    )


def search(
    queries: DataFrame,
    index: TextIndex,
    *,
    floor: float | None = KNN_FLOOR,
    candidates: int = CANDIDATES,
    weights: tuple[float, float] = (BM25_WEIGHT, KNN_WEIGHT),
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    query_vectors: DataFrame | None = None,
    **bounds,
) -> DataFrame:
    """Hits ``(query_id, position, id, score, bm25_rank, knn_rank)`` for a table of requests.

    ``query_vectors`` (``query_id, embedding``) replaces the hash vectors when the index was
    built with another provider.
    """
    asked = admit(queries)
    query_rows = asked.count()
    lexical = asked.where(F.col("mode").isin("hybrid", "bm25"))
    semantic = asked.where(F.col("mode").isin("hybrid", "vector"))
    bm25 = top_per_query(
        bm25_matches(lexical, index, candidates, max_broadcast_rows, **bounds), candidates
    )
    if query_vectors is None:
        if index.provider != HASH_PROVIDER:
            raise ContractError(f"the index has vectors of {index.provider}: give query_vectors")
        semantic = embed_queries(semantic, query_rows, index.dims)
    else:
        # A query without a vector keeps what its words find.
        semantic = semantic.join(query_vectors.select("query_id", "embedding"), "query_id", "left")
    knn = top_per_query(
        nearest(
            semantic, index.docs, candidates, floor, query_rows, index.documents, **bounds
        ),
        candidates,
    )
    return fuse(bm25, knn, asked, query_rows, max_broadcast_rows, weights)


def with_documents(hits: DataFrame, index: TextIndex, hit_rows: int, fields: list[str]) -> DataFrame:
    """Attach document fields to hits. Vectors are never read."""
    return equi_join(
        index.docs.select("id", *fields), hits, ["id"], spread=F.col("id"), small_rows=hit_rows
    )


def responses(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One response per admitted request: the number of hits and the hits in order. A
    response holds at most a page."""
    asked = admit(queries).select("query_id", "query", "mode")
    hit = F.struct("position", *[c for c in hits.columns if c not in ("query_id", "position")])
    grouped = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    found = asked.join(grouped, "query_id", "left")
    return found.withColumn("count", F.coalesce(F.size("hits"), F.lit(0)))
