"""Exact top-k inner products from an impact-ordered index, one score at a time.

Integer vectors are cut into blocks. A block's postings (vector, dimension, impact) are grouped
into segments by the size of the impact, largest first, and inside a segment into one list per
dimension. Queries add up one segment after the other, a few of them at a time, so that a list is
read once for all of these that have a weight in its dimension. What the open segments can still
add to a vector is bounded by the length of its open part times the length of the query. The ``k``
vectors that lead so far are scored exactly, and whoever can't reach the least of these scores is
out; as soon as those left are few, they are scored exactly and the query reads no further segment.
Where no such proof comes, all segments are read and the sums are exact.

Queries and vectors meet block by block: every pair of blocks is one group of bounded size, so
neither side is ever whole in one task. The block of vectors is indexed once per group and the
group's queries pass it in small batches. A pair gives at most ``k`` rows per query, which a ranking by
query merges.

Definitions: vectors that are null or hold null or non-finite components take no part; only
vectors of a query's own length are its candidates; a candidate with the query's id is the
query's own row. A candidate row that is repeated comes back as often as it is there, at
neighbouring ranks; a repeated query is asked once. Rows with one id and different vectors are
different candidates and different queries of one id, ranked together. An empty table, or one
without queries, gives no rows. Vectors of any length are read whole, and other columns are passed
by. Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep, one_row

K = 20
VECTOR_BLOCK = 8192
QUERY_BLOCK = 16_384
# Components of a block at most, on average, so that blocks of long vectors have fewer rows.
VECTOR_COMPONENTS = 1 << 19
QUERY_COMPONENTS = 1 << 20
# Segments split at these shares of the largest impact of a block, and a query is rescored exactly
# when at most this share of a block's vectors may still belong to its result.
LEVELS = (0.5, 0.125, 0.03125)
RESCORE_SHARE = 0.15
# Queries that read a list together.
BATCH = 32


def integer_vector(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, null unless all are finite numbers."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale).cast("double") * x.cast("double")))
    usable = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(usable, whole)


class Segment:
    """Postings of one range of impacts, one list per dimension, in the order of dimensions."""

    def __init__(self, row: np.ndarray, dim: np.ndarray, impact: np.ndarray):
        order = np.argsort(dim, kind="stable")
        self.row, self.impact = row[order], impact[order]
        self.dims, starts = np.unique(dim[order], return_index=True)
        self.ends = np.append(starts, len(row))

    def lists(self):
        """``dimension, rows, impacts`` of every list; a vector is in a list once at most."""
        for at, dim in enumerate(self.dims):
            part = slice(self.ends[at], self.ends[at + 1])
            yield dim, self.row[part], self.impact[part]

    def add(self, weights: np.ndarray, sums: np.ndarray) -> None:
        """Add to ``sums`` (vector, query) what the lists give with ``weights`` (dimension, query).
        A list is skipped by the queries that have no weight in its dimension."""
        for dim, row, impact in self.lists():
            asked = np.flatnonzero(weights[dim])
            scores = impact.astype(sums.dtype)[:, None]
            if 2 * len(asked) > weights.shape[1]:
                sums[row] += scores * weights[dim]
            elif len(asked):
                sums[np.ix_(row, asked)] += scores * weights[dim, asked]


def segments(vectors: np.ndarray) -> list[Segment]:
    """Postings of a block by descending impact."""
    size = np.abs(vectors)
    largest = int(size.max(initial=0))
    upper, found = largest + 1, []
    for share in (*LEVELS, 0.0):
        lower = max(1, int(largest * share))
        row, dim = np.nonzero((size >= lower) & (size < upper))
        if len(row):
            found.append(Segment(row, dim, vectors[row, dim]))
        upper = min(upper, lower)
    return found


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        sure = np.flatnonzero(scores > kth)
        ties = np.flatnonzero(scores == kth)
        need = k - len(sure)
        if len(ties) > need:
            ties = ties[np.argpartition(ids[ties], need - 1)[:need]]
        chosen = np.concatenate([sure, ties])
    else:
        chosen = np.arange(len(scores))
    return chosen


class Block:
    """The index of one block: segments in order, and the length of what lies behind each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        self.ids, self.vectors, self.copies = ids, vectors, copies
        self.largest = float(np.abs(vectors).max(initial=0))
        self.segments = segments(vectors)
        # Added up from the last segment on: only sums of open parts, so nothing cancels out.
        squares, self.rest = np.zeros(len(vectors)), []
        for segment in reversed(self.segments):
            self.rest.insert(0, np.sqrt(squares))
            squares = squares + np.bincount(segment.row, segment.impact.astype(float) ** 2, len(vectors))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """Arrays ``query_id, vec_id, score, copies`` with all of this block's share in the results."""
        out = [(np.zeros(0, np.int64),) * 4]
        for at in range(0, len(queries), BATCH):
            asked = query_ids[at : at + BATCH]
            for query_id, (found, scores) in zip(asked, self.batch(asked, queries[at : at + BATCH], k)):
                out.append((np.full(len(found), query_id), self.ids[found], scores, self.copies[found]))
        return [np.concatenate(x) for x in zip(*out)]

    def batch(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and scores of the ``k`` best of each query."""
        exact = self._exact(queries)
        lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        weights = np.ascontiguousarray(queries.T).astype(exact)
        sums = np.zeros((len(self.ids), len(queries)), dtype=exact)
        open_queries, found = np.arange(len(queries)), {}
        for segment, rest in zip(self.segments, self.rest):
            segment.add(weights, sums)
            if rest is self.rest[-1] or exact is np.int64 or len(self.ids) <= k + 1:
                continue
            for column, q in enumerate(open_queries):
                slack = lengths[q] * rest * (1 + 1e-9) + 1e-3
                members = self._members(sums[:, column], slack, query_ids[q], queries[q], k)
                if members is not None:
                    found[q] = self._best(members, self.vectors[members] @ queries[q], k)
            going = [q not in found for q in open_queries]
            if not all(going):
                open_queries, sums, weights = open_queries[going], sums[:, going], weights[:, going]
            if not len(open_queries):
                break
        for column, q in enumerate(open_queries):
            others = np.flatnonzero(self.ids != query_ids[q])
            found[q] = self._best(others, sums[others, column].astype(np.int64), k)
        return [found[q] for q in range(len(queries))]

    def _best(self, members: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = first_of(scores, self.ids[members], k)
        return members[best], scores[best]

    def _exact(self, queries: np.ndarray):
        """The narrowest type in which every partial sum is exact."""
        bound = float(np.abs(queries).max(initial=0)) * self.largest * queries.shape[1]
        return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64

    def _members(self, sums: np.ndarray, slack: np.ndarray, query_id: int, query: np.ndarray, k: int) -> np.ndarray | None:
        """Who may still be among the first ``k``, or None while they are too many."""
        others = self.ids != query_id
        upper = np.where(others, sums + slack, -np.inf)
        most = RESCORE_SHARE * len(sums)
        # Not worth the trouble where so many may still pass the leader.
        if np.count_nonzero(upper >= sums.max(where=others, initial=-np.inf)) > most:
            return None
        leading = np.argpartition(np.where(others, sums, -np.inf), -k)[-k:]
        if not others[leading].all():
            return None
        members = np.flatnonzero(upper >= (self.vectors[leading] @ query).min())
        return members if len(members) <= most else None


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt into so many blocks: ``dims, block`` and the rows' columns."""
    deal = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
    return rows.select(F.size("vector").alias("dims"), deal.alias("block"), F.col("vec_id").alias("id"), "vector", "copies")


def search(embeddings: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id",
           vector_column: str = "embedding", scale: int = 64,
           vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of each row for which ``is_query`` (over
    ``vec_id``) holds, among all other rows."""
    rows = embeddings.select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        integer_vector(F.col(vector_column), scale).alias("vector"),
    )
    # Rows alike are one candidate with a number, so that copies are multiplied once.
    rows = rows.where("vector is not null").groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies"))
    rows = keep(rows, "vectors")
    queries = rows.where(is_query & F.col("vec_id").isNotNull())
    size = F.size("vector")
    count = one_row(rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("n_size"),
        F.count(F.when(is_query, 1)).alias("q"), F.sum(F.when(is_query, size)).alias("q_size"),
    ))
    blocks = max(1, -(-count["n"] // vector_block), -(-(count["n_size"] or 0) // VECTOR_COMPONENTS))
    query_blocks = max(1, -(-count["q"] // query_block), -(-(count["q_size"] or 0) // QUERY_COMPONENTS))
    # Each block goes to every block of the other side: copies are as many as the other blocks.
    left = packed(rows, blocks).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    right = packed(queries, query_blocks).drop("copies").withColumnRenamed("block", "query_block")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def pair(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64)] * 4
        if len(vectors) and len(asked):
            matrix = np.stack(vectors["vector"].to_numpy()).astype(np.int64)
            index = Block(vectors["id"].to_numpy(), matrix, vectors["copies"].to_numpy())
            found = index.search(asked["id"].to_numpy(), np.stack(asked["vector"].to_numpy()).astype(np.int64), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "copies"), found)))

    # Candidates without an id can't be told from others: they take the smallest id of all.
    left = left.withColumn("id", F.coalesce("id", F.lit(-(2**63))))
    keys = ["dims", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        pair, "query_id bigint, vec_id bigint, score bigint, copies bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("upto") - F.col("copies")
    ranks = F.sequence(before + 1, F.least(F.col("upto"), F.lit(k)))
    ranked = found.withColumn("upto", upto).where(before < k).withColumn("rank", F.explode(ranks))
    no_id = F.when(F.col("vec_id") != -(2**63), F.col("vec_id"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), no_id.alias("vec_id"), "score")
