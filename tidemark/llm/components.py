"""Connected components by alternating star contraction, as joins and aggregates.

Every round points each node's larger neighbours, then its smaller ones, at the least node next
to it. Both steps are an aggregate and a join on the node; a node with very many neighbours is
summed up before the shuffle and its join may be split. The number of rounds grows with the
logarithm of the longest path. Edges are written after each round, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, large, one_row


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all ends of ``edges`` (``a, b``): ``root`` is the least node reachable."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = keep(pairs.distinct(), "edges")
    while True:
        # Large star: of all neighbours, the larger ones go to the least of all.
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        higher = both.where("b > a").join(large(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the node and its smaller neighbours go to the least of them.
        higher = higher.distinct()
        lower = higher.groupBy("a").agg(F.min("b").alias("m"))
        small = higher.join(large(lower), "a")
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = keep(moved.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # The forest is flat when no node is both below and above another.
        roots = after.select(F.col("b").alias("a")).distinct()
        deeper = one_row(after.join(large(roots), "a", "left_semi").agg(F.count(F.lit(1)).alias("n")))["n"]
        several = one_row(after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")))["n"]
        pairs = after
        if not deeper and (several or 0) <= 1:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
