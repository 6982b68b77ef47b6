"""From a first snapshot to the change stream, without a gap.

The positions of the change log are noted *before* the source is read. Changes that happen in
between are then in the snapshot and in the stream as well; the guarded fold of the store takes
each once, since a change that the snapshot already shows is no newer than its row. The stream
starts after the noted positions, so what lies before them is never read again.

A partition that has no position yet (a new one, or one that was empty) is read from its
beginning. Noting the positions again, as a repeated start does, keeps the first ones, and loading
the snapshot again replaces it, so a start that failed anywhere is simply repeated.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.store import DocumentStore, finished

MARKS = "partition INT, upto BIGINT"

# The run of the store under which a snapshot is written.
SNAPSHOT = "snapshot"

# Fixed value: how the message broker's source names "from the beginning" of a partition.
EARLIEST = -2


def high_water(log: DataFrame) -> DataFrame:
    """The last offset of every partition; one row per partition, combined before the shuffle."""
    marks = log.groupBy("partition").agg(F.max("offset").alias("upto"))
    return marks.select(F.col("partition").cast("int").alias("partition"), F.col("upto").cast("bigint").alias("upto"))


class Handoff:
    """One start of a replica: the noted positions below ``path``, the snapshot in ``store``."""

    def __init__(self, path: str, store: DocumentStore):
        self.path, self.store = path, store

    def begin(self, log: DataFrame) -> None:
        """Note where the log (``partition, offset``) stands; to be called before the source is
        read for ``load``."""
        spark = log.sparkSession
        if not finished(spark, self.path, "marks"):
            high_water(log).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks=first")

    def marks(self, spark: SparkSession) -> DataFrame:
        if not finished(spark, self.path, "marks"):
            raise ValueError("no positions noted: begin comes before load and tail")
        return spark.read.schema(MARKS).parquet(f"{self.path}/marks=first")

    def load(self, rows: DataFrame) -> None:
        """Write the source's rows, as documents with ``seq`` and ``version``, into the store."""
        self.marks(rows.sparkSession)
        self.store.write_changes(rows, 0, SNAPSHOT)

    def tail(self, messages: DataFrame) -> DataFrame:
        """Messages after the noted positions, for sources that can't start in the middle. The
        marks are as many as the log has partitions."""
        marks = F.broadcast(self.marks(messages.sparkSession))
        joined = messages.join(marks, "partition", "left")
        return joined.where(F.col("upto").isNull() | (F.col("offset") > F.col("upto"))).drop("upto")

    def starting_offsets(self, spark: SparkSession, topic: str, partitions: int) -> str:
        """The same as a setting of the message broker's source, for each of its partitions."""
        known = {row["partition"]: row["upto"] + 1 for row in self.marks(spark).collect()}
        return json.dumps({topic: {str(at): known.get(at, EARLIEST) for at in range(partitions)}})
