"""Structured Streaming jobs over the same definitions as the batch operators.

A batch that fails makes its query fail; started again with the same checkpoint, Spark
repeats exactly that batch, and the store makes the repetition harmless.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.operators.live import live_events
from tidemark.operators.metrics import windowed_rate
from tidemark.sources.changelog import changes_of, dead_letters_of, parse_changelog
from tidemark.streaming.store import ENRICHMENT, BatchTable, DocumentStore, PageStore

# Pace of the two jobs in seconds. How much a batch may hold is a setting of
# the source (``maxOffsetsPerTrigger`` or ``maxFilesPerTrigger``).
INGEST_SECONDS = 2
SYNC_SECONDS = 1


def _start(
    writer: DataStreamWriter, checkpoint: str, seconds: float | None
) -> StreamingQuery:
    """Start at a steady pace, or once over all that is there when no pace is given."""
    writer = writer.option("checkpointLocation", checkpoint)
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def run_of(checkpoint: str) -> Callable[[SparkSession], str]:
    """The identity that Spark gives a checkpoint: the same after a restart, another one where
    the checkpoint is new. It is there once a batch runs, and read with the first."""
    known: list[str] = []

    def run(spark: SparkSession) -> str:
        if not known:
            known.append(json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        return known[0]

    return run


def sync_changes(
    messages: DataFrame, store: DocumentStore, checkpoint: str, seconds: float | None = SYNC_SECONDS
) -> StreamingQuery:
    """Change messages into the document store, rejected ones into its dead letters.

    There is no watermark: however late a change is, its version decides. Rebuilding the
    index is this job with a new checkpoint and an empty store; with a new checkpoint and the
    same store it is a replay, which changes only what was missing.
    """
    run = run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_changelog(batch).persist()
        try:
            if parsed.isEmpty():
                return
            own = run(batch.sparkSession)
            store.write_changes(changes_of(parsed), batch_id, own)
            store.dead_letters.write_batch(dead_letters_of(parsed), batch_id, own)
        finally:
            parsed.unpersist()

    return _start(messages.writeStream.foreachBatch(write), checkpoint, seconds)


SUMMARY = "wiki STRING, title STRING, type STRING, extract STRING, description STRING"


def enrich_documents(
    summaries: DataFrame, store: DocumentStore, known: BatchTable, checkpoint: str, seconds: float | None = SYNC_SECONDS
) -> StreamingQuery:
    """Summaries as they are found, into documents that lack one.

    Each batch is added to ``known``, and all that is known then meets all documents without a
    summary, so that those which came since the last batch, or lost theirs to a newer edit, are
    tried again. ``store.enrich`` with ``known`` does the same where no new summaries come. A
    document keeps the summary it got first; of records in one batch the least one counts.
    """
    run = run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = run(spark)
        known.write_batch(batch, batch_id, own)
        store.enrich(spark, known.parts(spark), (f"{ENRICHMENT}-{own}", batch_id))

    return _start(summaries.writeStream.foreachBatch(write), checkpoint, seconds)


def ingest_edits(
    edits: DataFrame, store: PageStore, checkpoint: str, seconds: float | None = INGEST_SECONDS
) -> StreamingQuery:
    """Edits into the page store. Page keys ignore case and accents, which streaming state
    does not support, so each batch is folded as a batch."""
    run = run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.persist()
        try:
            store.write_edits(parsed, batch_id, run(batch.sparkSession))
        finally:
            parsed.unpersist()

    return _start(edits.writeStream.foreachBatch(write), checkpoint, seconds)


def tail_live_events(
    messages: DataFrame, path: str, checkpoint: str, seconds: float | None = SYNC_SECONDS
) -> StreamingQuery:
    """Live events of a change stream, appended to a table. Reading only what is new is a
    matter of the source (``startingOffsets`` = ``latest``); the checkpoint is its own."""
    writer = live_events(messages).writeStream.format("parquet").option("path", path)
    return _start(writer.outputMode("append"), checkpoint, seconds)


def append_rows(
    rows: DataFrame, path: str, checkpoint: str, seconds: float | None = INGEST_SECONDS
) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", path)
    return _start(writer.outputMode("append"), checkpoint, seconds)


RATE = "label STRING, window_start TIMESTAMP, events BIGINT, per_second DOUBLE"


def stream_rates(
    events: DataFrame,
    path: str,
    checkpoint: str,
    *,
    time: str,
    label: str,
    width_s: int,
    slide_s: int | None = None,
    lateness: str | None = None,
    seconds: float | None = SYNC_SECONDS,
) -> StreamingQuery:
    """Windowed rates kept up to date: each batch stores only the windows it changed.

    ``lateness`` bounds the state; events later than that are not counted any more.
    """
    if lateness is not None:
        events = events.withWatermark(time, lateness)
    table = BatchTable(path, RATE)
    run = run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write_batch(batch, batch_id, run(batch.sparkSession))

    rates = windowed_rate(events, time, label, width_s, slide_s)
    writer = rates.writeStream.outputMode("update").foreachBatch(write)
    return _start(writer, checkpoint, seconds)


def read_rates(spark, path: str) -> DataFrame:
    """The newest value of every window; counts only grow, so the largest is the newest."""
    stored = BatchTable(path, RATE).parts(spark)
    return stored.groupBy("label", "window_start").agg(
        F.max("events").alias("events"), F.max("per_second").alias("per_second")
    )
