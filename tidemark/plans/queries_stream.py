"""Registered queries that run as streams over everything there is and read the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import fixtures as fx
from tidemark.functions.coercion import millis_time
from tidemark.operators import fold
from tidemark.plans import queries_feed as feed
from tidemark.plans import queries_search as search
from tidemark.session import staging_dir
from tidemark.sources import changelog, recent_changes, repo_events
from tidemark.streaming import jobs
from tidemark.streaming.handoff import Handoff
from tidemark.streaming.store import BatchTable, DocumentStore, PageStore

BATCHES = 4


def landed(df, label):
    """Write rows as files in log order, and read them back in a few batches, each with a
    file per core."""
    spark = df.sparkSession
    path = staging_dir(spark, label)
    cores = spark.sparkContext.defaultParallelism
    df.repartitionByRange(BATCHES * cores, "seq").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", cores).parquet(path)


def synced(spark, sf_dir):
    messages = landed(feed.messages(spark, sf_dir), "messages")
    store = DocumentStore(staging_dir(spark, "documents"))
    jobs.sync_changes(messages, store, staging_dir(spark, "offsets"), None).awaitTermination()
    return store


def stream_index(spark, sf_dir):
    """The document store after the whole change log has been streamed into it."""
    return feed.state_cols(synced(spark, sf_dir).state(spark))


def stream_compacted(spark, sf_dir):
    """The same after a compaction."""
    store = synced(spark, sf_dir)
    store.compact(spark)
    return feed.state_cols(store.state(spark))


def stream_replay(spark, sf_dir):
    """The same after a replay of the whole log, with a new checkpoint, into a compacted store."""
    store = synced(spark, sf_dir)
    store.compact(spark)
    messages = landed(feed.messages(spark, sf_dir), "messages")
    jobs.sync_changes(messages, store, staging_dir(spark, "offsets"), None).awaitTermination()
    return feed.state_cols(store.state(spark))


# Partitions of the change topic below.
PARTITIONS = 4


def bootstrap_stream(spark, sf_dir):
    """A replica started from a snapshot. Every partition of the topic is marked at another place,
    and the snapshot shows a tenth of the log more than its mark."""
    topic = feed.messages(spark, sf_dir).withColumns({
        "partition": F.pmod(F.xxhash64("key"), F.lit(PARTITIONS)).cast("int"), "offset": F.col("seq"),
    })
    end = F.broadcast(topic.agg(F.max("offset").alias("end")))
    share = (F.col("partition") + 1) / F.lit(PARTITIONS + 1)
    log = topic.join(end).withColumn("at", F.col("offset") / F.col("end"))
    store = DocumentStore(staging_dir(spark, "documents"))
    handoff = Handoff(staging_dir(spark, "handoff"), store)
    handoff.begin(log.where(F.col("at") <= share))
    seen = changelog.parse_changelog(log.where(F.col("at") <= share + 0.1).drop("end", "at"))
    handoff.load(fold.latest_per_id(changelog.changes_of(seen)))
    tail = handoff.tail(landed(topic, "messages"))
    jobs.sync_changes(tail, store, staging_dir(spark, "offsets"), None).awaitTermination()
    source_us = F.unix_micros(millis_time(F.col("version"))).alias("source_us")
    return feed.state_cols(store.state(spark)).select("*", source_us)


def stream_enrich(spark, sf_dir):
    """Summaries streamed into the store; documents of other sites arrive after them, and are
    tried again."""
    docs = search.docs(spark, sf_dir)
    first = F.coalesce(F.col("wiki") == "enwiki", F.lit(False))
    store = DocumentStore(staging_dir(spark, "documents"))
    store.write_changes(docs.where(first), 0)
    # All records of a page lie in one file, and so in one batch.
    summaries = fx.view(spark, sf_dir, fx.summaries).withColumn("seq", F.xxhash64("wiki", "title"))
    known = BatchTable(staging_dir(spark, "summaries"), jobs.SUMMARY)
    found = landed(summaries, "summaries")
    jobs.enrich_documents(found, store, known, staging_dir(spark, "offsets"), None).awaitTermination()
    store.write_changes(docs.where(~first), 1)
    store.enrich(spark, known.parts(spark))
    return store.state(spark).select("id", "version", "summary")


def stream_dead_letters(spark, sf_dir):
    bad = synced(spark, sf_dir).dead_letters.parts(spark)
    decoded = ~F.col("payload").startswith('{"_raw":')
    return bad.select("seq", "key", "error", "raw", decoded.alias("decoded"))


def stream_pages(spark, sf_dir):
    raw = landed(feed.raw_lines(spark, sf_dir, fx.recent_raw), "edits")
    store = PageStore(staging_dir(spark, "pages"))
    edits = recent_changes.read_recent_changes(raw)
    jobs.ingest_edits(edits, store, staging_dir(spark, "offsets"), None).awaitTermination()
    return feed.page_cols(store.state(spark))


def stream_repo_dedup(spark, sf_dir):
    raw = landed(feed.raw_lines(spark, sf_dir, fx.repo_raw), "repo-events")
    path = staging_dir(spark, "repo-edits")
    edits = repo_events.stream_repo_events(raw, "3650 days")
    jobs.append_rows(edits, path, staging_dir(spark, "offsets"), None).awaitTermination()
    return spark.read.parquet(path).select(
        "wiki", "title", "title_url", "event_type", "last_comment", "last_user",
        feed.micros("event_time", "event_us"),
    )


def stream_live_events(spark, sf_dir):
    messages = landed(feed.messages(spark, sf_dir), "messages")
    path = staging_dir(spark, "live")
    jobs.tail_live_events(messages, path, staging_dir(spark, "offsets"), None).awaitTermination()
    return spark.read.parquet(path)


def stream_rates(spark, sf_dir):
    events = feed.events(spark, sf_dir).withColumn("seq", F.col("event_id"))
    path = staging_dir(spark, "rates")
    jobs.stream_rates(
        landed(events.select("seq", "ts", "event_type"), "events"), path,
        staging_dir(spark, "offsets"), time="ts", label="event_type", width_s=60, seconds=None,
    ).awaitTermination()
    return jobs.read_rates(spark, path).select(
        "label", feed.micros("window_start", "window_us"), "events",
        F.round("per_second", 6).alias("per_second"),
    )


def queries():
    return {
        "stream_index": stream_index,
        "stream_compacted": stream_compacted,
        "stream_replay": stream_replay,
        "bootstrap_stream": bootstrap_stream,
        "stream_enrich": stream_enrich,
        "stream_dead_letters": stream_dead_letters,
        "stream_pages": stream_pages,
        "stream_repo_dedup": stream_repo_dedup,
        "stream_live_events": stream_live_events,
        "stream_rates": stream_rates,
    }


def oracle_sql():
    from tidemark.plans import oracle_feed as o
    from tidemark.plans.oracle_search import clean, stream_enrich

    cleaned = f"nullif({clean('last_comment')}, '')"
    state = f"SELECT * REPLACE ({cleaned} AS last_comment) FROM ({o.index_state()}) s"
    known_time = "CASE WHEN abs(version) <= 253402300799999 THEN version * 1000 END"
    return {
        "bootstrap_stream": f"SELECT *, {known_time} AS source_us FROM ({state}) b",
        "stream_enrich": stream_enrich(),
        "stream_index": state,
        "stream_compacted": state,
        "stream_replay": state,
        "stream_dead_letters": o.dead_letters(),
        "stream_pages": o.edit_fold(),
        "stream_repo_dedup": f"SELECT * EXCLUDE (seq) FROM ({o.repo_events()}) r",
        "stream_live_events": o.live_events(),
        "stream_rates": o.rate_1m(),
    }
