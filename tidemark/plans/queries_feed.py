"""Registered queries of the change-feed half."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import edits as edit_ops
from tidemark.operators import fold, live, metrics, quantiles
from tidemark.plans import fixtures as fx
from tidemark.session import configure, scan, staged
from tidemark.sources import changelog as feed
from tidemark.sources import recent_changes as recent
from tidemark.sources import repo_events as repos

EDIT_COLS = [
    "seq", "wiki", "title", "title_url", "last_comment", "last_user", "event_type", "namespace",
    "is_bot", "is_minor", "length_new",
]
DOC_COLS = [
    "id", "wiki", "title", "title_url", "last_comment", "last_user", "event_type", "namespace",
    "is_bot", "is_minor", "length_new", "edit_count", "version", "deleted",
]


def micros(name: str, alias: str):
    return F.unix_micros(name).alias(alias)


_LANDED: dict[tuple[str, str, str], DataFrame] = {}


def landed(spark: SparkSession, sf_dir: str, builder) -> DataFrame:
    """A raw input view over whole tables, landed once per application as a feed would be."""
    key = (spark.sparkContext.applicationId, sf_dir, builder.__name__)
    if key not in _LANDED or _LANDED[key].sparkSession is not spark:
        _LANDED[key] = staged(fx.view(spark, sf_dir, builder), builder.__name__)
    return _LANDED[key]


def raw_lines(spark: SparkSession, sf_dir: str, builder) -> DataFrame:
    lines = landed(spark, sf_dir, builder)
    return lines.select("seq", F.timestamp_micros("arrived_us").alias("arrived_at"), "value")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, fx.changelog)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.split_dead_letters(messages(spark, sf_dir))[0]


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound changes, parsed once for a query that reads them several times."""
    return staged(changes(spark, sf_dir), "changes")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.read_recent_changes(raw_lines(spark, sf_dir, fx.recent_raw))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return scan(spark, f"{sf_dir}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def recent_changes(spark, sf_dir):
    return edits(spark, sf_dir).select(*EDIT_COLS, micros("event_time", "event_us"))


def repo_events_dedup(spark, sf_dir):
    found = repos.read_repo_events(raw_lines(spark, sf_dir, fx.repo_raw))
    return found.select(
        "seq", "wiki", "title", "title_url", "event_type", "last_comment", "last_user",
        micros("event_time", "event_us"),
    )


def drop_reasons(spark, sf_dir):
    recent_all = recent.classify_recent_changes(raw_lines(spark, sf_dir, fx.recent_raw))
    repo_all = repos.classify_repo_events(raw_lines(spark, sf_dir, fx.repo_raw))
    return metrics.drop_counts(recent_all, recent.SOURCE).unionByName(
        repos.repo_drop_counts(repo_all)
    )


def page_cols(pages: DataFrame) -> DataFrame:
    return pages.select(
        "wiki", "title", "title_url", "last_comment", "last_user", "event_type", "namespace",
        "is_bot", "is_minor", "length_new", "edit_count",
        micros("first_seen", "first_seen_us"), micros("event_time", "event_us"),
    )


def edit_fold(spark, sf_dir):
    return page_cols(edit_ops.fold_edits(edits(spark, sf_dir)))


def derive_changelog(spark, sf_dir):
    log = edit_ops.derive_changelog(edits(spark, sf_dir))
    return log.select(
        "seq", "op", "ts_ms",
        F.col("after.title").alias("title"), F.col("after.namespace").alias("namespace"),
        micros("after.first_seen", "first_seen_us"),
        F.col("after.edit_count").alias("edit_count"),
        F.col("after.last_comment").alias("last_comment"),
        F.col("after.last_user").alias("last_user"),
        micros("after.event_time", "event_us"),
        F.col("after.length_new").alias("length_new"),
        F.col("before.title").alias("before_title"),
        F.col("before.edit_count").alias("before_edit_count"),
        F.col("before.last_comment").alias("before_comment"),
        F.col("before.last_user").alias("before_user"),
        micros("before.event_time", "before_event_us"),
        F.col("before.length_new").alias("before_length"),
    )


def changelog_parse(spark, sf_dir):
    return changes(spark, sf_dir).select("seq", "op", *DOC_COLS, micros("event_time", "event_us"))


def dead_letters(spark, sf_dir):
    bad = feed.split_dead_letters(messages(spark, sf_dir))[1]
    decoded = ~F.col("payload").startswith('{"_raw":')
    return bad.select("seq", "key", "error", "raw", decoded.alias("decoded"))


def state_cols(state: DataFrame) -> DataFrame:
    return state.select("seq", *DOC_COLS, micros("event_time", "event_us"))


def index_state(spark, sf_dir):
    return state_cols(fold.latest_per_id(changes(spark, sf_dir)))


def live_docs(spark, sf_dir):
    return state_cols(fold.live(fold.latest_per_id(changes(spark, sf_dir))))


def live_counts(spark, sf_dir):
    return fold.live_count(fold.latest_per_id(changes(spark, sf_dir)))


def filtered_docs(spark, sf_dir):
    state = fold.latest_per_id(changes(spark, sf_dir))
    return fold.live(state, wiki="enwiki", namespace=0, last_user=None).select(
        "id", "wiki", "namespace", "title"
    )


def doc_lookup(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").cast("string").alias("id")
    )
    state = fold.latest_per_id(changes(spark, sf_dir))
    return fold.lookup(state, ids).select("id", "wiki", "title", "version")


def halves(spark, sf_dir):
    """The log cut at its middle position."""
    log = log_of(spark, sf_dir)
    bounds = spark.read.parquet(f"{sf_dir}/events.parquet").agg(
        F.floor((F.max("event_id") + F.min("event_id")) / 2).alias("mid")
    )
    marked = log.join(F.broadcast(bounds))
    early = marked.where(F.col("seq") <= F.col("mid")).drop("mid")
    late = marked.where(F.col("seq") > F.col("mid")).drop("mid")
    return early, late


def merge_two_batches(spark, sf_dir):
    early, late = halves(spark, sf_dir)
    return state_cols(fold.merge(fold.latest_per_id(early), fold.latest_per_id(late)))


def merge_report(spark, sf_dir):
    early, late = halves(spark, sf_dir)
    return fold.merge_report(fold.latest_per_id(early), late)


def replay_equals(spark, sf_dir):
    """The state after the whole log has been delivered a second time."""
    log = log_of(spark, sf_dir)
    state = fold.latest_per_id(log)
    return state_cols(fold.merge(state, log))


def bootstrap_tail(spark, sf_dir):
    """Snapshot reads first, then every other change, as one log."""
    log = log_of(spark, sf_dir)
    snapshot = log.where(F.col("op") == "r")
    tail = log.where(F.col("op") != "r")
    return state_cols(fold.latest_per_id(fold.bootstrap(snapshot, tail)))


def live_events(spark, sf_dir):
    return live.live_events(messages(spark, sf_dir))


def live_feed(spark, sf_dir):
    return live.latest_feed(live.live_events(messages(spark, sf_dir)))


def counters_by_op(spark, sf_dir):
    parsed = feed.parse_changelog(messages(spark, sf_dir))
    parsed = staged(parsed.drop("key", "value", "message"), "parsed")
    written = fold.latest_per_id(feed.changes_of(parsed))
    return (
        metrics.sync_counters(parsed)
        .unionByName(metrics.counter(edits(spark, sf_dir), "ingested", F.col("wiki")))
        .unionByName(metrics.counter(written, "indexed"))
    )


def latencies(spark, sf_dir):
    return events(spark, sf_dir).select(
        F.col("event_type").alias("label"), F.greatest("value", F.lit(0.0)).alias("seconds")
    )


def latency_histogram(spark, sf_dir):
    buckets = metrics.bucket_counts(latencies(spark, sf_dir), metrics.SYNC_LATENCY_BOUNDS)
    shown = F.when(F.col("le") == float("inf"), "+Inf").otherwise(
        F.col("le").cast("decimal(10,3)").cast("string")
    )
    return buckets.select("label", shown.alias("le"), "observations")


def latency_histograms(spark, sf_dir):
    """Latencies of three stages, each with the buckets of its metric."""
    stage = F.pmod(F.col("event_id"), F.lit(3))
    metric = F.when(stage == 0, "sync").when(stage == 1, "embedding").otherwise("search")
    # A hundredth, so that the narrow buckets are met too.
    observed = events(spark, sf_dir).select(
        metric.alias("metric"), F.col("event_type").alias("label"),
        (F.greatest("value", F.lit(0.0)) / 100).alias("seconds"),
    )
    found = metrics.histograms(observed)
    shown = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("decimal(10,3)").cast("string"))
    return found.select("metric", "label", shown.alias("le"), "observations")


def latency_quantiles(spark, sf_dir):
    observed = latencies(spark, sf_dir)
    buckets = metrics.bucket_counts(observed, metrics.SYNC_LATENCY_BOUNDS)
    estimated = metrics.bucket_quantiles(buckets, [0.5, 0.95, 0.99])
    # Beside the estimate from a few wide buckets, the median from a summary of narrow ones,
    # and the exact one of all values.
    median = quantiles.quantiles(quantiles.summarize(observed, ["label"]), ["label"], [0.5], "median")
    exact = quantiles.exact_median(observed, "label", "seconds")
    return estimated.join(median.select("label", "median"), "label").join(exact, "label").select(
        "label", "quantile", F.round("seconds", 6).alias("seconds"), "median", F.round("exact_median", 6).alias("exact_median")
    )


def daily_quantiles(spark, sf_dir):
    """Quantiles per label and day, from stored summaries per hour that are added up."""
    timed = events(spark, sf_dir).select(
        F.col("event_type").alias("label"), F.date_trunc("hour", "ts").alias("hour"), F.col("value").alias("seconds")
    )
    hourly = staged(quantiles.summarize(timed, ["label", "hour"]), "hourly")
    days = hourly.withColumn("day_us", F.unix_micros(F.date_trunc("day", "hour")))
    keys = ["label", "day_us"]
    return quantiles.quantiles(quantiles.merge(days, keys), keys, [0.0, 0.5, 0.95, 0.99, 1.0])


# The moment at which the sync latency below is taken, in epoch milliseconds.
LATENCY_MOMENT = 1_706_745_600_000


def sync_latency(spark, sf_dir):
    """Age of the written documents at a fixed moment, by operation."""
    state = fold.latest_per_id(changes(spark, sf_dir))
    observed = metrics.sync_latency(state, F.lit(LATENCY_MOMENT), "op")
    hours = [3600 * n for n in (1, 6, 24, 72, 168, 336, 720)]
    buckets = metrics.bucket_counts(observed, hours, "op")
    return buckets.select("label", "at", "observations")


def rates(spark, sf_dir, width_s, slide_s=None):
    found = metrics.windowed_rate(events(spark, sf_dir), "ts", "event_type", width_s, slide_s)
    return found.select(
        "label", micros("window_start", "window_us"), "events",
        F.round("per_second", 6).alias("per_second"),
    )


def rate_1m(spark, sf_dir):
    return rates(spark, sf_dir, 60)


def rate_5m_sliding(spark, sf_dir):
    return rates(spark, sf_dir, 300, 60)


def queries():
    return {
        "recent_changes": recent_changes,
        "repo_events_dedup": repo_events_dedup,
        "drop_reasons": drop_reasons,
        "edit_fold": edit_fold,
        "derive_changelog": derive_changelog,
        "changelog_parse": changelog_parse,
        "dead_letters": dead_letters,
        "collapse_latest": index_state,
        "index_state": merge_two_batches,
        "merge_report": merge_report,
        "live_docs": live_docs,
        "live_counts": live_counts,
        "filtered_docs": filtered_docs,
        "doc_lookup": doc_lookup,
        "replay_equals": replay_equals,
        "bootstrap_tail": bootstrap_tail,
        "live_events": live_events,
        "live_feed": live_feed,
        "counters_by_op": counters_by_op,
        "latency_histogram": latency_histogram,
        "latency_histograms": latency_histograms,
        "latency_quantiles": latency_quantiles,
        "daily_quantiles": daily_quantiles,
        "sync_latency": sync_latency,
        "rate_1m": rate_1m,
        "rate_5m_sliding": rate_5m_sliding,
    }


def oracle_sql():
    from tidemark.plans import oracle_feed as o

    return {
        "recent_changes": o.recent_changes(),
        "repo_events_dedup": o.repo_events(),
        "drop_reasons": o.drop_reasons(),
        "edit_fold": o.edit_fold(),
        "derive_changelog": o.derive_changelog(),
        "changelog_parse": o.changelog_parse(),
        "dead_letters": o.dead_letters(),
        "collapse_latest": o.index_state(),
        "index_state": o.index_state(),
        "merge_report": o.merge_report(),
        "live_docs": o.live_docs(),
        "live_counts": o.live_counts(),
        "filtered_docs": o.filtered_docs(),
        "doc_lookup": o.doc_lookup(),
        "replay_equals": o.index_state(),
        "bootstrap_tail": o.index_state(),
        "live_events": o.live_events(),
        "live_feed": o.live_feed(),
        "counters_by_op": o.counters(),
        "latency_histogram": o.latency_histogram(),
        "latency_histograms": o.latency_histograms(),
        "latency_quantiles": o.latency_quantiles(),
        "daily_quantiles": o.daily_quantiles(),
        "sync_latency": o.sync_latency(LATENCY_MOMENT),
        "rate_1m": o.rate_1m(),
        "rate_5m_sliding": o.rate_5m(),
    }
