import json

import pytest
from pyspark.sql import functions as F

from tidemark.session import staging_dir
from tidemark.sources.changelog import file_messages
from tidemark.streaming import jobs
from tidemark.streaming.store import BatchTable, DocumentStore, finished


def change(op, ident, version, title="A page", comment="c"):
    image = {"id": ident, "wiki": "enwiki", "title": title, "last_comment": comment, "namespace": 0}
    before, after = (image, None) if op == "d" else (None, image)
    return json.dumps({"op": op, "before": before, "after": after, "ts_ms": version})


def land(spark, path, first_seq, values):
    rows = [(first_seq + at, "k", v) for at, v in enumerate(values)]
    df = spark.createDataFrame(rows, "seq bigint, key string, value string")
    df.coalesce(1).write.mode("append").parquet(path)


def run(spark, path, store, checkpoint):
    jobs.sync_changes(file_messages(spark, path, 1), store, checkpoint, None).awaitTermination()


def state(spark, store):
    return {r.id: (r.version, r.deleted, r.summary) for r in store.state(spark).collect()}


def test_sync_late_data_replay_compaction_and_enrichment(spark):
    path, root = staging_dir(spark, "in"), staging_dir(spark, "store")
    checkpoint, store = staging_dir(spark, "offsets"), DocumentStore(root, 32)
    land(spark, path, 0, [change("c", 1, 100), change("c", 2, 100), "broken", None])
    run(spark, path, store, checkpoint)
    land(spark, path, 10, [change("u", 1, 50), change("d", 2, 300), change("c", 3, 10)])
    run(spark, path, store, checkpoint)
    want = {"1": (100, False, None), "2": (300, True, None), "3": (10, False, None)}
    assert state(spark, store) == want
    assert store.dead_letters.parts(spark).count() == 1
    vectors = {r.id: r.embedding for r in store.state(spark).collect()}
    assert vectors["2"] is None and len(vectors["1"]) == 32

    # A repeated batch overwrites itself.
    from tidemark.sources.changelog import split_dead_letters

    again = spark.read.parquet(path).where("seq < 10")
    own = jobs.run_of(checkpoint)(spark)
    store.write_changes(split_dead_letters(again)[0], 0, own)
    assert state(spark, store) == want
    assert store.docs.parts(spark).count() == 5

    # A rebuild from the beginning gives the same state.
    fresh = DocumentStore(staging_dir(spark, "rebuilt"), 32)
    run(spark, path, fresh, staging_dir(spark, "offsets"))
    assert state(spark, fresh) == want

    store.compact(spark)
    assert store.docs.parts(spark).count() == 3
    assert state(spark, store) == want

    summaries = spark.createDataFrame(
        [("enwiki", "A page", "standard", " About it ", None)],
        "wiki string, title string, type string, extract string, description string",
    )
    store.enrich(spark, summaries)
    assert state(spark, store)["1"] == (100, False, "About it")
    before = state(spark, store)
    store.enrich(spark, summaries)  # nothing left to enrich
    assert state(spark, store) == before

    # A newer edit replaces the whole document, summary included.
    land(spark, path, 20, [change("u", 1, 400, comment="newer")])
    run(spark, path, store, checkpoint)
    assert state(spark, store)["1"] == (400, False, None)
    assert state(spark, store)["3"] == (10, False, "About it")


def test_failed_batch_is_repeated(spark):
    path, checkpoint = staging_dir(spark, "in"), staging_dir(spark, "offsets")
    land(spark, path, 0, [change("c", 1, 1), change("c", 2, 1)])

    class Failing(DocumentStore):
        def write_changes(self, changes, batch_id, run):
            raise RuntimeError("storage is away")

    root = staging_dir(spark, "store")
    with pytest.raises(Exception, match="storage is away"):
        run(spark, path, Failing(root, 8), checkpoint)
    store = DocumentStore(root, 8)
    assert state(spark, store) == {}
    run(spark, path, store, checkpoint)
    assert set(state(spark, store)) == {"1", "2"}


def test_rates_drop_what_is_too_late_only_when_asked(spark):
    path = staging_dir(spark, "events")
    schema = "at bigint, label string"
    for at in (0, 3600, 3700, 10):  # the last file is an hour late
        rows = spark.createDataFrame([(at, "x")], schema)
        rows.withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(path)
    found = {}
    for lateness in (None, "1 minute"):
        out = staging_dir(spark, "rates")
        events = spark.readStream.schema("at bigint, label string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        jobs.stream_rates(
            events, out, staging_dir(spark, "offsets"), time="ts", label="label", width_s=60,
            lateness=lateness, seconds=None,
        ).awaitTermination()
        rows = jobs.read_rates(spark, out).collect()
        found[lateness] = sorted(r.events for r in rows)
    assert found[None] == [1, 1, 2]
    assert found["1 minute"] == [1, 1, 1]


def test_a_batch_that_lands_while_compacting_is_kept(spark, tmp_path):
    table = BatchTable(str(tmp_path / "t"), "id STRING, version BIGINT")
    row = lambda name: spark.createDataFrame([(name, 1)], table.schema)
    found = lambda: sorted(r.id for r in table.parts(spark).collect())
    table.write_batch(row("1"), 0)
    cut = table.cut(spark)
    state = table.parts(spark, cut)
    table.write_batch(row("2"), 1)
    table.snapshot(state, cut)
    assert found() == ["1", "2"]

    # A snapshot that is not published, and a batch that is not finished, are not looked at.
    row("half").write.parquet(f"{table.path}/snapshots/number=1")
    row("half").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(table.batch_path("main", 2))
    assert found() == ["1", "2"]

    # What goes is what two snapshots cover.
    table.snapshot(table.parts(spark), table.cut(spark))
    table.expire(spark)
    assert found() == ["1", "2"] and finished(spark, f"{table.path}/log", "run", "batch_id") == [("main", "1")]
    table.snapshot(table.parts(spark), table.cut(spark))
    table.expire(spark)
    assert found() == ["1", "2"] and table.snapshots(spark) == [1, 2]


def test_replay_into_a_compacted_store_adds_what_is_missing(spark):
    path, store = staging_dir(spark, "in"), DocumentStore(staging_dir(spark, "store"), 8)
    land(spark, path, 0, [change("c", 1, 100), change("c", 2, 100)])
    checkpoint = staging_dir(spark, "offsets")
    run(spark, path, store, checkpoint)
    land(spark, path, 10, [change("u", 1, 200)])
    run(spark, path, store, checkpoint)
    store.compact(spark)
    other = staging_dir(spark, "other")
    land(spark, other, 0, [change("u", 2, 300), change("c", 3, 5)])
    run(spark, other, store, staging_dir(spark, "offsets"))
    want = {"1": (200, False, None), "2": (300, False, None), "3": (5, False, None)}
    assert state(spark, store) == want
    # Enrichment is part of the next snapshot.
    summaries = spark.createDataFrame(
        [("enwiki", "A page", "standard", "About it", None)],
        "wiki string, title string, type string, extract string, description string",
    )
    store.enrich(spark, summaries)
    store.compact(spark)
    assert store.docs.parts(spark).count() == 3
    assert {s for _, _, s in state(spark, store).values()} == {"About it"}
    run(spark, path, store, staging_dir(spark, "offsets"))
    assert {k: v[0] for k, v in state(spark, store).items()} == {k: v[0] for k, v in want.items()}


LOG = "seq bigint, partition int, offset bigint, key string, value string"


def test_handoff_from_snapshot_to_stream(spark):
    from tidemark.operators import fold
    from tidemark.sources.changelog import split_dead_letters
    from tidemark.streaming.handoff import Handoff, high_water

    before = [(0, 0, 10, "1", change("c", 1, 100)), (1, 1, 5, "2", change("c", 2, 100)), (2, 0, 11, "4", change("c", 4, 90))]
    # Between the marks and the read of the source; the snapshot shows them.
    inside = [(3, 0, 12, "1", change("u", 1, 200, comment="inside")), (4, 1, 6, "2", change("d", 2, 210))]
    # Changes, a late one, a row that comes back, and a partition that is new.
    after = [
        (5, 0, 13, "1", change("u", 1, 150, comment="late")), (6, 1, 7, "2", change("c", 2, 300)),
        (7, 2, 0, "3", change("c", 3, 50)), (8, 0, 14, "4", change("u", 4, 400, comment="after")),
    ]
    log = spark.createDataFrame(before, LOG)
    store = DocumentStore(staging_dir(spark, "store"), 8)
    handoff = Handoff(staging_dir(spark, "handoff"), store)
    with pytest.raises(ValueError):
        handoff.load(log)
    handoff.begin(log)
    source = split_dead_letters(spark.createDataFrame(before + inside, LOG))[0]
    handoff.load(fold.latest_per_id(source))
    # A start that is repeated keeps its marks and replaces its snapshot.
    handoff.begin(spark.createDataFrame(before + inside, LOG))
    handoff.load(fold.latest_per_id(source))
    assert {r.partition: r.upto for r in handoff.marks(spark).collect()} == {0: 11, 1: 5}
    assert store.docs.parts(spark).count() == 3
    assert json.loads(handoff.starting_offsets(spark, "t", 3)) == {"t": {"0": 12, "1": 6, "2": -2}}

    path = staging_dir(spark, "in")
    spark.createDataFrame(before + inside + after, LOG).write.parquet(path)
    everything = spark.createDataFrame(before + inside + after, LOG)
    assert {r.seq for r in handoff.tail(everything).collect()} == {3, 4, 5, 6, 7, 8}
    messages = spark.readStream.schema(LOG).parquet(path)
    jobs.sync_changes(handoff.tail(messages), store, staging_dir(spark, "offsets"), None).awaitTermination()
    got = {r.id: (r.version, r.deleted, r.last_comment) for r in store.state(spark).collect()}
    whole = fold.source_form(fold.latest_per_id(split_dead_letters(everything)[0]))
    assert got == {r.id: (r.version, r.deleted, r.last_comment) for r in whole.collect()}
    assert got["1"] == (200, False, "inside") and got["2"][0] == 300 and got["4"][2] == "after"
    assert high_water(log.where("false")).count() == 0


def test_summaries_as_a_stream(spark):
    store = DocumentStore(staging_dir(spark, "store"), 8)
    known = BatchTable(staging_dir(spark, "known"), jobs.SUMMARY)
    path, checkpoint, inbox = staging_dir(spark, "summaries"), staging_dir(spark, "offsets"), staging_dir(spark, "in")

    def summary(title, text, kind="standard"):
        spark.createDataFrame([("enwiki", title, kind, text, None)], jobs.SUMMARY).coalesce(1).write.mode("append").parquet(path)

    def enrich():
        found = spark.readStream.schema(jobs.SUMMARY).parquet(path)
        jobs.enrich_documents(found, store, known, checkpoint, None).awaitTermination()

    def sync(first_seq, *values):
        land(spark, inbox, first_seq, values)
        run(spark, inbox, store, inbox + "-offsets")

    sync(0, change("c", 1, 10, "One"), change("c", 2, 10, "Two"))
    summary("One", "About one"), summary("Three", "About three")
    enrich()
    sync(10, change("c", 3, 10, "Three"), change("u", 1, 20, "One", "newer"))
    assert state(spark, store) == {"1": (20, False, None), "2": (10, False, None), "3": (10, False, None)}
    # The next records bring those of before to documents that came, or were replaced, since.
    summary("Two", None, "no-extract"), summary("Two", "About two")
    enrich()
    want = {"1": (20, False, "About one"), "2": (10, False, "About two"), "3": (10, False, "About three")}
    assert state(spark, store) == want
    # A summary stays, and a batch that is repeated writes nothing.
    summary("One", "A", "standard")
    enrich()
    parts = store.docs.parts(spark).count()
    own = f"enrichment-{jobs.run_of(checkpoint)(spark)}"
    store.enrich(spark, known.parts(spark), (own, 1))
    assert state(spark, store) == want and store.docs.parts(spark).count() == parts
