import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import coercion
from tidemark.operators import edits, fold
from tidemark.operators.live import live_events
from tidemark.sources import changelog, recent_changes
from tidemark.sources.repo_events import read_repo_events

IMAGE = {
    "id": 42, "wiki": "enwiki", "title": "Alan Turing", "last_comment": "grammar", "namespace": 0,
    "is_bot": 0, "is_minor": 1, "edit_count": 3, "event_time": 1_700_000_000_000_000,
}
STAMP = 1_700_000_000_000


def messages(spark, values):
    rows = [(at, "k", v if v is None or isinstance(v, str) else json.dumps(v)) for at, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq bigint, key string, value string")


def change(op="c", **over):
    image = {**IMAGE, **over}
    before, after = (image, None) if op == "d" else (None, image)
    return {"op": op, "before": before, "after": after, "ts_ms": STAMP}


def test_create_and_delete(spark):
    good, bad = changelog.split_dead_letters(messages(spark, [change(), change("d"), {"payload": change("r")}]))
    rows = good.withColumn("us", F.unix_micros("event_time")).orderBy("seq").collect()
    assert bad.count() == 0
    assert [(r.op, r.deleted) for r in rows] == [("c", False), ("d", True), ("r", False)]
    first = rows[0]
    assert (first.id, first.version, first.is_bot, first.is_minor) == ("42", STAMP, False, True)
    assert first.us == 1_700_000_000_000_000


@pytest.mark.parametrize(
    "value, error",
    [
        ("{nope", "parse: invalid JSON"),
        ("", "parse: invalid JSON"),
        ("5", "parse: change is not an object"),
        ("[1]", "parse: change is not an object"),
        ({"payload": 3}, "parse: change is not an object"),
        (change("x"), "parse: unsupported op"),
        ({**change(), "op": None}, "parse: unsupported op"),
        ({**change(), "ts_ms": "soon"}, "parse: invalid ts_ms"),
        ({**change(), "after": {}}, "parse: missing row image"),
        ({**change(), "after": [1]}, "parse: row image is not an object"),
        (change(id=None), "parse: missing row id"),
        (change(title=5), "parse: invalid field"),
        (change(length_new=3.5), "parse: invalid field"),
        (change(namespace="x"), "parse: invalid field"),
    ],
)
def test_dead_letters(spark, value, error):
    good, bad = changelog.split_dead_letters(messages(spark, [value]))
    assert good.count() == 0
    row = bad.first()
    assert row.error == error
    if error == "parse: invalid JSON":
        assert json.loads(row.payload) == {"_raw": value}
    else:
        assert json.loads(row.payload) == (json.loads(value) if isinstance(value, str) else value)


def test_nothing_to_do(spark):
    good, bad = changelog.split_dead_letters(messages(spark, [None, "null", {"payload": None}]))
    assert good.count() == 0 and bad.count() == 0


def test_loose_values(spark):
    good, bad = changelog.split_dead_letters(
        messages(
            spark,
            [
                change(edit_count=0, is_bot="YES", is_minor=None, wiki=None, length_new="12", namespace="4"),
                change(event_time="2023-11-14T22:13:20Z", edit_count=None, is_bot=True, length_new=3.0),
                change(event_time=1_700_000_000, is_bot="off", title=None),
                change(event_time="garbage", is_bot=2),
            ],
        )
    )
    rows = good.withColumn("us", F.unix_micros("event_time")).orderBy("seq").collect()
    assert bad.count() == 0
    assert [r.edit_count for r in rows] == [1, 1, 3, 3]
    assert [r.is_bot for r in rows] == [True, True, False, True]
    assert [r.length_new for r in rows] == [12, 3, None, None]
    assert (rows[0].wiki, rows[0].namespace, rows[2].title) == ("", 4, "")
    assert [r.us for r in rows] == [1_700_000_000_000_000] * 3 + [None]


def log_of(spark, entries):
    rows = [(seq, op, i, version, op == "d") for seq, (op, i, version) in enumerate(entries)]
    return spark.createDataFrame(rows, "seq bigint, op string, id string, version bigint, deleted boolean")


def state_of(df):
    return {(r.id, r.version, r.deleted) for r in df.collect()}


def test_collapse(spark):
    recreated = fold.latest_per_id(log_of(spark, [("d", "1", 100), ("c", "1", 200)]))
    deleted = fold.latest_per_id(log_of(spark, [("u", "1", 100), ("d", "1", 200)]))
    tied = fold.latest_per_id(log_of(spark, [("u", "1", 100), ("d", "1", 100)]))
    assert state_of(recreated) == {("1", 200, False)}
    assert state_of(deleted) == {("1", 200, True)}
    assert state_of(tied) == {("1", 100, True)}


def test_any_split_any_replay_same_state(spark):
    rng = random.Random(3)
    entries = [(rng.choice("cud"), str(rng.randint(0, 9)), rng.randint(0, 20)) for _ in range(200)]
    log = log_of(spark, entries).cache()
    whole = state_of(fold.latest_per_id(log))
    for _ in range(3):
        cut = rng.randint(1, 199)
        state = fold.latest_per_id(log.where(F.col("seq") < cut))
        state = fold.merge(state, log.where(F.col("seq") >= cut))
        assert state_of(state) == whole
        assert state_of(fold.merge(state, log)) == whole
    # Without ties the order of arrival does not matter either.
    distinct = [("u", str(n % 7), n) for n in range(100)]
    shuffled = distinct[:]
    rng.shuffle(shuffled)
    assert state_of(fold.latest_per_id(log_of(spark, distinct))) == state_of(
        fold.latest_per_id(log_of(spark, shuffled))
    )


def test_merge_report(spark):
    stored = fold.latest_per_id(log_of(spark, [("c", "a", 5), ("c", "b", 5)]))
    incoming = log_of(spark, [("u", "a", 4), ("u", "b", 5), ("u", "c", 1)]).withColumn("seq", F.col("seq") + 9)
    row = fold.merge_report(stored, incoming).first()
    assert (row.written, row.skipped) == (2, 1)


def test_unknown_flag_counts_as_live(spark):
    df = spark.createDataFrame([("1", None), ("2", True), ("3", False)], "id string, deleted boolean")
    assert {r.id for r in fold.live(df).collect()} == {"1", "3"}


def test_vector_length_is_checked(spark):
    df = spark.createDataFrame([("1", [0.5, 0.5])], "id string, embedding array<float>")
    assert "summary" in fold.conform(df, 2).columns
    with pytest.raises(Exception, match="dimensions"):
        fold.conform(df, 3).collect()


def lines(spark, values):
    df = spark.createDataFrame([(at, v) for at, v in enumerate(values)], "seq bigint, value string")
    return df.withColumn("arrived_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))


def edit(title, **over):
    return json.dumps(
        {"type": "edit", "wiki": "enwiki", "title": title, "timestamp": 1_600_000_000, "user": "u", **over}
    )


def test_recent_changes(spark):
    raw = lines(
        spark,
        [
            edit("A", bot="false", minor=0, length={"new": 7}, meta={"uri": "http://u"}, title_url="http://t"),
            edit("B", timestamp=None, meta={"dt": "2020-01-01T00:00:00Z"}),
            edit("C", timestamp=None, wiki="dewiki"),
            "", "{", "[]", edit(""), edit("D", type="other"), edit(5),
        ],
    )
    reasons = [r.drop_reason for r in recent_changes.classify_recent_changes(raw, ["enwiki"]).orderBy("seq").collect()]
    assert reasons == [None, None, "wiki", "empty", "malformed", "not an object", "no title", "type", "invalid"]
    kept = recent_changes.read_recent_changes(raw)
    rows = kept.withColumn("s", F.unix_seconds("event_time")).orderBy("seq").collect()
    assert [r.s for r in rows] == [1_600_000_000, 1_577_836_800, 1_700_000_002]
    assert (rows[0].is_bot, rows[0].is_minor, rows[0].length_new, rows[0].title_url) == (True, False, 7, "http://u")


def test_repo_events_keep_first_arrival(spark):
    event = {"id": "1", "type": "PushEvent", "repo": {"name": "o/r"}, "created_at": "2020-01-01T00:00:00Z"}
    raw = lines(spark, [json.dumps(event), json.dumps({**event, "type": "Late"}), json.dumps({**event, "id": None}), json.dumps({**event, "id": "2", "repo": None})])
    rows = read_repo_events(raw).collect()
    assert [(r.title, r.event_type, r.seq) for r in rows] == [("o/r", "PushEvent", 0)]


def test_page_fold_and_changelog_agree(spark):
    rng = random.Random(5)
    names = ["Foo", "fóo ", "FOO", "Bar", "bár", "x" * 191 + "a", "x" * 191 + "b"]
    raw = lines(spark, [edit(rng.choice(names), comment=rng.choice(["", "c1", "c2"]), namespace=rng.choice([0, 1])) for _ in range(120)])
    found = recent_changes.read_recent_changes(raw).cache()
    pages = edits.fold_edits(found).cache()
    assert pages.count() == 3
    # Folding in two stretches gives the same pages.
    early = edits.fold_edits(found.where("seq < 40"))
    assert sorted(map(str, edits.fold_edits(found.where("seq >= 40"), early).collect())) == sorted(
        map(str, pages.collect())
    )
    # Dividing every history into small parts changes nothing.
    whole = edits.derive_changelog(found).cache()
    parted = edits.derive_changelog(found, part_positions=7)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parted.collect()))
    # The derived log, read back as a change feed, folds to the same pages.
    good, bad = changelog.split_dead_letters(edits.changelog_messages(whole))
    assert bad.count() == 0
    columns = ["id", "wiki", "title", "last_comment", "last_user", "namespace", "edit_count", "event_time"]
    state = fold.latest_per_id(good).select(columns)
    assert sorted(map(str, state.collect())) == sorted(map(str, pages.select(columns).collect()))


def test_too_wide_edits_are_set_aside(spark):
    raw = lines(spark, [edit("A"), edit("B", user="u" * 300)])
    good, bad = edits.split_too_wide(recent_changes.read_recent_changes(raw))
    assert [r.title for r in good.collect()] == ["A"]
    assert [(r.title, r.error) for r in bad.collect()] == [("B", "write: value too long")]


def test_live_events_validate_nothing(spark):
    rows = live_events(
        messages(spark, [change("x", id=None), {"payload": None}, "nope", None, {"payload": change("d")}, "7"])
    ).orderBy("seq").collect()
    assert [(r.op, r.id, r.title) for r in rows] == [("x", "None", "Alan Turing"), ("d", "42", "Alan Turing")]


def test_exact_medians(spark):
    """Between the middle values, equal ones counted; nulls are no values."""
    from tidemark.operators.quantiles import exact_median

    values = {"odd": [3.0, 1.0, 2.0], "even": [4.0, 1.0, 1.0, 2.0], "same": [5.0] * 6, "one": [7.25, None]}
    rows = spark.createDataFrame([(k, v) for k, found in values.items() for v in found], "k string, v double")
    found = {r.k: r.exact_median for r in exact_median(rows, "k", "v").collect()}
    assert found == {"odd": 2.0, "even": 1.5, "same": 5.0, "one": 7.25}


ODD = [
    '{"op":"c","ts_ms":1,"after":{"id":1}} x', '{"op":"c","ts_ms":NaN,"after":{"id":1}}',
    '{"op":"c","ts_ms":-0,"after":{"id":-0}}', '{"op":"c","ts_ms":123456789012345678901,"after":{"id":1}}',
    '{"op":"c","op":"u","ts_ms":1,"after":{"id":1,"id":2}}', '{"op":"c","after":{"id":{"a":1},"title":"x"}}',
    '{"op":"c","ts_ms":1.50,"after":{"id":1.50,"length_new":2.0}}', '{"op":"d","before":{"id":true,"title":"\\u00e9"}}',
    '{"payload":{"op":"c","after":{"id":"a","x":{"y":[1]}}}}', '{"payload":{"op":"c"},"op":"d","before":{"id":7}}',
    '{"payload":null}', '{"op":"c","after":{}}', '{"op":"d","after":{"id":1}}', "", "null", "[]", "{}",
    '{"op":"c","after":{"id":"a\tb"}}', '{"op":"c","after":{"id":"None"}}', "{'op':1}",
    '{"op":"c","after":{"id":false,"is_bot":"T","is_minor":0,"namespace":"4 ","edit_count":-3}}',
    '{"op":"c","after":' + '{"id":' * 600 + "1" + "}" * 600 + "}", '{"op":"c","after":{"id":1,"title":"' + "y" * 60_000 + '"}}',
]
LINES = [
    '{"type":"edit","title":"a","meta":{},"length":{}}', '{"type":"edit","title":"a","meta":[],"length":0}',
    '{"type":"edit","title":"a","meta":{"uri":{"a":1},"dt":[]},"length":{"new":"7"}}',
    '{"type":"log","title":"b","meta":{"uri":"u","dt":"2020-01-01T00:00:00Z"},"length":{"new":true},"bot":"x"}',
    '{"type":"new","title":"c","length":{"new":4.0},"timestamp":12}', '{"type":{},"title":"x"}', "{", "[1]", "",
]


def test_plain_messages_read_like_variants(spark, monkeypatch):
    """Messages read from their bytes give what the same messages read as variants give."""
    sent = messages(spark, [*ODD, change(), change("d"), {"payload": change("r")}, change(title=5)])
    raw = messages(spark, LINES).withColumn("arrived_at", F.timestamp_micros(F.lit(0)))

    def rows():
        parsed = changelog.parse_changelog(sent).withColumn("message", F.to_json("message"))
        edits_of = recent_changes.classify_recent_changes(raw)
        return [found.orderBy("seq").collect() for found in (parsed, edits_of)]

    found = rows()
    monkeypatch.setattr(changelog, "find_change", lambda message: None)
    monkeypatch.setattr(recent_changes, "find_edit", lambda event: None)
    assert rows() == found


def test_plain_messages_need_no_variant(spark):
    sent = messages(spark, [change(), change("d"), {"payload": change("r")}, change(id=1.5), change(id=[1]), "{", "5"])
    read = coercion.with_plain(sent, ["op", "ts_ms", *changelog.ROW_NAMES], changelog.find_change)
    assert [row.plain for row in read.orderBy("seq").collect()] == [True] * 3 + [False] * 4


def test_derived_log_parses_lines_once(spark):
    """The operator's two looks at its edits are at stored ones."""
    raw = messages(spark, [json.dumps({"type": "edit", "title": t, "wiki": "w"}) for t in "aba"])
    raw = raw.withColumn("arrived_at", F.timestamp_micros(F.lit(0)))
    log = edits.derive_changelog(recent_changes.read_recent_changes(raw))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "MapInArrow" not in plan
    assert [(r.op, r.after.edit_count) for r in log.orderBy("seq").collect()] == [("c", 1), ("c", 1), ("u", 2)]
