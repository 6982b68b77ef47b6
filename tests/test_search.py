import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.vectors import hash_embedding
from tidemark.operators import evaluate, index, lexical, nearest, neighbours, search
from tidemark.operators.metrics import HISTOGRAMS, bucket_counts, bucket_quantiles, histograms
from tidemark.session import equi_join, hot_key_join


def ranked(spark, ids, query="q"):
    rows = [(query, i, at + 1, 1000 - at) for at, i in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id string, id string, rank int, units bigint")


def request(spark, query="anything", mode="hybrid", size=10):
    return spark.createDataFrame([("q", query, mode, size)], "query_id string, query string, mode string, size int")


def test_fusion_golden_values(spark):
    hits = search.fuse(ranked(spark, "ABC"), ranked(spark, "DBE"), request(spark), 1)
    got = {r.id: r for r in hits.collect()}
    assert got["B"].position == 1 and (got["B"].bm25_rank, got["B"].knn_rank) == (2, 2)
    assert [got[i].score for i in "BAD"] == [0.034016, 0.023958, 0.010625]
    assert got["A"].knn_rank is None


def test_single_retriever_keeps_its_score(spark):
    empty = ranked(spark, "")
    hits = search.fuse(ranked(spark, "AB"), empty, request(spark, mode="bm25", size=1), 1).collect()
    assert [(h.id, h.score, h.bm25_rank, h.knn_rank) for h in hits] == [("A", 1e-06, 1, None)]


@pytest.mark.parametrize(
    "query, want",
    [
        ("Alan Turing", (1.25, 0.75)),
        ('"a quoted phrase of many words here"', (1.25, 0.75)),
        ("Some Title Words in lower case here", (1.25, 0.75)),
        ("who wrote the first computer program in the nineteenth century", (0.85, 1.2)),
        ("four plain lower words", (1.0, 1.0)),
    ],
)
def test_weights(spark, query, want):
    a, b = search.query_weights(F.col("query"), 1.0, 1.0)
    row = request(spark, query).select(a.alias("a"), b.alias("b")).first()
    assert (row.a, row.b) == pytest.approx(want)


def test_admission(spark):
    df = spark.createDataFrame(
        [("a", " ", 5, 0), ("b", "x", 0, -1), ("c", "x", 99, 3)], "query_id string, query string, size int, namespace int"
    )
    got = {r.query_id: (r.size, r.namespace, r.mode) for r in search.admit(df).collect()}
    assert got == {"b": (1, None, "hybrid"), "c": (50, 3, "hybrid")}


def edits_apart(a, b):
    """Distance with exchanges, by the full table."""
    big = len(a) + len(b)
    last = {}
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), seen
            cost = 0 if a[i - 1] == b[j - 1] else 1
            seen = j if cost == 0 else seen
            d[i, j] = min(
                d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1,
                d[i1 - 1, j1 - 1] + (i - i1 - 1) + 1 + (j - j1 - 1),
            )
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_spelling_candidates_against_all_pairs(spark):
    rng = random.Random(1)
    made = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(250)}
    terms = spark.createDataFrame([(f"t:{w}", 1) for w in made], "term string, df bigint")
    wanted = sorted(made)[::5]
    asked = spark.createDataFrame([(w,) for w in wanted], "q_term string")
    want = set()
    for q in wanted:
        allowed = 0 if len(q) < 3 else 1 if len(q) <= 5 else 2
        near = [(1 - edits_apart(q, w) / min(len(q), len(w)), w) for w in made if edits_apart(q, w) <= allowed]
        want |= {(q, f"t:{w}") for _, w in sorted(near, key=lambda p: (-p[0], p[1]))[:50]}
    for bound in (10**6, 0):  # broadcast, and divided by salt
        got = {(r.q_term, r.term) for r in lexical.spellings(asked, terms, bound).collect()}
        assert got == want


def test_stored_neighbourhoods_give_all_pairs(spark, tmp_path):
    """Words of up to, about and beyond the longest stored length."""
    rng = random.Random(3)
    made = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(150)}
    for length in range(neighbours.LONGEST_STORED - 2, neighbours.LONGEST_STORED + 4):
        word = "".join(rng.choice("abcdefgh") for _ in range(length))
        made |= {word, word[1:], word[2:], word[1] + word[0] + word[2:], word + "x", word[3:]}
    terms = spark.createDataFrame([(f"{tag}:{w}", 1) for w in made for tag in "tc"], "term string, df bigint")
    folders = neighbours.write_neighbours(terms, f"{tmp_path}/neighbours")
    table = spark.read.schema(f"{neighbours.NEIGHBOUR}, bucket int").parquet(f"{tmp_path}/neighbours")
    kept = {w for w in made if len(w) <= neighbours.LONGEST_STORED}
    assert {r.word for r in table.select("word").distinct().collect()} == kept
    assert table.count() == table.distinct().count()
    for wanted in (sorted(made), sorted(made, key=len)[-5:], sorted(made)[:1], ["unknownword"], []):
        asked = spark.createDataFrame([(w,) for w in wanted], "q_term string")
        plain = lexical.spellings(asked, terms, most=None).collect()
        stored = lexical.spellings(asked, terms, most=None, stored=(table, folders)).collect()
        assert sorted(plain) == sorted(stored)
    long = sorted(made, key=len)[-20:]
    asked = spark.createDataFrame([(w,) for w in long], "q_term string")
    got = {(r.q_term, r.term[2:]) for r in lexical.spellings(asked, terms, most=None, stored=(table, folders)).collect()}
    assert got == {(q, w) for q in long for w in made if edits_apart(q, w) <= 2}
    probes = spark.createDataFrame([("a",)], "member string")
    opened = neighbours.members_of(table, folders, probes)
    assert len({r.bucket for r in opened.select("bucket").distinct().collect()}) <= 1
    none = terms.where("false")
    assert neighbours.write_neighbours(none, f"{tmp_path}/none") == neighbours.FEWEST


DOCS = "id string, wiki string, title string, summary string, last_comment string, namespace int, deleted boolean, version bigint"


def make_docs(spark, n=120):
    rng = random.Random(11)
    vocabulary = ["the", "of", "alpha", "beta", "gamma", "delta", "omega", "river", "stone", "cloud"]
    weights = [30, 20, 5, 5, 4, 4, 3, 2, 2, 1]

    def words(n):
        return " ".join(rng.choices(vocabulary, weights, k=n))

    rows = [
        (str(i), rng.choice(["enwiki", "dewiki"]), words(4), rng.choice([None, words(20)]), words(5), i % 2, i % 11 == 0, i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, DOCS).withColumns(
        {
            "title_url": F.lit(None).cast("string"), "event_time": F.timestamp_seconds(F.col("version")),
            "last_user": F.lit("u"),
        }
    )


QUERIES = [
    ("q1", "alpha", "hybrid", 10, None, None), ("q2", "river stone", "bm25", 20, "enwiki", 0),
    ("q3", "the of alpha", "hybrid", 50, None, 1), ("q4", "alpha beta gamma delta the the", "hybrid", 50, None, None),
    ("q5", "the", "vector", 50, None, None), ("q6", "the of the of beta", "vector", 5, "dewiki", None), ("q7", "zzz qqq", "hybrid", 5, None, None),
]


def requests(spark):
    return spark.createDataFrame(
        [(*q[:5], -1 if q[5] is None else q[5]) for q in QUERIES],
        "query_id string, query string, mode string, size int, wiki string, namespace int",
    )


@pytest.fixture(scope="module")
def built(spark):
    return index.build_index(make_docs(spark), dims=384)


def test_blocks_and_salts_change_nothing(spark, built):
    whole = sorted(map(tuple, search.search(requests(spark), built, floor=0.6).collect()))
    divided = search.search(
        requests(spark), built, floor=0.6, max_broadcast_rows=0, max_query_block=2, doc_block=16
    )
    assert whole and sorted(map(tuple, divided.collect())) == whole


def test_bm25_against_plain_computation(spark, built):
    import math

    docs = {r.id: r for r in make_docs(spark).collect()}
    text = {i: {"t": r.title.split(), "s": (r.summary or "").split(), "c": r.last_comment.split()} for i, r in docs.items()}
    boost = {"t": 4.0, "s": 2.0, "c": 1.0}
    query, terms = QUERIES[3][1], QUERIES[3][1].split()
    needed = math.floor(0.6 * len(terms))
    want = {}
    for field in "tsc":
        lengths = [len(t[field]) for t in text.values() if t[field]]
        mean = sum(lengths) / len(lengths)
        df = {w: sum(w in t[field] for t in text.values()) for w in terms}
        idf = {w: math.log(1 + (len(lengths) - df[w] + 0.5) / (df[w] + 0.5)) for w in terms}
        for i, r in docs.items():
            body = text[i][field]
            hit = [w for w in terms if w in body]
            if r.deleted or len(hit) < needed:
                continue
            norm = 1.2 * (0.25 + 0.75 * len(body) / mean)
            score = sum(boost[field] * idf[w] * body.count(w) * 2.2 / (body.count(w) + norm) for w in hit)
            want[i] = max(want.get(i, 0), score)
    asked = request(spark, query, "bm25", 50).withColumn("namespace", F.lit(-1))
    got = {r.id: r.score for r in search.search(asked, built).collect()}
    top = sorted(want.values(), reverse=True)[:50]
    assert sorted(got.values(), reverse=True) == pytest.approx(top, abs=1e-5)
    assert got == pytest.approx({i: want[i] for i in got}, abs=1e-5)


def test_nearest_against_column_cosine(spark, built):
    from tidemark.functions.vectors import cosine, cosine_score

    asked = search.admit(requests(spark).withColumn("mode", F.lit("vector")))
    vectors = nearest.embed_queries(asked, 7).cache()
    found = nearest.nearest(vectors, built.docs, 5, None, 7, built.documents)
    got = {(r.query_id, r.id): r.units for r in lexical.top_per_query(found, 5).collect()}
    d = built.docs.where("not deleted").select("id", F.col("wiki").alias("w"), F.col("namespace").alias("n"), F.col("embedding").alias("e"))
    pairs = vectors.join(d, (F.col("wiki").isNull() | (F.col("wiki") == F.col("w"))) & (F.col("namespace").isNull() | (F.col("namespace") == F.col("n"))))
    score = F.round(cosine_score(cosine(F.col("embedding"), F.col("e"))) * 1e9).cast("bigint")
    want = lexical.top_per_query(pairs.select("query_id", "id", score.alias("units")).where("units is not null"), 5)
    assert got == {(r.query_id, r.id): r.units for r in want.collect()}


def test_model_vectors(spark):
    def make_provider():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = index.embed_with(make_docs(spark, 12), make_provider, 2).collect()
    assert all((r.embedding is None) == r.deleted for r in rows)
    with pytest.raises(Exception, match="expected 3"):
        index.embed_with(make_docs(spark, 12), make_provider, 3).collect()


def test_query_vectors_of_another_provider(spark, built):
    asked = request(spark, "alpha", "vector").withColumn("namespace", F.lit(-1))
    vectors = spark.range(1).select(F.lit("q").alias("query_id"), hash_embedding(F.lit("river")).alias("embedding"))
    own = search.search(request(spark, "river", "vector").withColumn("namespace", F.lit(-1)), built)
    other = search.search(asked, built, query_vectors=vectors)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, other.collect()))


def test_joins_survive_hot_keys(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(map(tuple, big.join(small, "k").collect()))
    salted = equi_join(big, small, ["k"], spread=F.col("id"), small_rows=500, max_broadcast_rows=10)
    assert sorted(map(tuple, salted.collect())) == want
    assert sorted(map(tuple, hot_key_join(big, small, ["k"], hot_rows=100).collect())) == want


def test_documents_stay_in_place(spark, built):
    """Within the bounds no exchange lies between the index scan and the scoring task."""
    found = lexical.bm25_matches(search.admit(requests(spark)), built, 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    scan = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "embedding" not in scan


def test_cases(spark):
    cases = spark.createDataFrame(
        [("e", True, None, None, 0), ("n", False, 0, None, 1), ("r", False, None, ["(?i)climate", "heat"], 1), ("m", False, None, None, 2)],
        "case_id string, expect_empty boolean, expect_namespace int, title_patterns array<string>, min_hits int",
    )
    hits = spark.createDataFrame(
        [("n", 1, "A", 0), ("n", 2, "B", 1), ("r", 1, "The Climate", 0), ("m", 1, "X", 0), ("m", 6, "Y", 0)],
        "query_id string, position int, title string, namespace int",
    )
    got = {r.case_id: r.ok for r in evaluate.check_cases(cases, hits).collect()}
    assert got == {"e": True, "n": False, "r": True, "m": False}
    own = F.when(F.col("case_id") == "e", F.array(F.lit("Help:")))
    rows = evaluate.check_cases(cases.withColumn("forbidden_prefixes", own), hits).collect()
    assert {r.case_id: r.ok for r in rows} == got


def test_histograms_by_metric(spark):
    rows = [("sync", "a", 0.05), ("sync", "a", 7.0), ("sync", "b", 99.0), ("search", "a", 0.004), ("other", "a", 1.0), ("sync", "a", None)]
    found = {(r.metric, r.label, r.le): r.observations for r in histograms(spark.createDataFrame(rows, "metric string, label string, seconds double")).collect()}
    assert len(found) == 2 * (len(HISTOGRAMS["sync"]) + 1) + len(HISTOGRAMS["search"]) + 1
    for metric, label, le in found:
        assert found[metric, label, le] == sum(m == metric and g == label and s is not None and s <= le for m, g, s in rows)
    assert histograms(spark.createDataFrame([], "metric string, label string, seconds double")).count() == 0


def test_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in (0.2, 0.4, 0.6, 0.8, 99.0)], "label string, seconds double")
    buckets = bucket_counts(df, [0.5, 1.0])
    got = {r["quantile"]: r.seconds for r in bucket_quantiles(buckets, [0.2, 0.6, 0.99]).collect()}
    assert got == pytest.approx({0.2: 0.25, 0.6: 0.75, 0.99: 1.0})


def test_a_record_without_text_never_wins(spark):
    from tidemark.operators.enrich import summary_text

    schema = "wiki string, title string, type string, extract string, description string"
    rows = [("enwiki", "A", None, None, None), ("enwiki", "A", "standard", "Good text.", None)]
    summaries = spark.createDataFrame(rows, schema)
    text = summary_text(F.col("type"), F.col("extract"), F.col("description"))
    assert [r[0] for r in summaries.select(text).collect()] == [None, "Good text."]


def test_summaries_of_values_add_up(spark):
    from tidemark.operators.quantiles import merge, quantiles, summarize

    wanted = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    rows = spark.range(20_000).selectExpr(
        "concat('k', id % 3) AS label", "id % 7 AS part", "exp((id * 7919 % 10007) / 900.0 - 6) AS seconds"
    )
    merged = merge(summarize(rows, ["label", "part"]), ["label"])
    got = {(r.label, r["quantile"]): r for r in quantiles(merged, ["label"], wanted).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r.label, []).append(r.seconds)
    assert len(got) == 3 * len(wanted)
    for label, numbers in values.items():
        numbers.sort()
        for q in wanted:
            exact = numbers[max(0, math.ceil(q * len(numbers)) - 1)]
            assert abs(got[label, q].seconds - exact) <= exact / 2**7 + 1e-6
            assert got[label, q].observations == len(numbers)
    whole = summarize(rows, ["label"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.select(*whole.columns).collect()))

    odd = spark.createDataFrame(
        [("a", None), ("a", float("nan")), ("b", -3.0), ("b", 0.0), ("b", 0.000127), ("c", float("inf")), (None, 2.0)],
        "label string, seconds double",
    )
    got = {(r.label, r["quantile"]): r.seconds for r in quantiles(summarize(odd, ["label"]), ["label"], [0.0, 1.0]).collect()}
    assert got["b", 0.0] == 0.0 and got["b", 1.0] == 0.000127 and ("a", 0.0) not in got
    assert got["c", 1.0] >= 2.0**62 / 1e6 and got[None, 0.0] == pytest.approx(2.0, rel=2**-7)
    assert quantiles(summarize(odd.where("false"), ["label"]), ["label"], [0.5]).count() == 0


def test_dictionary_joins_repeat_nothing_beyond_the_bound(spark):
    """The dictionary has a row per term: the asked side is neither sent whole nor repeated."""
    from tidemark.operators.lexical import term_join

    terms = spark.createDataFrame([(f"t:{n}", n) for n in range(50)], "term string, df int")
    asked = spark.createDataFrame([(str(n), f"t:{n % 60}") for n in range(600)], "query_id string, term string")
    sent, dealt = term_join(terms, asked, 600, 600), term_join(terms, asked, 600, 599)
    assert sorted(sent.select("query_id", "df").collect()) == sorted(dealt.select("query_id", "df").collect())
    assert "explode" not in dealt._jdf.queryExecution().optimizedPlan().toString().lower()


def test_query_vectors_are_made_without_a_join(spark):
    from tidemark.operators.nearest import embed_queries

    asked = spark.createDataFrame([("a", " Red fox "), ("b", "red fox"), ("c", "blue")], "query_id string, query string")
    found = embed_queries(asked, 3)
    assert "join" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    vectors = {r.query_id: r.embedding for r in found.collect()}
    assert vectors["a"] == vectors["b"] != vectors["c"]


def test_a_large_dictionary_grows_its_neighbourhoods_when_asked(spark, tmp_path):
    rng = random.Random(5)
    made = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(150)}
    terms = spark.createDataFrame([(f"t:{w}", 1) for w in made], "term string, df bigint")
    assert neighbours.write_neighbours(terms, f"{tmp_path}/none", most_rows=100) == 0 and not (tmp_path / "none").exists()
    columns = neighbours.neighbourhood(F.substring("term", 3, 99), F.lit(2))
    assert all(neighbours.grown(r.term[2:], 2) == set(r.members) for r in terms.select("term", columns.alias("members")).collect())
    asked = spark.createDataFrame([(w,) for w in sorted(made)[::9]], "q_term string")
    found = lexical.spellings(asked, terms, most=None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "member" not in plan
    assert sorted(found.collect()) == sorted(lexical.spellings(asked, terms, 0, most=None).collect())


def test_rounds_of_queries_write_matches_and_no_documents(spark, built):
    """Beyond the bounds documents are neither shuffled nor written once per block of queries."""
    asked = search.admit(requests(spark))
    whole = lexical.bm25_matches(asked, built, 5)
    divided = lexical.bm25_matches(asked, built, 5, max_query_block=2, doc_block=7)
    plan = divided._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" not in plan and "CoGroup" not in plan
    assert "title_terms" not in plan
    rows = [sorted(map(tuple, lexical.top_per_query(found, 5).collect())) for found in (whole, divided)]
    assert rows[0] and rows[0] == rows[1]
    assert divided.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5
