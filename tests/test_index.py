"""Stored postings, the index contract and approximate vector search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import approximate, index, inverted, lexical, nearest, search
from tidemark.plans import queries_search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark):
    return queries_search.index_of(spark, SF)


def test_lists_and_documents_score_alike(spark, built):
    words = built.terms.where("term like 't:%' and df > 1").orderBy(F.desc("df"), "term").limit(30).collect()
    rng = random.Random(1)
    pool = [r.term[2:] for r in words]
    asked = [(f"q{n}", " ".join(rng.choice(pool) for _ in range(rng.randint(1, 7))), rng.choice(["enwiki", None]), rng.choice([0, None])) for n in range(60)]
    asked += [("gone", "nosuchword atall", None, None), ("same", f"{pool[0]} {pool[0]}", None, None)]
    queries = spark.createDataFrame(asked, "query_id string, query string, wiki string, namespace int")
    lists, whole = (
        {(r.query_id, r.id, r.units) for r in lexical.top_per_query(lexical.bm25_matches(queries, built, 50, lists=way), 50).collect()}
        for way in (True, False)
    )
    assert lists == whole and len(lists) > 100


def test_a_search_opens_the_folders_of_its_terms(spark, built):
    term = built.terms.orderBy("term").first().term
    wanted = spark.createDataFrame([(term,)], "term string")
    lists = inverted.lists_of(built.postings, wanted, built.buckets)
    files = {f.split("bucket=")[1].split("/")[0] for f in lists.inputFiles()} if lists.inputFiles() else set()
    plan = lists._jdf.queryExecution().executedPlan().toString()
    number = spark.range(1).select(inverted.bucket_of(F.lit(term), built.buckets)).first()[0]
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"(bucket#" in plan and f"= {number})" in plan
    assert lists.where(F.col("term") == term).count() > 0 and len(files) <= built.buckets
    assert lists.select("bucket").distinct().count() == 1


def test_postings_hold_every_live_term(spark, built):
    live = built.docs.where("not coalesce(deleted, false)")
    assert built.postings.count() == live.agg(F.sum(F.size("terms"))).first()[0]
    row = built.postings.where("size(places) > 1").first()
    if row:
        title = built.docs.where(F.col("id") == row.id).first().title_terms
        assert [at for at, word in enumerate(title) if word == row.term[2:]] == row.places and len(row.places) == row.tf


def test_contract_of_an_index(spark, built, tmp_path):
    docs = queries_search.docs(spark, SF).limit(20)
    path = str(tmp_path / "index")
    index.write_index(docs, path, dims=16)
    assert index.open_index(spark, path, provider="hash", dims=16).dims == 16
    for wanted in ({"dims": 384}, {"provider": "model"}):
        with pytest.raises(index.ContractError):
            index.open_index(spark, path, **wanted)
    with pytest.raises(index.ContractError):
        index.write_index(docs, path, dims=8)
    with pytest.raises(index.ContractError):
        index.open_index(spark, str(tmp_path / "nothing"))
    index.write_index(docs, path, dims=16)
    other = docs.withColumn("embedding", F.array_repeat(F.lit(1.0).cast("float"), 4))
    made = index.build_index(other, dims=4, path=str(tmp_path / "own"), provider="model")
    asked = spark.createDataFrame([("q", "anything", "hybrid", 10)], "query_id string, query string, mode string, size int")
    with pytest.raises(index.ContractError):
        search.search(asked, made)
    with pytest.raises(index.ContractError):
        index.build_index(other, dims=5, path=str(tmp_path / "wrong"), provider="model")


def test_a_query_without_vector_keeps_its_words(spark, built):
    title = built.docs.where("namespace = 0 and size(title_terms) > 2 and not coalesce(deleted, false)").first().title
    asked = spark.createDataFrame([("q", title, "hybrid", 10)], "query_id string, query string, mode string, size int")
    none = spark.createDataFrame([], "query_id string, embedding array<float>")
    hits = search.search(asked, built, query_vectors=none).collect()
    assert hits and all(h.knn_rank is None for h in hits)


def vectors(spark, rows):
    schema = "id string, wiki string, namespace int, embedding array<float>, deleted boolean"
    return spark.createDataFrame([(str(n), "ab"[n % 2], n % 3, None if v is None else [float(x) for x in v], n % 11 == 5) for n, v in enumerate(rows)], schema)


def asked_of(table):
    null = F.lit(None)
    return table.where("embedding is not null").select(
        F.col("id").alias("query_id"), null.cast("string").alias("wiki"), null.cast("int").alias("namespace"), "embedding"
    )


def test_cells_hold_all_and_all_cells_give_the_exact_result(spark):
    rng = np.random.default_rng(2)
    table = vectors(spark, [*rng.normal(size=(300, 8)), *[np.ones(8)] * 100, None, np.zeros(8)])
    cells = approximate.build_cells(table, cells=9)
    live = table.where("not deleted and embedding is not null")
    assert cells.docs.count() == live.count() == sum(cells.sizes.values())
    asked = asked_of(table)
    exact = lexical.top_per_query(nearest.nearest(asked, table, 7, 0.6, 500, 500), 7)
    wanted = {(r.query_id, r.id, r.units, r["rank"]) for r in exact.collect()}
    for sizes in ({}, {"doc_block": 10, "query_block": 7}):
        found = approximate.nearest_in_cells(asked, cells, 7, 0.6, probed=9, **sizes)
        assert {(r.query_id, r.id, r.units, r["rank"]) for r in lexical.top_per_query(found, 7).collect()} == wanted
    filtered = asked.withColumn("wiki", F.lit("a"))
    found = approximate.nearest_in_cells(filtered, cells, 3, None, probed=3).join(table.select("id", F.col("wiki").alias("w")), "id")
    assert {r.w for r in found.collect()} == {"a"}


def test_few_cells_find_most_of_what_lies_close(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    table = vectors(spark, centres[rng.integers(12, size=600)] + 0.15 * rng.normal(size=(600, 16)))
    cells = approximate.build_cells(table, cells=12)
    asked = asked_of(table).limit(200)
    probed = approximate.probes_for(cells, 10, 0.95)
    found = lexical.top_per_query(approximate.nearest_in_cells(asked, cells, 10, None, probed=probed), 10)
    exact = lexical.top_per_query(nearest.nearest(asked, table, 10, None, 600, 600), 10)
    row = approximate.recall(found, exact).agg(F.sum("found") / F.sum("hits")).first()
    assert probed <= 4 and row[0] >= 0.9
    assert approximate.build_cells(table.where("false")).sizes == {}


def test_lists_shuffle_postings_and_no_pairs(spark, built):
    words = [r.term[2:] for r in built.terms.where("term like 't:%' and df > 1").orderBy(F.desc("df"), "term").limit(8).collect()]
    asked = [(f"q{n}", f"{word} {words[0]}", None, None) for n, word in enumerate(words)]
    queries = spark.createDataFrame(asked, "query_id string, query string, wiki string, namespace int")
    found = lexical.bm25_matches(queries, built, 1, lists=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(id" in plan and "hashpartitioning(query_id#" not in plan.split("MapInArrow")[1]
    # A task hands on the best of its documents, not all that match.
    matching = built.docs.where("not coalesce(deleted, false)").where(F.array_contains("terms", f"t:{words[0]}")).count()
    assert found.count() <= len(words) * max(1, found.rdd.getNumPartitions()) and matching > 1


def test_documents_of_one_id_add_up_in_the_lists(spark, tmp_path):
    docs = queries_search.docs(spark, SF).limit(20)
    index.write_index(docs.unionByName(docs), str(tmp_path / "twice"))
    twice = index.open_index(spark, str(tmp_path / "twice"))
    title = docs.where("not deleted").first().title
    queries = spark.createDataFrame([("q", title, None, None)], "query_id string, query string, wiki string, namespace int")
    rows = lexical.bm25_matches(queries, twice, 50, lists=True).collect()
    assert rows and len({r.id for r in rows}) == len(rows)


def test_a_vector_is_sent_once_per_group_of_cells(spark):
    rng = np.random.default_rng(4)
    table = vectors(spark, rng.normal(size=(200, 8)))
    cells = approximate.build_cells(table, cells=12)
    groups = approximate.groups_of(cells.sizes, 60)
    held = {g: sum(cells.sizes[c] for c in groups if groups[c] == g) for g in groups.values()}
    assert set(groups) == set(cells.sizes) and all(n <= 60 or list(groups.values()).count(g) == 1 for g, n in held.items())
    asked = asked_of(table)
    rows = approximate.by_group(asked, cells.centres, 12, groups).collect()
    assert len(rows) == asked.count() * len(held)
    assert all({groups[c] for c in r.cells} == {r.cell_group} for r in rows) and sum(len(r.cells) for r in rows) == asked.count() * len(groups)
