"""Registered queries of the retrieval half."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.coercion import bind
from tidemark.functions.text import clean_comment, searchable_text as searchable, strip
from tidemark.operators import answers, approximate, evaluate, fold
from tidemark.operators import enrich as enrichment
from tidemark.operators import index as indexing
from tidemark.operators import lexical, metrics, nearest, search
from tidemark.plans import fixtures as fx
from tidemark.session import configure

_INDEXES: dict[tuple[str, str], indexing.TextIndex] = {}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.view(spark, sf_dir, fx.docs)
    return found.withColumns(
        {"event_time": F.timestamp_micros("event_us"), "seq": F.lit(0).cast("bigint")}
    ).drop("event_us")


def index_of(spark: SparkSession, sf_dir: str) -> indexing.TextIndex:
    """The stored index of the documents; built once per application, as an index is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES or _INDEXES[key].docs.sparkSession is not spark:
        _INDEXES[key] = indexing.build_index(docs(spark, sf_dir))
    return _INDEXES[key]


def requests(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.search_queries)


def asked_in(spark, sf_dir, mode):
    return search.admit(requests(spark, sf_dir)).withColumn("mode", F.lit(mode))


def questions(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.questions)


def clean_comments(spark, sf_dir):
    return docs(spark, sf_dir).select("id", clean_comment(F.col("last_comment")).alias("cleaned"))


def source_documents(spark, sf_dir):
    """Fields of the written JSON documents: absent ones are absent, comments are clean."""
    body = F.try_parse_json("source")
    written = fold.source_json(docs(spark, sf_dir), with_embedding=False)
    names = F.map_keys(F.from_json("source", "map<string,string>"))
    return written.select(
        "id",
        F.array_join(F.sort_array(names), ",").alias("fields"),
        F.try_variant_get(body, "$.last_comment", "string").alias("last_comment"),
        F.try_variant_get(body, "$.version", "bigint").alias("version"),
    )


def searchable_text(spark, sf_dir):
    text = searchable(F.col("title"), F.col("summary"), F.col("last_comment"))
    return docs(spark, sf_dir).select("id", text.alias("text"))


def hash_embeddings(spark, sf_dir):
    embedded = indexing.embed_documents(docs(spark, sf_dir))
    slots = embedded.select("id", F.posexplode("embedding").alias("slot", "value"))
    return slots.where(F.col("value") != 0).select(
        "id", "slot", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def postings(spark, sf_dir):
    return indexing.postings(indexing.analysed(docs(spark, sf_dir)))


def corpus_stats(spark, sf_dir):
    found = indexing.analysed(docs(spark, sf_dir))
    fields = indexing.field_statistics(found).select(
        "field", F.lit("").alias("term"), "documents", F.col("total_length").alias("total")
    )
    terms = indexing.term_statistics(found).select(
        F.substring("term", 1, 1).alias("field"),
        F.substring("term", 3, lexical.LONGEST_TEXT).alias("term"),
        F.col("df").alias("documents"),
        F.lit(0).cast("bigint").alias("total"),
    )
    return fields.unionByName(terms)


def fuzzy_terms(spark, sf_dir):
    ready = lexical.analyse_queries(asked_in(spark, sf_dir, "bm25")).where("fuzzy")
    wanted = ready.select(F.explode("q_terms").alias("q_term"))
    index = index_of(spark, sf_dir)
    found = lexical.spellings(wanted, index.terms, stored=index.neighbours)
    return found.select(
        "q_term", F.substring("term", 1, 1).alias("field"),
        F.substring("term", 3, lexical.LONGEST_TEXT).alias("term"),
        F.round("weight", 6).alias("weight"), "df",
    )


def phrase_match(spark, sf_dir):
    """Every distinct title probe as a phrase: in how many titles its terms stand next to
    each other, and how often. Equal phrases and equal titles are reduced to one before they
    meet, and they meet at the phrase's rarest term."""
    index = index_of(spark, sf_dir)
    probes = evaluate.title_probes(index.docs, ["bm25"], None)
    phrases = lexical.analyse_queries(search.admit(probes)).select("q_terms").distinct()
    tagged = phrases.select("q_terms", F.explode("q_terms").alias("q_term"))
    tagged = tagged.withColumn("term", F.concat(F.lit("t:"), "q_term"))
    rarest = tagged.join(index.terms, "term").groupBy("q_terms").agg(
        F.min(F.struct("df", "term")).getField("term").alias("term")
    )
    titles = index.docs.groupBy("title_terms").agg(F.count(F.lit(1)).alias("docs"))
    placed = titles.select(
        "title_terms", "docs", F.explode(F.array_distinct("title_terms")).alias("word")
    ).withColumn("term", F.concat(F.lit("t:"), "word"))
    freq = lexical.phrase_frequency(F.col("title_terms"), F.col("q_terms")).cast("bigint")
    met = bind(placed.join(rarest, "term"), freq=freq).where(F.col("freq") > 0)
    return met.groupBy(F.array_join("q_terms", " ").alias("phrase")).agg(
        F.sum("docs").alias("titles"), F.sum(F.col("docs") * F.col("freq")).alias("occurrences")
    )


def bm25_search(spark, sf_dir):
    asked = asked_in(spark, sf_dir, "bm25")
    found = lexical.bm25_matches(asked, index_of(spark, sf_dir), search.CANDIDATES)
    return lexical.top_per_query(found, search.CANDIDATES)


def bm25_lists(spark, sf_dir):
    """The same searches by the lists of their terms, whatever they cost."""
    asked = asked_in(spark, sf_dir, "bm25")
    found = lexical.bm25_matches(asked, index_of(spark, sf_dir), search.CANDIDATES, lists=True)
    return lexical.top_per_query(found, search.CANDIDATES)


def knn_approx(spark, sf_dir):
    """The fifty nearest of all vectors for every vector out of the cells next to it, held against
    the exact result: how many hits that has, and whether nine of ten were found."""
    asked, plain = vector_tables(spark, sf_dir)
    rows = plain.count()
    cells = approximate.build_cells(plain)
    found = lexical.top_per_query(approximate.nearest_in_cells(asked, cells, 50, None), 50)
    exact = lexical.top_per_query(nearest.nearest(asked, plain, 50, None, rows, rows), 50)
    counted = approximate.recall(found, exact)
    return counted.agg(F.sum("hits").alias("hits"), (10 * F.sum("found") >= 9 * F.sum("hits")).alias("recalled"))


def knn_floor(spark, sf_dir):
    asked = asked_in(spark, sf_dir, "vector")
    index = index_of(spark, sf_dir)
    vectors = nearest.embed_queries(asked, asked.count())
    found = nearest.nearest(
        vectors, index.docs, search.CANDIDATES, search.KNN_FLOOR, asked.count(), index.documents
    )
    top = lexical.top_per_query(found, search.CANDIDATES)
    return top.select(
        "query_id", "id", "rank", F.round(F.col("units") / nearest.UNITS, 6).alias("score")
    )


def vector_tables(spark, sf_dir):
    configure(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plain = vectors.select(
        F.col("vec_id").cast("string").alias("id"), F.lit("").alias("wiki"),
        F.lit(0).alias("namespace"), "embedding", F.lit(False).alias("deleted"),
    )
    asked = plain.select(
        F.col("id").alias("query_id"), F.lit(None).cast("string").alias("wiki"),
        F.lit(None).cast("int").alias("namespace"), "embedding",
    )
    return asked, plain


def knn_exact(spark, sf_dir):
    """The ten nearest of all vectors for every vector, with a score floor."""
    asked, plain = vector_tables(spark, sf_dir)
    rows = plain.count()
    found = nearest.nearest(asked, plain, 10, 0.62, rows, rows)
    return lexical.top_per_query(found, 10).select(
        "query_id", "id", "rank", F.round(F.col("units") / nearest.UNITS, 6).alias("score")
    )


def query_weights(spark, sf_dir):
    bm25, knn = search.query_weights(F.col("query"))
    asked = requests(spark, sf_dir).where(strip(F.col("query")) != "")
    return asked.select(
        "query_id", F.round(bm25, 6).alias("bm25_weight"), F.round(knn, 6).alias("knn_weight")
    )


def hybrid_search(spark, sf_dir):
    return search.search(requests(spark, sf_dir), index_of(spark, sf_dir))


def search_response(spark, sf_dir):
    asked = requests(spark, sf_dir)
    found = search.responses(asked, search.search(asked, index_of(spark, sf_dir)))
    return found.select(
        "query_id", "query", "mode", "count",
        F.coalesce(F.array_join("hits.id", ","), F.lit("")).alias("ids"),
    )


def search_counters(spark, sf_dir):
    """Searches that are answered by mode, and answers by whether they are grounded."""
    asked = search.admit(requests(spark, sf_dir))
    answered = answers.answer(questions(spark, sf_dir), index_of(spark, sf_dir))
    searches = metrics.counter(asked, "searches", F.col("mode"))
    return searches.unionByName(metrics.counter(answered, "answers", F.col("grounded").cast("string")))


def summary_enrich(spark, sf_dir):
    found = enrichment.enrich(docs(spark, sf_dir), fx.view(spark, sf_dir, fx.summaries))
    return found.select("id", "version", "summary")


def enrich_guard(spark, sf_dir):
    """Summaries written over an index in which every eighth document has a newer edit."""
    stored = docs(spark, sf_dir)
    late = enrichment.enrich(stored, fx.view(spark, sf_dir, fx.summaries))
    newer = F.when(F.col("id").cast("bigint") % 8 == 4, F.col("version") + 1)
    ahead = stored.withColumn("version", F.coalesce(newer, F.col("version")))
    return fold.merge(ahead, late).select("id", "version", "summary")


def prompted(spark, sf_dir):
    asked = questions(spark, sf_dir)
    return asked, answers.prompts(asked, answers.contexts(asked, index_of(spark, sf_dir)))


def rag_prompt(spark, sf_dir):
    return prompted(spark, sf_dir)[1].select("question_id", "prompt")


def extractive_answer(spark, sf_dir):
    found = answers.generate(prompted(spark, sf_dir)[1])
    return found.select("question_id", "answer")


def shown(answered: DataFrame) -> DataFrame:
    cited = F.transform(
        "citations", lambda c: F.concat_ws(":", c["position"].cast("string"), c["id"])
    )
    return answered.select(
        "question_id", "answer", "grounded",
        F.coalesce(F.array_join(cited, ","), F.lit("")).alias("cited"),
        F.unix_micros("freshest_source").alias("freshest_us"),
    )


def rag_answers(spark, sf_dir):
    return shown(answers.answer(questions(spark, sf_dir), index_of(spark, sf_dir)))


def grounding(spark, sf_dir):
    """Answers of a primary generator where it gave one, extractive ones elsewhere."""
    asked = questions(spark, sf_dir)
    shape = F.length("question") % 6
    model = (
        F.when(shape == 0, "The page [2] changed, see [1] and [9].")
        .when(shape == 1, "Sorry, I don't know.")
        .when(shape == 2, "It changed recently.")
        .when(shape == 3, " ")
        .when(shape == 4, "There is not enough information [1].")
    )
    primary = asked.select("question_id", model.alias("answer"))
    return shown(answers.answer(asked, index_of(spark, sf_dir), primary))


def eval_titles(spark, sf_dir):
    index = index_of(spark, sf_dir)
    probes = evaluate.title_probes(index.docs, ["bm25", "hybrid"], "enwiki")
    hits = search.search(probes, index)
    titled = search.with_documents(hits, index, probes.count() * evaluate.CASE_HITS, ["title"])
    report = evaluate.title_report(probes, titled)
    return report.select(
        "mode", F.col("total").alias("probes"), "passed",
        F.round("pass_percent", 3).alias("pass_percent"),
        F.round("mean_reciprocal", 6).alias("mean_reciprocal"),
    )


def eval_cases(spark, sf_dir):
    index = index_of(spark, sf_dir)
    asked = requests(spark, sf_dir)
    hits = search.search(asked, index)
    titled = search.with_documents(
        hits, index, asked.count() * search.MAX_SIZE, ["title", "namespace"]
    )
    tag = F.substring_index("query_id", "-", -1)
    pattern = F.concat(F.lit("(?i)"), F.regexp_extract("query", "[A-Za-z]+", 0))
    cases = asked.select(
        F.col("query_id").alias("case_id"),
        (tag == "noise").alias("expect_empty"),
        F.when(tag.isin("quoted", "two"), 0).alias("expect_namespace"),
        F.when(~tag.isin("noise", "blank"), F.array(pattern)).alias("title_patterns"),
        F.when(tag == "whole", 1).when(tag == "eight", 3).otherwise(0).alias("min_hits"),
    )
    return evaluate.check_cases(cases, titled)


def eval_grounding(spark, sf_dir):
    asked = questions(spark, sf_dir)
    cases = asked.select("question_id", (F.length("question") > 100).alias("expected"))
    report = evaluate.grounding_report(cases, answers.answer(asked, index_of(spark, sf_dir)))
    return report.select("expected", "total", "passed")


NAMES = """
    clean_comments source_documents searchable_text hash_embeddings postings corpus_stats fuzzy_terms phrase_match
    bm25_search bm25_lists search_counters knn_exact knn_approx knn_floor query_weights hybrid_search search_response summary_enrich
    enrich_guard rag_prompt extractive_answer rag_answers grounding eval_titles eval_cases
    eval_grounding
""".split()


def queries():
    return {name: globals()[name] for name in NAMES}


def oracle_sql():
    from tidemark.plans import oracle_search as o

    return {name: getattr(o, name)() for name in NAMES}
