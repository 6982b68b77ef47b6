"""BM25 retrieval: many queries against the documents of an index."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.coercion import bind
from tidemark.functions.text import analyse, words
from tidemark.operators.blocks import (
    DOC_BLOCK,
    RESULT,
    UNITS,
    best_of,
    filter_groups,
    match_blocks,
    offsets_of,
    passing,
    result,
    top_per_query,
)
from tidemark.operators.fold import is_live
from tidemark.operators.index import FIELDS, TextIndex
from tidemark.operators.inverted import gathered
from tidemark.operators.neighbours import LONGEST_STORED, allowed_edits, meeting, members_of, neighbourhood, neighbours, positions, without
from tidemark.session import MAX_BROADCAST_ROWS, equi_join, staged

# Field boosts, phrase boost, saturation and length parameters, the share of
# terms a long query must match (as a fraction), and the most spellings a word is given.
BOOSTS = {"t": 4.0, "s": 2.0, "c": 1.0}
PHRASE_BOOST = 8.0
K1 = 1.2
B = 0.75
LONG_SHARE = (3, 5)
MAX_SPELLINGS = 50

TAGS = list(FIELDS)

# Cells of one score matrix.
CELLS = 4_000_000

# Postings of a document that are decoded while a cell is scored, or a posting of a list shuffled.
POSTINGS_PER_CELL = 8

# Postings of a block of documents, where queries are divided into blocks too.
BLOCK_POSTINGS = 2_000_000

LONGEST_TEXT = 1_000_000_000


def swaps(text: Column) -> Column:
    """The text with each pair of neighbours exchanged."""
    return F.transform(
        positions(F.lit(1), F.length(text) - 1),
        lambda i: F.concat(
            F.substring(text, F.lit(1), i - 1),
            text.substr(i + 1, F.lit(1)),
            text.substr(i, F.lit(1)),
            text.substr(i + 2, F.length(text)),
        ),
    )


def with_edit_distance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``edits`` between two columns, an exchange of neighbours being one edit; null
    above two."""
    left, right = F.col(a), F.col(b)
    bound = bind(
        pairs, _plain=F.levenshtein(left, right, 2), _left=swaps(left), _right=swaps(right)
    )
    near = F.exists("_left", lambda s: F.levenshtein(s, right, 1) >= 0) | F.exists(
        "_right", lambda s: F.levenshtein(left, s, 1) >= 0
    )
    edits = (
        F.when((F.col("_plain") >= 0) & (F.col("_plain") <= 1), F.col("_plain"))
        .when(F.array_contains("_left", right), F.lit(1))
        .when((F.col("_plain") == 2) | near | F.arrays_overlap("_left", "_right"), F.lit(2))
    )
    return bind(bound, edits=edits).drop("_plain", "_left", "_right")


def analyse_queries(queries: DataFrame) -> DataFrame:
    """Query terms and the number that must match in one field. How strict the match is
    follows the white-space word count; how many terms there are follows the analyser."""
    bound = bind(queries, q_terms=analyse(F.col("query")), q_words=F.size(words(F.col("query"))))
    n = F.size("q_terms")
    part, whole = LONG_SHARE
    share = F.floor(n * part / whole).cast("int")
    needed = (
        F.when(F.col("q_words") <= 2, 1)
        .when(F.col("q_words") <= 4, n)
        .otherwise(F.greatest(F.lit(1), share))
    )
    return bound.select(
        "query_id", "wiki", "namespace", "q_terms", (F.col("q_words") <= 2).alias("fuzzy"),
        needed.alias("needed"),
    ).where(n > 0)


def spellings(
    wanted: DataFrame, terms: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS, most: int | None = MAX_SPELLINGS,
    stored: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Dictionary terms close to each wanted term, the best ``most`` per field or all (None):
    ``(q_term, term, weight, df)`` with ``df`` the largest among them. ``stored`` is the table of
    the dictionary's neighbourhoods and the number of its folders; words that it leaves out for
    their length, or all words where there is none, grow into theirs here."""
    spark = terms.sparkSession
    distinct = wanted.select("q_term").distinct()
    allowed = allowed_edits(F.col("q_term"))
    length = F.length("q_term")
    sizes = distinct.agg(
        F.coalesce(F.sum(neighbours(length)), F.lit(0)).alias("members"),
        F.count(F.lit(1)).alias("terms"),
        F.collect_set(length).alias("lengths"),
    ).first()
    near_lengths = {n + d for n in sizes["lengths"] for d in (-2, -1, 0, 1, 2)}
    if stored:
        near_lengths = {n for n in near_lengths if n > LONGEST_STORED}
    probes = distinct.select("q_term", F.explode(neighbourhood(F.col("q_term"), allowed)).alias("member"))
    # Each word grows into its whole neighbourhood, so words are spread evenly beforehand.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word = F.substring("term", 3, LONGEST_TEXT)
    entries = terms.select(word.alias("word")).where(F.length("word").isin(sorted(near_lengths)))
    found_words = entries.repartition(tasks, "word").distinct()
    if not stored and sizes["members"] <= max_broadcast_rows:
        asked = distinct.select("q_term", allowed).collect()  # no more than their members
        met = meeting(found_words, [tuple(row) for row in asked])
    else:
        candidates = found_words.select(
            "word", F.explode(neighbourhood(F.col("word"), F.lit(2))).alias("member")
        )
        if stored:
            kept = members_of(*stored, probes).select("word", "member")
            candidates = kept.unionByName(candidates) if near_lengths else kept
        met = equi_join(
            candidates, probes, ["member"], spread=F.col("word"), small_rows=sizes["members"],
            max_broadcast_rows=max_broadcast_rows,
        )
    pairs = with_edit_distance(met.select("q_term", "word").distinct(), "q_term", "word")
    pairs = pairs.where(F.col("edits") <= allowed)
    shorter = F.least(F.length("q_term"), F.length("word"))
    pairs = pairs.withColumn("weight", 1.0 - F.col("edits") / shorter)
    pairs = pairs.join(terms.withColumn("word", word), "word")
    pairs = pairs.withColumn("field", F.substring("term", 1, 1))
    per_field = W.partitionBy("q_term", "field")
    ranked = pairs.withColumn(
        "no", F.row_number().over(per_field.orderBy(F.col("weight").desc(), "term"))
    )
    if most is not None:
        ranked = ranked.where(F.col("no") <= most)
    return ranked.withColumn("df", F.max("df").over(per_field)).select(
        "q_term", "term", "weight", "df"
    )


def idf(df: Column, documents: Column) -> Column:
    return F.log(1 + (documents - df + 0.5) / (df + 0.5))


def by_field(field: Column, values: dict[str, float], default: float = 0.0) -> Column:
    column = F.lit(default)
    for tag, value in values.items():
        column = F.when(field == tag, F.lit(float(value))).otherwise(column)
    return column


def term_join(terms: DataFrame, asked: DataFrame, asked_rows: int, max_broadcast_rows: int) -> DataFrame:
    """What is asked for with its row of the dictionary, which has one per term: beyond the bound
    the asked side is dealt by term, and neither is repeated."""
    if asked_rows <= max_broadcast_rows:
        return terms.join(F.broadcast(asked), "term")
    return asked.join(terms, "term")


def query_entries(
    analysed_queries: DataFrame,
    index: TextIndex,
    term_rows: int,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """What each query looks for: ``(query_id, needed, field, term, df, weight)`` with one
    row per query term and field, or per spelling for short queries. Terms that no document
    has are left out."""
    tags = F.array(*[F.lit(tag) for tag in FIELDS])
    spread = analysed_queries.select(
        "query_id", "needed", "fuzzy", F.explode("q_terms").alias("q_term")
    )
    exact = spread.where(~F.col("fuzzy")).select(
        "query_id", "needed", "q_term", F.explode(tags).alias("field")
    )
    exact = exact.withColumn("term", F.concat("field", F.lit(":"), "q_term"))
    exact = term_join(index.terms, exact, term_rows * len(FIELDS), max_broadcast_rows).select("query_id", "needed", "field", "term", "df", F.lit(1.0).alias("weight"))
    close = spread.where("fuzzy").select("query_id", "needed", "q_term")
    near = spellings(close, index.terms, max_broadcast_rows, stored=index.neighbours)
    # No word has more than fifty spellings per field.
    near_rows = term_rows * len(FIELDS) * MAX_SPELLINGS
    loose = equi_join(
        close, near, ["q_term"], spread=F.col("query_id"), small_rows=near_rows,
        max_broadcast_rows=max_broadcast_rows,
    ).select(
        "query_id", "needed", F.substring("term", 1, 1).alias("field"), "term", "df", "weight"
    )
    return exact.unionByName(loose)


def query_plans(
    queries: DataFrame, index: TextIndex, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """One row per query: its weighted entries, how many must match in one field, and the
    weight of its title phrase."""
    ready = analyse_queries(queries)
    term_rows = ready.agg(F.coalesce(F.sum(F.size("q_terms")), F.lit(0))).first()[0]
    entries = query_entries(ready, index, term_rows, max_broadcast_rows)
    boost = by_field(F.col("field"), BOOSTS)
    size = by_field(F.col("field"), index.counts)
    weight = boost * idf(F.col("df"), size) * F.col("weight") * (K1 + 1)
    per_query = entries.groupBy("query_id").agg(
        F.collect_list(F.struct("term", weight.alias("w"), F.col("df").cast("bigint").alias("df"))).alias("entries")
    )
    title_df = ready.select("query_id", F.explode("q_terms").alias("q_term"))
    title_df = title_df.withColumn("term", F.concat(F.lit("t:"), "q_term"))
    phrase = term_join(index.terms, title_df, term_rows, max_broadcast_rows)
    units = F.round(idf(F.col("df"), F.lit(index.counts.get("t", 0))) * UNITS).cast("bigint")
    phrase = phrase.groupBy("query_id").agg(F.sum(units).alias("idf_units"))
    phrase_w = F.col("idf_units") / UNITS * PHRASE_BOOST * (K1 + 1)
    return (
        ready.join(per_query, "query_id")
        .join(phrase, "query_id", "left")
        .select(
            "query_id", "wiki", "namespace", "q_terms", "fuzzy", "needed", "entries",
            F.coalesce(phrase_w, F.lit(0.0)).alias("phrase_w"),
        )
    )


def phrase_frequency(title: Column, phrase: Column) -> Column:
    """How often the terms of ``phrase`` occur next to each other in ``title``."""
    span = F.size(phrase)
    starts = F.when(
        (span > 0) & (F.size(title) >= span), F.sequence(F.lit(1), F.size(title) - span + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(title, i, span) == phrase))


class Entries:
    """The entries of a block of queries, laid out by term for one pass over documents."""

    def __init__(self, queries: pa.Table):
        self.ids = np.array(queries["query_id"].to_pylist(), dtype=object)
        self.groups = filter_groups(queries)
        self.needed = queries["needed"].to_numpy()
        self.phrases = queries["q_terms"].to_pylist()
        self.phrase_w = queries["phrase_w"].to_numpy()
        self.repeats = queries["repeats"].to_pylist() if "repeats" in queries.column_names else [1] * len(self.ids)
        # A title that holds an exact phrase has matched all its terms; of a short query
        # with several spellings at least one.
        exact = np.array([len(phrase) for phrase in self.phrases])
        self.phrase_needs = np.where(queries["fuzzy"].to_numpy(zero_copy_only=False), 1, exact)
        # The score of the k-th best document met so far, per query and task.
        self.floor = np.zeros(len(self.ids))
        found, ends = offsets_of(queries["entries"])
        terms = found.field("term")
        owner = np.repeat(np.arange(len(self.ids)), np.diff(ends))
        coded = terms.dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy()
        tags = np.array([term[0] for term in self.vocabulary.to_pylist()], dtype=object)
        field = np.array([TAGS.index(tag) for tag in tags], dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        # A slot is one query and one field.
        self.slot = (owner * len(TAGS) + field[codes])[order] if len(codes) else codes
        self.weight = found.field("w").to_numpy()[order]
        self.count = np.bincount(codes, minlength=len(self.vocabulary))
        self.begin = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        self.field = field

    def raise_floor(self, q_at: np.ndarray, score: np.ndarray, k: int) -> None:
        """Later documents must reach what ``k`` documents of a query have reached."""
        full = np.bincount(q_at, minlength=len(self.ids)) >= k
        worst = np.full(len(self.ids), np.inf)
        np.minimum.at(worst, q_at, score)
        self.floor = np.where(full, np.maximum(self.floor, worst), self.floor)


def score_terms(
    entries: Entries, docs: pa.Table, k: int, mean_lengths: dict[str, float]
) -> pa.Table:
    """The best ``k`` documents of a block per query.

    Each posting of a document is multiplied out to the queries that contain its term and
    counted in a document-by-slot matrix; a few documents at a time, so the matrix has a
    fixed size. Scores are added up where enough of a query's entries matched in a field; the
    best such field counts.
    """
    queries = len(entries.ids)
    if not queries or not docs.num_rows:
        return RESULT.empty_table()
    ids = np.array(docs["id"].to_pylist(), dtype=object)
    terms, ends = offsets_of(docs["terms"])
    codes = pc.index_in(terms, value_set=entries.vocabulary)
    known = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
    codes = codes.drop_null().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(docs.num_rows), np.diff(ends))[known]
    tf = offsets_of(docs["tfs"])[0].to_numpy()[known].astype(np.float64)
    lengths = np.stack([docs[f"{tag}_len"].to_numpy() for tag in TAGS])
    means = np.array([mean_lengths.get(tag, 1.0) for tag in TAGS])
    norms = K1 * ((1 - B) + B * lengths / means[:, None])
    part = tf / (tf + norms[entries.field[codes], owner])
    passes = np.stack([passing(docs, *key) for key in entries.groups])
    group_of = np.empty(queries, dtype=np.int64)
    for at, members in enumerate(entries.groups.values()):
        group_of[members] = at
    needed = np.repeat(entries.needed, len(TAGS))
    titles = docs["title_terms"].to_pylist()
    placed = docs["placed"].to_pylist() if "placed" in docs.column_names else [None] * docs.num_rows
    slots = queries * len(TAGS)
    step = max(1, CELLS // slots)
    kept = (np.array([], np.int64), np.array([], np.int64), np.array([]))
    pending, waiting = [], 0
    for start in range(0, docs.num_rows, step):
        stop = min(start + step, docs.num_rows)
        lo, hi = np.searchsorted(owner, [start, stop])
        times = entries.count[codes[lo:hi]]
        source = np.repeat(np.arange(lo, hi), times)
        within = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
        entry = entries.begin[codes[source]] + within
        cell = (owner[source] - start) * slots + entries.slot[entry]
        matched = np.bincount(cell, minlength=(stop - start) * slots)
        good = (matched.reshape(-1, slots) >= needed).ravel()
        # The cells that count, in order, and what was added to them.
        counted = np.flatnonzero(good)
        added = np.flatnonzero(good[cell])
        units = np.floor(entries.weight[entry[added]] * part[source[added]] * UNITS + 0.5)
        totals = np.bincount(np.searchsorted(counted, cell[added]), weights=units, minlength=len(counted))
        pair = counted // len(TAGS)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        score = np.maximum.reduceat(totals, first) if len(first) else totals
        d_at, q_at = np.divmod(pair[first], queries)
        passed = passes[group_of[q_at], d_at + start]
        d_at, q_at, score = d_at[passed], q_at[passed], score[passed]
        titled = matched[(d_at * queries + q_at) * len(TAGS) + TAGS.index("t")]
        whole = np.flatnonzero(titled >= entries.phrase_needs[q_at])
        for at in whole:
            doc, query = d_at[at] + start, q_at[at]
            times = phrase_count(titles[doc], entries.phrases[query], entries.repeats[query], placed[doc])
            if times:
                share = times / (times + norms[0, doc])
                score[at] += np.floor(entries.phrase_w[query] * share * UNITS + 0.5)
        able = score >= entries.floor[q_at]
        pending.append((q_at[able], d_at[able] + start, score[able]))
        waiting += int(able.sum())
        if waiting > CELLS or stop == docs.num_rows:
            q_at, d_at, score = (np.concatenate(part) for part in zip(kept, *pending, strict=True))
            best_at = best_of(q_at, d_at, score, ids, k)
            kept = (q_at[best_at], d_at[best_at], score[best_at])
            entries.raise_floor(kept[0], kept[2], k)
            pending, waiting = [], 0
    q_at, d_at, score = kept
    return result(entries.ids, ids, q_at, d_at, score)


def phrase_count(title: list[str], phrase: list[str], repeats: int = 1, placed: list[dict] | None = None) -> int:
    """How often ``phrase`` occurs as neighbouring terms of ``title``. Where ``repeats`` requests or
    several documents (``placed``) share an id, the words that all of them bring to a start add up."""
    span = len(phrase)
    if repeats == 1 and placed is None:
        return sum(title[at : at + span] == phrase for at in range(len(title) - span + 1))
    held = enumerate(title) if placed is None else [(p["at"], p["word"]) for p in placed]
    starts = Counter(at - n for at, word in held for n, said in enumerate(phrase) if word == said)
    return sum(repeats * n == span for n in starts.values())


def bm25_matches(
    queries: DataFrame,
    index: TextIndex,
    k: int,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    lists: bool | None = None,
    **bounds,
) -> DataFrame:
    """Matching live documents per query ``(query_id, id, units)``, among them the best ``k``.

    There are two ways to the same scores. The lists of the queries' terms are read and gathered by
    document, at a cost of their length; or every document is scored where it lies, since its row
    holds all that its scores need, at a cost of all postings. Either way a document met costs a
    cell per query. Document frequencies tell both costs beforehand, and the lesser is taken: lists
    for rare words in a large index, documents for very many or common words. ``lists`` names the way.
    """
    plans = staged(query_plans(queries, index, max_broadcast_rows), "query-plans")
    sizes = plans.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum(F.size("entries")), F.lit(0)).alias("entries"),
    ).first()
    by_list, scored = False, index.docs.where(is_live())
    if index.postings is not None and lists is not False:
        # Spellings carry the largest frequency among them, so the lists are no longer than this.
        met = plans.select(F.inline("entries")).groupBy("term").agg(F.max("df").alias("df")).agg(
            F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("rows")
        ).first()
        reached = min(met["rows"], index.documents)
        by_lists = met["rows"] + sizes["queries"] * reached
        if lists or by_lists <= index.posting_rows / POSTINGS_PER_CELL + sizes["queries"] * index.documents:
            # A query's own words are asked for too, for its phrase.
            said = plans.agg(F.coalesce(F.sum(F.size("q_terms")), F.lit(0))).first()[0]
            by_list, scored = True, gathered(index.postings, plans, index.buckets, met["terms"] + said, max_broadcast_rows)
            # Requests that share an id are one in the lists, where their entries add up.
            shared = W.partitionBy("query_id")
            plans = plans.withColumns({
                "entries": F.flatten(F.collect_list("entries").over(shared)), "repeats": F.count(F.lit(1)).over(shared),
            })
    docs = scored.select(
        "id", "wiki", "namespace", "title_terms", "terms", "tfs", *[f"{tag}_len" for tag in TAGS],
        *[name for name in scored.columns if name == "placed"],
    )
    means = dict(index.mean_lengths)
    per_document = max(1, index.posting_rows // max(1, index.documents))
    bounds.setdefault("doc_block", max(1, min(DOC_BLOCK, BLOCK_POSTINGS // per_document)))
    return match_blocks(
        plans, docs, Entries, lambda state, table: score_terms(state, table, k, means), k,
        query_rows=sizes["queries"], entry_rows=sizes["entries"], stored=not by_list,
        **bounds,
    )
