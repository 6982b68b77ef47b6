"""Audit of how the sources of a language differ in their words, by three-dimensional cubes.

Every (language, source) group is a distribution over the terms its language keeps. Two groups
differ by the sum of the differences of their shares. The work is a cube: groups by groups by
terms. It is cut along all three sides:

1. Terms are counted per group where the documents lie, and summed. A language keeps the terms
   of enough documents; they are dealt to blocks of about ``TERMS`` by their hash.
2. A group's counts within one term block are one packed row, a *slice*. Groups are dealt to
   blocks of about ``GROUPS``. A slice is sent to every cell (group block, group block, term
   block) that its group has a part in, so once per group block.
3. A cell adds up the differences of its pairs of groups over its terms. Terms that a group lacks
   have that group's least share, so a slice need not hold them.
4. The parts of a pair are summed along the terms' side.

Shares are whole billionths, computed in decimals that don't overflow, so all sums are exact.
Every pair of sources of one language is a row of the result; that is the audit itself.

Definitions: null text, language and source are empty strings; a group without kept terms has the
same least share everywhere; a language without kept terms has differences of 0; documents are
rows, so repeated rows count each for themselves; texts of any length are read in whole; ties are
ranked by the item's bytes; an empty table has no groups. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_chunks, keep, narrow

LEAST_DOCS = 30
SCALE = 1_000_000_000
PRIOR = 5
RANKS = 50
# Terms of a term block and groups of a group block, on average.
TERMS = 4096
GROUPS = 64
# Distinct (group, term) pairs that a task counts before it hands them on, so many rows at a time.
COUNTED = 1 << 19
HANDED = 1 << 16

BETWEEN = re.compile(rb"[^A-Za-z\x80-\xff]")
# A-Z in lower case, a space for whatever is no part of a term.
SPACED = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of every term and rows that hold it."""

    def run(batches):
        total: defaultdict = defaultdict(Counter)
        held: defaultdict = defaultdict(Counter)
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source")), batch.column("text").cast(pa.binary())):
                count = total[lang, source]
                size -= len(count)
                own: set = set()
                for chunk in byte_chunks(text.as_py() or b"", BETWEEN):
                    terms = chunk.translate(SPACED).split()
                    count.update(terms)
                    own.update(terms)
                held[lang, source].update(own)
                size += len(count)
                if size >= COUNTED:
                    yield from counted(total, held)
                    total.clear()
                    held.clear()
                    size = 0
        yield from counted(total, held)

    def counted(total, held):
        rows = ((*group, term, n, held[group][term]) for group, count in total.items() for term, n in count.items())
        while part := list(islice(rows, HANDED)):
            lang, source, term, n, docs = zip(*part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([t.decode("utf-8", "replace") for t in term], pa.string()),
                    pa.array(n, pa.int64()), pa.array(docs, pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    found = docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, own: Column, kept: Column) -> Column:
    """One more than the whole billionths of a term's smoothed share; null where nothing is kept."""
    top = F.lit(SCALE).cast("decimal(38,0)") * (n + PRIOR).cast("decimal(38,0)")
    bottom = (own + PRIOR * kept).cast("decimal(38,0)")
    return F.when(kept > 0, F.call_function("div", top, bottom) + 1)


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> tuple[DataFrame, DataFrame]:
    """``lang, term, total, block, pos, width`` of kept terms, with their places in blocks of
    ``width``; and ``lang, kept, lang_n, blocks`` of languages that keep any."""
    found = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    found = keep(found.select("lang", "term", "total"), "terms")
    langs = found.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    langs = keep(langs.withColumn("blocks", F.ceil(F.col("kept") / terms).cast("bigint")), "langs")
    dealt = found.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    block = Window.partitionBy("lang", "block")
    return dealt.select(
        "lang", "term", "total", "block", (F.row_number().over(block.orderBy("term")) - 1).alias("pos"),
        F.count(F.lit(1)).over(block).alias("width"),
    ), langs


CELL = "lang string, a string, b string, part bigint"


def cell_differences(cell: pa.Table) -> pa.Table:
    """Differences of all pairs of a cell's groups over its terms. A pair within one group block
    is taken once."""
    lang, first, second = (cell.column(c)[0].as_py() for c in ("lang", "ga", "gb"))
    width = cell.column("width")[0].as_py()
    names = cell.column("source").to_pylist()
    own = cell.column("gblock").to_numpy()
    shares = np.repeat(cell.column("least").fill_null(0).to_numpy()[:, None], width, axis=1)
    for row, (pos, found) in enumerate(zip(cell.column("pos"), cell.column("shares"))):
        if pos.is_valid:
            shares[row, pos.values.to_numpy()] = found.values.to_numpy()
    left = np.flatnonzero(own == first)
    right = np.flatnonzero(own == second)
    # The rows of a cell come in any order; by name, all term blocks of a pair name its ends alike.
    left = np.array(sorted(left, key=names.__getitem__), np.int64)
    a, b, parts = [], [], []
    for at, row in enumerate(left):
        others = left[at + 1 :] if first == second else right
        a += [names[row]] * len(others)
        b += [names[other] for other in others]
        parts.append(np.abs(shares[others] - shares[row]).sum(axis=1))
    part = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.table(
        [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(part)],
        names=["lang", "a", "b", "part"],
    )


def pair_differences(groups: DataFrame, slices: DataFrame, blocks: DataFrame, groups_per_block: int = GROUPS) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language. ``groups``:
    ``lang, source, least, blocks``; ``slices``: ``lang, source, block, pos, share``; ``blocks``:
    ``lang, block, width``."""
    packed = slices.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("pos", "share")).alias("found"))
    # Every group has a slice in each block of its language, be it empty.
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / groups_per_block).cast("bigint").alias("gblocks"))
    whole = groups.join(sizes, "lang").withColumn("gblock", F.pmod(F.xxhash64("source"), F.col("gblocks")))
    whole = whole.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("blocks"), F.lit(1)) - 1)))
    whole = whole.join(packed, ["lang", "source", "block"], "left").join(blocks, ["lang", "block"], "left")
    cells = whole.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("gblocks") - 1))).select(
        "lang", "block", F.least("gblock", "other").alias("ga"), F.greatest("gblock", "other").alias("gb"), "gblock", "source", "least",
        F.coalesce("width", F.lit(0)).alias("width"), F.col("found.pos").alias("pos"), F.col("found.share").alias("shares"),
    )
    parts = cells.groupBy("lang", "block", "ga", "gb").applyInArrow(cell_differences, CELL)
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    # Each unordered pair, once from either side.
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return summed.withColumn("pair", F.explode(ends)).select("lang", "pair.source", "pair.item", "value")


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, terms: int = TERMS, groups_per_block: int = GROUPS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other sources of the
    language by their difference, part ``term`` the terms that a source has more of than its
    language, up to ``ranks``."""
    plain = narrow(docs, lang="string", source="string", text="string").na.fill("")
    counts = keep(term_counts(plain), "counts")
    found, langs = kept_terms(counts, least_docs, terms)
    found = keep(found, "kept")
    slices = counts.select("lang", "source", "term", "n").join(found, ["lang", "term"])
    slices = keep(slices, "slices")
    own = slices.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["own", "kept", "lang_n", "blocks"])
    groups = keep(groups.withColumn("least", share(F.lit(0).cast("bigint"), F.col("own"), F.col("kept"))), "groups")
    shared = slices.join(groups.select("lang", "source", "own", "kept", "lang_n"), ["lang", "source"]).withColumn(
        "share", share(F.col("n"), F.col("own"), F.col("kept"))
    )
    pairs = pair_differences(
        groups.select("lang", "source", "least", "blocks"), shared.select("lang", "source", "block", "pos", "share"),
        found.select("lang", "block", "width").distinct(), groups_per_block,
    )
    more = shared.withColumn("value", F.col("share") - share(F.col("total"), F.col("lang_n"), F.col("kept"))).where("value > 0")
    best = ranked(more.select("lang", "source", F.col("term").alias("item"), "value")).where(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(pairs).withColumn("part", F.lit("pair")).select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))
