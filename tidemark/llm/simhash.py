"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into segments; the numbers of set bits in them are a point of
small integers. Two fingerprints that differ in d bits have points at most d apart in Manhattan
distance, so that distance is a lower bound. Points within 2 of each other have a point between
them, at most 1 from both: every fingerprint is entered in the grid cells at distance 0 and 1 of
its own, and fingerprints that may link meet in a cell. Those that do are compared exactly.

Equal fingerprints count once. In a crowded cell no pairs are made: fingerprints that differ in
at most 2 bits share one that differs in at most 1 bit from both, so each is tied to its 65
neighbours, and those hubs link exactly the same fingerprints. Work is linear either way.

Definitions: a text without words has fingerprint zero and is linked like any other; fewer words
than a shingle are one shingle; repeated rows are linked to each other; rows without id are
linked, and a component of such rows alone has no id; texts of any length are read whole; an empty
table gives no rows. Of other columns only ``one_of_each`` passes any on, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import keep, large, narrow
from tidemark.llm.components import components

SHINGLE = 3
SEED = 42
SEGMENTS, SEGMENT_BITS = 16, 4
# Cells with more fingerprints than this are linked by hubs.
CROWDED = 32
# Shingle hashes whose bits are counted at a time.
COUNTED = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingles' hashes, over more than half of them."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    elif shingle == 3:
        shingles = [b"%b %b %b" % three for three in zip(words, words[1:], words[2:])]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text, as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(text, shingle) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return narrow(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, fp bigint")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def cell_of(fp: Column) -> Column:
    """The point of a fingerprint: four bits per segment hold its count plus one, so that one
    less and one more stay within them."""
    ones = 2**SEGMENT_BITS - 1
    cell = None
    for at in range(SEGMENTS):
        segment = F.shiftrightunsigned(fp, SEGMENT_BITS * at).bitwiseAND(F.lit(ones))
        part = F.shiftleft((F.bit_count(segment) + 1).cast("bigint"), SEGMENT_BITS * at)
        cell = part if cell is None else cell.bitwiseOR(part)
    return cell


def grid(distinct: DataFrame, print_of: Column | None = None) -> DataFrame:
    """``fp, cell``: every cell within Manhattan distance 1 of a fingerprint's point. Where ``fp``
    is more than the fingerprint, ``print_of`` takes that from it."""
    cell = F.col("_cell")
    steps = [F.shiftleft(F.lit(1).cast("bigint"), SEGMENT_BITS * at) for at in range(SEGMENTS)]
    around = F.array(cell, *(cell + s for s in steps), *(cell - s for s in steps))
    return distinct.withColumn("_cell", cell_of(F.col("fp") if print_of is None else print_of)).select("fp", F.explode(around).alias("cell"))


def close(a: Column, b: Column, bits: int = 2) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def shared_cells(distinct: DataFrame) -> DataFrame:
    """``cell, fp, n``: cells that hold several fingerprints. Most hold one; they go before anything
    else is joined."""
    cells = grid(distinct)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cells.join(large(sizes), "cell")


def hub_links(dense: DataFrame) -> DataFrame:
    """``a, b``: fingerprints of crowded cells, each with the hubs that others share with it."""
    flips = [F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), at)) for at in range(64)]
    hubs = dense.select(F.col("fp").alias("a"), F.explode(F.array(F.col("fp"), *flips)).alias("b"))
    # A hub that one fingerprint has links nothing.
    used = hubs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
    return hubs.join(large(used), "b").select("a", "b")


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fp``), or between one and a hub that
    others share, such that exactly those joined by links of at most 2 bits are connected."""
    shared = keep(shared_cells(distinct), "cells")
    sparse = shared.where(F.col("n") <= crowded).select("cell", "fp")
    left, right = sparse.withColumnRenamed("fp", "a"), large(sparse.withColumnRenamed("fp", "b"))
    pairs = left.join(right, (left["cell"] == right["cell"]) & (F.col("a") < F.col("b")) & close(F.col("a"), F.col("b")))
    dense = shared.where(F.col("n") > crowded).select("fp").distinct()
    return pairs.select("a", "b").distinct().unionByName(hub_links(dense))


def rooted(classes: DataFrame) -> DataFrame:
    """``fp, first, root`` of a written table of distinct fingerprints (``fp, first``): ``root`` is
    the same for fingerprints that are linked."""
    roots = components(links(classes.select("fp")))
    found = classes.join(large(roots.withColumnRenamed("node", "fp")), "fp", "left")
    return found.select("fp", "first", F.coalesce("root", "fp").alias("root"))


def group(prints: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of a written table of fingerprints."""
    classes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = keep(rooted(classes), "roots")
    smallest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = found.join(large(smallest), "root").select("fp", "component_id")
    return prints.join(large(named), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``."""
    prints = keep(fingerprints(docs, shingle), "fingerprints")
    return group(prints).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows of ``docs``, one of each component: that with the smallest id. Rows without id come
    last; of rows alike in id it is any one, always the same of one written table."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )

    def run(batches):
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("whole"), batch.column("doc_id"), pa.array(found, pa.int64())], ["whole", "doc_id", "fp"])

    schema = StructType([*rows.schema.fields[:2], StructField("fp", LongType())])
    # Numbered once written: the numbers must not change between the two reads.
    printed = keep(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "printed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    classes = keep(printed.groupBy("fp").agg(first), "classes")
    chosen = rooted(classes).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return printed.join(chosen, "row", "left_semi").select(*(F.col(f"whole.`{c}`").alias(c) for c in docs.columns))
