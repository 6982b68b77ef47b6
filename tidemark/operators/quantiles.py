"""Quantiles from summaries that can be added up.

A value is kept as a whole number of millionths with its ``BITS`` leading binary digits; the
others become zero. A summary is the number of values per such slot, so two summaries are merged
by adding their counts, in any order, and one made per minute serves for an hour or a day. There
are at most ``64 * 2 ** (BITS - 1)`` slots per key, however many values it has.

A quantile is the middle of the slot that holds the value of that rank. The slot's width is at most
``2 ** (1 - BITS)`` of any value in it, so the middle is off by no more than ``2 ** -BITS`` of the
value, and is the value itself below ``2 ** BITS`` millionths.

Definitions: values below zero count as zero, values above ``LARGEST`` as that; nulls and values
that are not numbers are left out; a key without values has no quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BITS = 7
SCALE = 1_000_000
# The largest number of millionths that is told from larger ones.
LARGEST = 2.0**62


def _dropped(whole: Column) -> Column:
    """How many binary digits of a whole number are not kept."""
    return F.greatest(F.lit(0), F.length(F.bin(whole)) - F.lit(BITS))


def summarize(values: DataFrame, keys: Sequence[str], value: str = "seconds") -> DataFrame:
    """``keys, slot, n`` of all values; combined before the shuffle."""
    number = F.col(value).cast("double")
    whole = F.floor(F.least(F.greatest(number, F.lit(0.0)) * F.lit(float(SCALE)), F.lit(LARGEST))).cast("bigint")
    known = values.where(number.isNotNull() & ~F.isnan(number)).select(*keys, whole.alias("whole"))
    dropped = _dropped(F.col("whole"))
    slot = F.call_function("shiftleft", F.call_function("shiftright", F.col("whole"), dropped), dropped)
    return known.groupBy(*keys, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def merge(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One summary per ``keys`` from those of finer ones."""
    return summaries.groupBy(*keys, "slot").agg(F.sum("n").alias("n"))


def quantiles(summary: DataFrame, keys: Sequence[str], wanted: Sequence[float], name: str = "seconds") -> DataFrame:
    """``keys, quantile, name, observations``. A window holds the slots of one key."""
    upward = W.partitionBy(*keys).orderBy("slot")
    ranked = summary.withColumns(
        {
            "upto": F.sum("n").over(upward.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "observations": F.sum("n").over(W.partitionBy(*keys)),
        }
    )
    asked = ranked.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in wanted])))
    target = F.col("quantile") * F.col("observations")
    before = F.col("upto") - F.col("n")
    # The slot in which the count passes the rank; the least one for a quantile of 0.
    holding = asked.where((F.col("upto") >= target) & ((before < target) | (before == 0)))
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), _dropped(F.col("slot")))
    middle = F.col("slot") + F.call_function("shiftright", width, F.lit(1))
    return holding.select(*keys, "quantile", (middle / F.lit(float(SCALE))).alias(name), "observations")


def exact_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The median of all values per key, between the two middle ones if their number is even. Equal
    values are counted before the shuffle, and a key's counts are passed in order, never held."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    upto = W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(upto)).join(totals, key)
    low = F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col(value)))
    high = F.min(F.when(2 * F.col("upto") > F.col("total"), F.col(value)))
    return placed.groupBy(key).agg((low + (high - low) * 0.5).alias("exact_median"))
