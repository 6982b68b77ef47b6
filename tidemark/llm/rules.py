"""Quality rules per document and per host, in DataFrame operations only.

Every text is measured once (see ``measures``). Documents that fail a base rule are counted by
host, here the ``source`` of a document. A host's failure rate is then shrunk towards that of
all hosts by an empirical beta prior, whose two parameters come from the mean and the spread of
the hosts' rates; a host whose shrunken rate passes ``host_limit`` takes its other documents with
it. Hosts are counted before the shuffle, and the verdicts come back by a join that Spark may
split where one host is hot.

Definitions: a null text has no words, a null host is a host of its own, repeated rows count
each time, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, keep, narrow, one_row, where_in

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
# A host is left out when more than this share of its documents is thought to fail.
HOST_LIMIT = 0.5


@dataclass(frozen=True)
class Prior:
    """A beta distribution of failure rates: ``alpha`` failures in ``alpha + beta`` documents."""

    alpha: float
    beta: float


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null."""
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    words = F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(words)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of every 3-word window, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def ranked_windows(hashes: Column) -> Column:
    """Windows sorted by hash, so that equal ones become neighbours: the work is n log n however
    long the text."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_starts(ranked: Column) -> Column:
    """Sorted positions of the windows found twice or more."""

    def twice(x, i):
        left = (i > 0) & (F.get(ranked, i - 1)["h"] == x["h"])
        right = F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False))
        return F.coalesce(left, F.lit(False)) | right

    return F.array_sort(F.transform(F.filter(ranked, twice), lambda x: x["i"]))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, host`` and the measures of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, ASCII_SPACE, "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(ASCII_SPACE)) != "")
    base = docs.select(
        "doc_id",
        "host",
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        words_of(text).alias("_words"),
    )
    # Arrays that several columns need are built in steps of their own; the generator between
    # keeps them from being built once for each.
    base = base.withColumn("_hashes", F.explode(F.array(window_hashes(F.col("_words")))))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    base = base.withColumn("_ranked", F.explode(F.array(F.when(some, ranked_windows(F.col("_hashes"))))))
    base = base.withColumn("_starts", F.explode(F.array(repeated_starts(F.col("_ranked")))))
    starts = F.col("_starts")
    # Each start covers three words, or as many as lie before the next start.
    covered = F.aggregate(
        F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return base.select(
        "doc_id",
        "host",
        F.size("_words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    too_short = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return too_short | repeats


def by_host(measured: DataFrame) -> DataFrame:
    """``host, docs, failures``, one row per host."""
    return measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failures")
    )


def fit_prior(hosts: DataFrame) -> Prior:
    """Method of moments over all hosts; only sums come back. Hosts that differ no more than
    chance allows give a strong prior, hosts that differ a lot a weak one."""
    rate = F.col("failures") / F.col("docs")
    row = one_row(
        hosts.agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(rate).alias("mean"),
            F.var_pop(rate).alias("spread"),
            F.avg(1 / F.col("docs")).alias("inverse"),
        )
    )
    if not row["n"]:
        return Prior(0.5, 0.5)
    mean = min(max(row["mean"], 1e-6), 1 - 1e-6)
    chance = mean * (1 - mean)
    # The spread that hosts of these sizes show by chance alone is taken off first.
    excess = (row["spread"] - chance * row["inverse"]) / max(1 - row["inverse"], 1e-9)
    strength = chance / max(excess, 1e-6 * chance) - 1
    strength = min(max(strength, 1.0), 1000.0)
    return Prior(mean * strength, (1 - mean) * strength)


def host_verdicts(hosts: DataFrame, prior: Prior, host_limit: float = HOST_LIMIT) -> DataFrame:
    """``host, host_rate, host_kept``."""
    rate = (F.col("failures") + prior.alpha) / (F.col("docs") + prior.alpha + prior.beta)
    return hosts.select("host", rate.alias("host_rate")).withColumn(
        "host_kept", F.col("host_rate") <= host_limit
    )


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    host_rate``: one row per row of ``docs``."""
    rows = narrow(docs, doc_id="bigint", text="string", **{host: "string"}).withColumnRenamed(host, "host")
    return verdicts_of(measures(rows), host_limit).drop("host")


def keep_good(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Rows alike in id, host and text
    are alike in their verdict."""
    rows = docs.select(
        F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(1)).alias("doc_id"), "text", F.col(host).cast("string").alias("host")
    )
    judged = verdicts_of(measures(rows), host_limit).where("kept")
    key = {"doc_id": F.xxhash64(docs["doc_id"], docs["text"], F.lit(1)), "host": docs[host].cast("string")}
    return where_in(docs, judged, key)


def verdicts_of(measured: DataFrame, host_limit: float) -> DataFrame:
    measured = keep(measured.withColumn("base_failed", base_failed()), "rules")
    hosts = by_host(measured)
    verdicts = host_verdicts(hosts, fit_prior(hosts), host_limit)
    joined = measured.alias("m").join(verdicts.alias("v"), F.col("m.host").eqNullSafe(F.col("v.host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"),
        "host_rate", F.col("m.host").alias("host"),
    )
