"""URL filter: host and path rules first, gradient-boosted trees for the rest.

DataFrame and SQL operations only, with Spark's own boosted trees. A URL becomes lexical
features: length, depth, digit ratio, entropy, parameter counts, and statistics of its suffix.
Suffixes fall into a fixed number of slots, so that their statistics fit a broadcast whatever
the number of suffixes; a slot's share of blocked URLs is shrunk towards the share of all. The
labelled URLs of the query are those that a rule decides.

Definitions: a null URL, and one without ``://``, has an empty host and path, fits no rule and is
scored by its (empty) features. Repeated rows are judged alike and stay, also rows without id; an
empty table gives no rows. URLs are read whole, however long. Other columns are passed by. A tie
of rules of one length goes to the smaller text, and a score of just ``block_at`` blocks. Without
labelled URLs of both kinds there is no model, and every URL that no rule fits is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import narrow, one_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Slots of suffix statistics: the size of a broadcast, whatever the input.
SUFFIX_SLOTS = 4096
# Documents' worth of prior belief in the overall share, for each slot.
SUFFIX_PRIOR = 20.0
# At most about this many labelled URLs are used for fitting, taken by a hash of the URL.
MAX_TRAIN_ROWS = 200_000
BLOCK_AT = 0.5


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``where`` (host and path), which covers the host's subdomains too."""

    verdict: str
    where: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2]


def host_of(url: Column) -> Column:
    start = F.locate("://", url)
    rest = F.substring(url, start + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(start > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    start = F.locate("://", url)
    rest = F.substring(url, start + 3, F.length(url))
    return F.when(start > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as text; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r.where), r.where))
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            r.where,
        )
        for r in longest
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def entropy_of(text: Column) -> Column:
    """Bits per character. Sorted characters make each run of equals one block."""
    size = F.length(text)
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    counts = F.transform(
        F.array_distinct(signs), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    )
    return F.coalesce(F.aggregate(counts, F.lit(0.0), lambda t, p: t - p * F.log2(p)), F.lit(0.0))


def features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and ``suffix_slot`` to rows with ``url, host, path``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.length(url)
    count = lambda signs, of: F.length(of) - F.length(F.translate(of, signs, ""))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    suffix = F.substring_index("host", ".", -1)
    return urls.select(
        "*",
        length.cast("double").alias("f_length"),
        F.length("host").cast("double").alias("f_host_length"),
        count("/", F.col("path")).cast("double").alias("f_depth"),
        count(".", F.col("host")).cast("double").alias("f_labels"),
        count("-", F.col("host")).cast("double").alias("f_hyphens"),
        (count("0123456789", url) / F.greatest(length, F.lit(1))).alias("f_digits"),
        entropy_of(F.col("host")).alias("f_entropy"),
        F.when(query == "", 0).otherwise(count("&", query) + 1).cast("double").alias("f_parameters"),
        F.startswith(url, F.lit("https")).cast("double").alias("f_secure"),
        F.pmod(F.xxhash64(suffix), F.lit(SUFFIX_SLOTS)).cast("int").alias("suffix_slot"),
    )


FEATURES = [
    "f_length", "f_host_length", "f_depth", "f_labels", "f_hyphens", "f_digits", "f_entropy",
    "f_parameters", "f_secure", "f_suffix_rate", "f_suffix_count",
]


def suffix_statistics(labelled: DataFrame, share: float) -> DataFrame:
    """``suffix_slot``, its shrunken share of blocked URLs, and the log of its labelled URLs: one
    row per slot in use, so ``SUFFIX_SLOTS`` rows at most."""
    rows = labelled.groupBy("suffix_slot").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")
    )
    rate = (F.col("blocked") + SUFFIX_PRIOR * share) / (F.col("n") + SUFFIX_PRIOR)
    return rows.select("suffix_slot", rate.alias("f_suffix_rate"), F.log1p("n").alias("f_suffix_count"))


def with_suffix(rows: DataFrame, statistics: DataFrame, share: float) -> DataFrame:
    joined = rows.join(F.broadcast(statistics), "suffix_slot", "left")
    return joined.fillna({"f_suffix_rate": share, "f_suffix_count": 0.0})


def fit(labelled: DataFrame, trees: int = 12, depth: int = 3, max_train_rows: int = MAX_TRAIN_ROWS):
    """Model, suffix statistics and overall share from rows with features and ``label`` 0 or 1;
    None where either label is missing."""
    row = one_row(labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")))
    if not row["n"] or row["share"] in (0.0, 1.0):
        return None
    share = row["share"]
    statistics = suffix_statistics(labelled, share)
    part = min(1.0, max_train_rows / row["n"])
    sample = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(part * 1_000_000))
    # Rows alike in all features and the label count once, with their number as weight.
    rows = with_suffix(sample, statistics, share)
    rows = rows.groupBy("label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(
        labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32
    )
    return trees.fit(vector.transform(rows).select("label", "weight", "features")), statistics, share


def judge(
    pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, block_at: float = BLOCK_AT, **fitting
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score``, one row per row of ``pages``.

    ``labels`` (``url, label``: 1 to block) are the labelled URLs; without them those of
    ``pages`` that a rule decides are.
    """
    def prepared(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        return features(rows)

    verdicts = {rule.where: rule.verdict for rule in rules}
    said = reduce(
        lambda done, item: done.when(F.col("rule") == item[0], item[1]), verdicts.items(), F
    ) if verdicts else F.lit(None).cast("string")
    rows = narrow(pages, page_id="bigint", url="string")
    rows = prepared(rows).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("said", said)
    if labels is None:
        labelled = rows.where("rule is not null").withColumn("label", (F.col("said") == "block").cast("double"))
    else:
        labelled = prepared(narrow(labels, url="string", label="double").where("label is not null"))
    fitted = fit(labelled, **fitting)
    if fitted is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        model, statistics, share = fitted
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        scored = model.transform(vector.transform(with_suffix(rows, statistics, share)))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("said", F.when(F.col("score") >= block_at, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "score")
