"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text is measured once, in ``FEATURES`` transformed so that ordinary documents lie
close to a normal distribution. Both classes get a mean and a covariance, from sums that Spark
aggregates; the covariance is shrunk towards a multiple of the pooled diagonal, and its Cholesky
factor is computed once and kept. A score is the logistic of the difference of the two Gaussian
log-densities (Mahalanobis distances through the factors) plus the log of the class shares.

Definitions: a null text is empty, and an empty text has a score like any other; repeated labels
of a document count once, with the smaller value; labels other than 0 and 1 are ignored; a
document without id has no label and isn't held out. Repeated rows stay and score alike, and a
labelled one counts as often as it is there; an empty table gives no rows; texts are read whole,
however long; other columns are passed by, or returned as they are by ``keep_good``. Without labels
of both kinds every score is the share of label 1, or one half where there are no labels.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, narrow, where_in

FEATURES = [
    "log_words", "log_word_length", "symbols", "digits", "capitals", "punctuation", "bars",
    "shouts", "distinct", "top_word", "long_words", "line_length",
]
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_SIGNS = {
    "symbols": b"#*$%&<>@^~=+_{}[]\\",
    "digits": b"0123456789",
    "punctuation": b".,;:?",
    "bars": b"|",
    "shouts": b"!",
}


def statistics(text: str) -> list[float]:
    """One row of ``FEATURES``; shares go through a square root, which evens out their spread."""
    words = text.split()
    n, data = len(words), text.encode("utf-8", "replace")
    signs = {kind: len(data) - len(data.translate(None, drop)) for kind, drop in _SIGNS.items()}
    counts = Counter(words)
    letters = max(1, sum(map(len, words)))
    capitals = sum(map(str.isupper, words))
    top = counts.most_common(1)[0][1] if n else 0
    share = lambda part, whole: math.sqrt(part / whole) if whole else 0.0
    return [
        math.log1p(n),
        math.log1p(letters / max(1, n)),
        share(signs["symbols"], letters),
        share(signs["digits"], letters),
        share(capitals, n),
        share(signs["punctuation"], letters),
        share(signs["bars"], letters),
        share(signs["shouts"], letters),
        len(counts) / max(1.0, n) ** 0.9,
        share(top, n),
        share(sum(len(w) > 14 for w in words), n),
        math.log1p(n / (1 + text.count("\n"))),
    ]


def measure(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``doc_id, key, x``: the statistics of every whole text, and what tells rows apart."""

    def run(batches):
        for batch in batches:
            rows = [statistics(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "key", "x"]
            )

    key = F.lit(0).cast("bigint") if key is None else key
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), key.alias("key"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, key bigint, x array<double>")


@dataclass(frozen=True)
class Gaussian:
    """A class: log of its share, mean, inverse of the Cholesky factor, log-determinant."""

    log_share: float
    mean: np.ndarray
    whiten: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.log_share - 0.5 * ((z * z).sum(axis=1) + self.log_det)


@dataclass(frozen=True)
class Model:
    """``low`` and ``high`` are the classes 0 and 1; without them ``share`` is every score."""

    share: float
    low: Gaussian | None = None
    high: Gaussian | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.share)
        odds = self.high.log_density(x) - self.low.log_density(x)
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))


def moments(labelled: DataFrame, size: int) -> DataFrame:
    """One row per class: the number of rows, the sums, and the sums of products."""
    x = [F.col("x")[i] for i in range(size)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(size)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(size) for j in range(i + 1)]
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def fit(labelled: DataFrame, shrinkage: float = 0.05, size: int = len(FEATURES)) -> Model:
    """From rows ``x, label``. What comes back to the driver is two rows of sums."""
    rows = {row["label"]: row for row in moments(labelled, size).collect()}
    total = sum(row["n"] for row in rows.values())
    if len(rows) < 2:
        return Model(float(next(iter(rows))) if rows else 0.5)
    means, scatters = {}, {}
    for label, row in rows.items():
        n = row["n"]
        means[label] = np.array([row[f"s{i}"] for i in range(size)]) / n
        products = np.zeros((size, size))
        for i in range(size):
            for j in range(i + 1):
                products[i, j] = products[j, i] = row[f"p{i}_{j}"] / n
        scatters[label] = products - np.outer(means[label], means[label])
    pooled = sum(rows[k]["n"] / total * scatters[k] for k in rows)
    # A feature that never varies gets a small spread, so that every factor exists.
    target = np.diag(np.maximum(np.diag(pooled), 1e-4))
    classes = {}
    for label, row in rows.items():
        # Classes with few rows lean more on the common target.
        part = min(1.0, shrinkage + size / (size + row["n"]))
        factor = np.linalg.cholesky((1 - part) * scatters[label] + part * target)
        classes[label] = Gaussian(
            math.log(row["n"] / total), means[label], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())
        )
    return Model(rows[1]["n"] / total, classes[0], classes[1])


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``doc_id, key, score`` of measured documents; the factors travel with the task."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(model.score(x))], ["doc_id", "key", "score"]
            )

    return measured.mapInArrow(run, "doc_id bigint, key bigint, score double")


def held_out(doc_id: Column) -> Column:
    fold = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns. Rows alike in
    id and text have one score."""
    key = F.xxhash64(docs["doc_id"], docs["text"], F.lit(2))
    scored = scored_by(measure(docs, key), labels).where(F.col("score") >= threshold)
    return where_in(docs, scored, {"key": key})


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``, learned only from
    labelled documents that aren't held out."""
    return scored_by(measure(docs), labels).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def scored_by(measured: DataFrame, labels: DataFrame) -> DataFrame:
    measured = keep(measured, "quality")
    marks = narrow(labels, doc_id="bigint", quality="int").where("quality in (0, 1)")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    model = fit(measured.join(marks, "doc_id"))
    return score(measured, model)
