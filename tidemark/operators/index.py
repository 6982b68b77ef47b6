"""The searchable replica's derived tables: analysed documents and the term dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.coercion import bind
from tidemark.functions.text import analyse, run_lengths, searchable_text
from tidemark.functions.vectors import DEFAULT_DIMS, hash_embedding
from tidemark.operators.fold import is_live, source_form
from tidemark.operators.inverted import POSTING, write_inverted
from tidemark.operators.neighbours import NEIGHBOUR, write_neighbours
from tidemark.session import staging_dir

# Analysed fields: the tag that marks a term of the field, and the field's column.
FIELDS = {"t": "title", "s": "summary", "c": "last_comment"}
# The provider of vectors made from hashed words.
HASH_PROVIDER = "hash"
MANIFEST = "provider string, dims int, fields array<string>, buckets int, posting_rows bigint, neighbour_buckets int"


@dataclass(frozen=True)
class TextIndex:
    """Tables of one index. ``docs`` has a row per document with everything needed to score
    it; ``terms`` has a row per tagged term; ``postings``, where they are stored, a row per live
    document and term, in ``buckets`` folders by term; ``neighbours``, where they are stored, the
    dictionary's deletion neighbourhoods and the number of their folders. ``provider`` and ``dims`` say where vectors
    come from and how long they are."""

    docs: DataFrame
    terms: DataFrame
    counts: dict[str, int]
    mean_lengths: dict[str, float]
    documents: int
    postings: DataFrame | None = None
    buckets: int = 0
    posting_rows: int = 0
    neighbours: tuple[DataFrame, int] | None = None
    provider: str = HASH_PROVIDER
    dims: int = DEFAULT_DIMS


class ContractError(ValueError):
    """An index was made otherwise than its user expects."""


def embed_documents(docs: DataFrame, dims: int = DEFAULT_DIMS) -> DataFrame:
    """Add hash vectors of the searchable text to live documents."""
    text = searchable_text(F.col("title"), F.col("summary"), F.col("last_comment"))
    bound = bind(docs, _text=F.when(is_live(), text))
    made = bound.withColumn("_vector", hash_embedding(F.col("_text"), dims))
    return bind(made, embedding=F.when(F.col("_text").isNotNull(), F.col("_vector"))).drop("_text", "_vector")


def embed_with(docs: DataFrame, make_provider: Callable[[], Callable], dims: int) -> DataFrame:
    """Add vectors of a model to live documents.

    ``make_provider`` runs once per task and returns a function from a list of texts to a
    list of vectors, called once per Arrow batch.
    """
    text = searchable_text(F.col("title"), F.col("summary"), F.col("last_comment"))
    shaped = docs.drop("embedding").withColumn("_text", F.when(is_live(), text))
    out = shaped.drop("_text").withColumn("embedding", F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator) -> Iterator:
        embed = make_provider()
        for pdf in batches:
            live = pdf["_text"].notna()
            vectors = iter(embed(pdf.loc[live, "_text"].tolist()))
            result = pdf.drop(columns="_text")
            result["embedding"] = [checked(next(vectors)) if ok else None for ok in live]
            yield result

    def checked(vector):
        if len(vector) != dims:
            raise ValueError(f"provider returned {len(vector)} dimensions, expected {dims}")
        return vector

    return shaped.mapInPandas(run, out)


def analysed(docs: DataFrame) -> DataFrame:
    """Documents with their distinct tagged terms and counts, made row by row: building the
    index shuffles no text. Deleted documents stay, for they count in the statistics."""
    shaped = source_form(docs)
    terms = {f"{tag}_terms": analyse(F.col(column)) for tag, column in FIELDS.items()}
    bound = bind(shaped, **terms)

    def tagged(tag: str) -> Column:
        return F.transform(F.col(f"{tag}_terms"), lambda term: F.concat(F.lit(f"{tag}:"), term))

    bound = bind(bound, runs=run_lengths(F.concat(*[tagged(tag) for tag in FIELDS]), "term", "n"))
    lengths = [F.size(f"{tag}_terms").alias(f"{tag}_len") for tag in FIELDS]
    return bound.select(
        "*",
        *lengths,
        F.col("t_terms").alias("title_terms"),
        F.coalesce(F.col("runs.term"), F.array().cast("array<string>")).alias("terms"),
        F.coalesce(F.col("runs.n"), F.array().cast("array<int>")).alias("tfs"),
    ).drop("runs", *terms)


def postings(docs: DataFrame) -> DataFrame:
    """One row per document, field and term."""
    pairs = docs.select(
        "id",
        "t_len", "s_len", "c_len",
        F.inline(F.arrays_zip("terms", "tfs")),
    )
    tag = F.substring("terms", 1, 1)
    length = F.when(tag == "t", F.col("t_len")).when(tag == "s", F.col("s_len")).otherwise(
        F.col("c_len")
    )
    return pairs.select(
        "id", tag.alias("field"), F.substring("terms", 3, 1_000_000_000).alias("term"),
        F.col("tfs").alias("tf"), length.alias("length"),
    )


def field_statistics(docs: DataFrame) -> DataFrame:
    """Per field: documents that have it and its mean length."""
    rows = F.array(
        *[
            F.struct(F.lit(tag).alias("field"), F.col(f"{tag}_len").alias("length"))
            for tag in FIELDS
        ]
    )
    lengths = docs.select(F.inline(rows)).where(F.col("length") > 0)
    return lengths.groupBy("field").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("length").alias("total_length")
    )


def term_statistics(docs: DataFrame) -> DataFrame:
    """Documents per tagged term, combined before the shuffle."""
    return (
        docs.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def write_index(docs: DataFrame, path: str, dims: int = DEFAULT_DIMS, provider: str = HASH_PROVIDER) -> None:
    """Analyse and embed the documents once and store the tables under ``path``, with a manifest
    of what they were made with. An index already there must have been made alike."""
    spark = docs.sparkSession
    check_contract(manifest(spark, path), provider, dims)
    prepared = analysed(docs)
    if "embedding" not in docs.columns:
        if provider != HASH_PROVIDER:
            raise ContractError(f"documents have no vectors of {provider}")
        prepared = embed_documents(prepared, dims)
    prepared.write.mode("overwrite").parquet(f"{path}/docs")
    stored = spark.read.parquet(f"{path}/docs")
    wrong = stored.where(is_live() & (F.size("embedding") != dims)).limit(1).count()
    if wrong:
        raise ContractError(f"vectors of another length than {dims}")
    term_statistics(stored).write.mode("overwrite").parquet(f"{path}/terms")
    buckets, rows = write_inverted(stored, f"{path}/postings")
    near = write_neighbours(spark.read.parquet(f"{path}/terms"), f"{path}/neighbours")
    row = (provider, dims, sorted(stored.columns), buckets, rows, near)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str):
    """What the index under ``path`` was made with, or None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").first()


def check_contract(made, provider: str | None, dims: int | None) -> None:
    """Raise if an index (its manifest row, or None) was made with another provider of vectors or
    with vectors of another length."""
    if made is None:
        return
    for name, wanted in (("provider", provider), ("dims", dims)):
        if wanted is not None and made[name] != wanted:
            raise ContractError(f"the index has {name} {made[name]}, not {wanted}")


def open_index(spark: SparkSession, path: str, provider: str | None = None, dims: int | None = None) -> TextIndex:
    """The index under ``path``. A ``provider`` or length of vectors that is named must be the
    one it was made with."""
    made = manifest(spark, path)
    if made is None:
        raise ContractError(f"no index under {path}")
    check_contract(made, provider, dims)
    docs = spark.read.parquet(f"{path}/docs")
    rows = field_statistics(docs).collect()  # one row per field
    counts = {row["field"]: row["documents"] for row in rows}
    means = {row["field"]: row["total_length"] / row["documents"] for row in rows}
    lists = spark.read.schema(f"{POSTING}, bucket int").parquet(f"{path}/postings")
    # An index made before neighbourhoods were stored has none.
    near = made["neighbour_buckets"]
    stored = near and (spark.read.schema(f"{NEIGHBOUR}, bucket int").parquet(f"{path}/neighbours"), near)
    return TextIndex(
        docs, spark.read.parquet(f"{path}/terms"), counts, means, docs.count(), lists, made["buckets"], made["posting_rows"],
        stored or None, made["provider"], made["dims"],
    )


def build_index(docs: DataFrame, dims: int = DEFAULT_DIMS, path: str | None = None, provider: str = HASH_PROVIDER) -> TextIndex:
    spark = docs.sparkSession
    path = path or staging_dir(spark, "index")
    write_index(docs, path, dims, provider)
    return open_index(spark, path)
