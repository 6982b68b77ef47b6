"""What the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship_package, staging_dir

# White space of the word contracts: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read where it lies; tasks find this package wherever they start."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as ``new=type`` casts of the old names. Whatever else the table
    holds, under whatever names, can then clash with nothing."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: later readers reuse the work, and a lost
    executor costs a read. Packed more tightly than by default, since it is read once or twice."""
    path = staging_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` for a join of two sides that both grow with the input: they meet by sorting. Spark sizes
    a table by its packed files, and takes a row that an explode or a Python function makes many of
    for one, so it might send millions of rows through the driver for a small table."""
    return df.hint("merge")


def byte_chunks(data: bytes, between: re.Pattern, size: int = 1 << 20):
    """``data`` in pieces of about ``size`` bytes, cut only where ``between`` matches, so that lists
    of a very long text's words stay short."""
    at = 0
    while len(data) - at > size:
        cut = between.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:] if at else data


def replace(old: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as ``keep`` does, and remove ``old``, a kept table that nothing reads after it:
    tables of rounds don't add up."""
    new = keep(df, label)
    forget(old)
    return new


def forget(kept: DataFrame) -> None:
    """Remove the folder of a kept table."""
    spark = kept.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(kept.inputFiles()[0]).getParent() if kept.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def one_row(df: DataFrame):
    """The only row of an aggregate without groups."""
    return df.collect()[0]


def where_in(docs: DataFrame, kept: DataFrame, key: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose ``key`` (name in ``kept``, and expression over ``docs``) is among
    those of ``kept``. Null is a value like any other, and rows alike in the key go together."""
    wanted = kept.select(*key).distinct()
    same = [of.eqNullSafe(wanted[name]) for name, of in key.items()]
    condition = same[0]
    for each in same[1:]:
        condition = condition & each
    return docs.join(wanted, condition, "left_semi")
