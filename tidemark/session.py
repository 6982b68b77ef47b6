"""Session set-up, shared staging storage and size-checked joins."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count a side may have before it is no longer broadcast.
MAX_BROADCAST_ROWS = 150_000


def build_session(app_name: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Settings every job here relies on; safe to call on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Of a key that a message repeats, the last value counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions run inside
    tasks are found there whatever the launch directory."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def staging_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in the cluster's shared checkpoint storage.

    The cluster names that storage in ``spark.checkpoint.dir``. Only when the setting is
    absent on one machine (tests) is a temporary folder chosen, once per session; on a cluster
    there would be one on each machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: later readers reuse the work,
    and a lost executor costs a re-read instead of a recomputation of the whole lineage."""
    spark = df.sparkSession
    path = staging_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table. A table with fewer splits than cores, such as a single small
    file, is spread over the cores; a large one is left exactly as it is laid out."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def equi_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    *,
    spread: Column,
    small_rows: int,
    how: str = "inner",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Join a large table to a smaller one without letting a hot key fill one task.

    ``small_rows`` is a proven upper bound of the small side. Within ``max_broadcast_rows``
    the small side is broadcast and the large side is never shuffled. Beyond it the large
    side is spread over ``salts`` sub-keys by ``spread`` and the small side is repeated once
    per sub-key, so a key with a third of all rows is divided over that many tasks.
    """
    if small_rows <= max_broadcast_rows:
        return big.join(F.broadcast(small), keys, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeats = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_small = small.withColumn("_salt", F.explode(repeats))
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")


def hot_key_join(
    big: DataFrame, unique: DataFrame, keys: list[str], hot_rows: int = 1_000_000
) -> DataFrame:
    """Inner join to a table with one row per key that may itself be too large to broadcast.

    Keys with more than ``hot_rows`` rows cannot be many: at most the row count divided by
    ``hot_rows``. They and their single partner rows are broadcast, so that their rows stay
    where they are; all other keys meet in an ordinary shuffle, in groups of bounded size.
    """
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = F.broadcast(hot.select(*keys))
    few = F.broadcast(unique.join(hot, keys, "left_semi"))
    rest = big.join(hot, keys, "left_anti").join(unique, keys)
    return rest.unionByName(big.join(few, keys))
