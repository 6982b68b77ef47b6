"""Log-structured tables written by streams: one folder per batch, merged when read.

A batch overwrites its own folder, so a retried batch cannot count twice. Readers combine
the latest snapshot with the batches it does not cover; folding is associative, so neither the
cut into batches nor the moment of a snapshot changes what is read.

Folders are named by run and batch. A run is one checkpoint: a replay with a new checkpoint,
which numbers its batches from 0 again, is a run of its own and hides behind no snapshot. What
counts as written is read from folder names and their success marks, without a job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.vectors import DEFAULT_DIMS
from tidemark.operators import edits as edit_ops
from tidemark.operators import fold
from tidemark.operators.enrich import enrich
from tidemark.operators.index import embed_documents
from tidemark.schemas import DOC, EDIT

STORED_DOC = DOC + ", seq BIGINT, stage INT, embedding ARRAY<FLOAT>"

STORED_PAGE = """
    id STRING, wiki STRING, title STRING, title_url STRING, last_comment STRING,
    last_user STRING, event_type STRING, namespace INT, is_bot BOOLEAN, is_minor BOOLEAN,
    length_new INT, edit_count INT, first_seen TIMESTAMP, event_time TIMESTAMP,
    first_seq BIGINT, last_seq BIGINT
"""

COVERS = "run STRING, upto BIGINT"

# The run of batches written without a checkpoint, and that of enrichment.
MAIN, ENRICHMENT = "main", "enrichment"

DEAD_LETTER = "error STRING, payload STRING, raw STRING, key STRING, seq BIGINT"


def finished(spark: SparkSession, path: str, *names: str) -> list[tuple[str, ...]]:
    """Values of the ``name=value`` folders below ``path`` whose write has ended."""
    pattern = "/".join([path, *(f"{name}=*" for name in names), "_SUCCESS"])
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    folders = [status.getPath().toString().split("/")[-len(names) - 1 : -1] for status in found or []]
    return [tuple(folder.split("=", 1)[1] for folder in each) for each in folders]


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class Cut:
    """What there is of a table at one moment: the newest snapshot, up to which batch of each
    run it goes, and the finished batches after it."""

    snapshot: int | None
    covers: dict[str, int]
    batches: list[tuple[str, int]]

    def upto(self) -> dict[str, int]:
        """The newest batch of each run. Batches of one run end in order."""
        newest = dict(self.covers)
        for run, batch in self.batches:
            newest[run] = max(batch, newest.get(run, batch))
        return newest


@dataclass(frozen=True)
class BatchTable:
    """A table kept as ``log/run=R/batch_id=N`` and ``snapshots/number=N`` folders. A snapshot
    counts once ``covers/number=N``, written after it, says what it covers. One compaction at a
    time, beside any number of readers and writers."""

    path: str
    schema: str

    def batch_path(self, run: str, batch_id: int) -> str:
        return f"{self.path}/log/run={run}/batch_id={batch_id}"

    def write_batch(self, rows: DataFrame, batch_id: int, run: str = MAIN) -> None:
        rows.write.mode("overwrite").parquet(self.batch_path(run, batch_id))

    def snapshots(self, spark: SparkSession) -> list[int]:
        return sorted(int(number) for (number,) in finished(spark, f"{self.path}/covers", "number"))

    def covers(self, spark: SparkSession, number: int) -> dict[str, int]:
        rows = spark.read.schema(COVERS).parquet(f"{self.path}/covers/number={number}").collect()
        return {row["run"]: row["upto"] for row in rows}

    def cut(self, spark: SparkSession) -> Cut:
        """The snapshot is looked up before the batches, so none can fall between them."""
        numbers = self.snapshots(spark)
        newest = numbers[-1] if numbers else None
        covers = {} if newest is None else self.covers(spark, newest)
        written = [(run, int(batch)) for run, batch in finished(spark, f"{self.path}/log", "run", "batch_id")]
        return Cut(newest, covers, [(run, batch) for run, batch in written if batch > covers.get(run, -1)])

    def parts(self, spark: SparkSession, cut: Cut | None = None) -> DataFrame:
        """The rows to combine: of a moment, or of now."""
        cut = cut or self.cut(spark)
        folders = [self.batch_path(run, batch) for run, batch in cut.batches]
        if cut.snapshot is not None:
            folders.append(f"{self.path}/snapshots/number={cut.snapshot}")
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*folders)

    def snapshot(self, combined: DataFrame, cut: Cut) -> None:
        """Store the state of a moment as the new starting point of readers."""
        number = 0 if cut.snapshot is None else cut.snapshot + 1
        names = [field.split()[0] for field in self.schema.replace("\n", " ").split(",")]
        combined.select(*names).write.mode("overwrite").parquet(f"{self.path}/snapshots/number={number}")
        covers = combined.sparkSession.createDataFrame(sorted(cut.upto().items()), COVERS)
        covers.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/covers/number={number}")

    def expire(self, spark: SparkSession) -> None:
        """Remove what only readers from before the last snapshot but one could still ask for."""
        numbers = self.snapshots(spark)
        if len(numbers) < 2:
            return
        covers = self.covers(spark, numbers[-2])
        for run, batch in finished(spark, f"{self.path}/log", "run", "batch_id"):
            if int(batch) <= covers.get(run, -1):
                delete(spark, self.batch_path(run, int(batch)))
        for number in numbers[:-2]:
            delete(spark, f"{self.path}/covers/number={number}")
            delete(spark, f"{self.path}/snapshots/number={number}")


class DocumentStore:
    """The searchable replica: changes, enrichment runs and dead letters."""

    def __init__(self, path: str, dims: int = DEFAULT_DIMS):
        self.dims = dims
        self.docs = BatchTable(f"{path}/docs", STORED_DOC)
        self.dead_letters = BatchTable(f"{path}/dead_letters", DEAD_LETTER)

    def write_changes(self, changes: DataFrame, batch_id: int, run: str = MAIN) -> None:
        """Collapse a batch of changes, embed what is live, and store it in source form."""
        newest = fold.source_form(fold.latest_per_id(changes)).drop("op")
        self.docs.write_batch(embed_documents(newest, self.dims), batch_id, run)

    def state(self, spark: SparkSession, cut: Cut | None = None) -> DataFrame:
        """The newest document per id, of now or of a moment."""
        return fold.conform(fold.latest_per_id(self.docs.parts(spark, cut)), self.dims)

    def compact(self, spark: SparkSession) -> None:
        """The batches to take in are settled first: one that lands meanwhile stays after them."""
        cut = self.docs.cut(spark)
        if cut.batches:
            self.docs.snapshot(self.state(spark, cut), cut)

    def enrich(self, spark: SparkSession, summaries: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add summaries to documents that lack one. Documents were searchable before; a
        newer edit that arrives meanwhile wins over what is written here. One at a time.
        ``batch`` is the run and number of a stream's batch, which writes once."""
        cut = self.docs.cut(spark)
        run, number = batch or (ENRICHMENT, cut.upto().get(ENRICHMENT, -1) + 1)
        if cut.upto().get(run, -1) < number:
            found = enrich(self.state(spark, cut), summaries)
            self.docs.write_batch(embed_documents(found, self.dims), number, run)


class PageStore:
    """The system of record: one partly folded page per batch and key. Edits add up, so a new
    checkpoint is for edits that no other has brought."""

    def __init__(self, path: str):
        self.pages = BatchTable(f"{path}/pages", STORED_PAGE)
        self.rejected = BatchTable(f"{path}/rejected", f"{EDIT}, arrived_at TIMESTAMP, error STRING")

    def write_edits(self, edits: DataFrame, batch_id: int, run: str = MAIN) -> None:
        good, bad = edit_ops.split_too_wide(edits)
        self.pages.write_batch(edit_ops.fold_edits(good), batch_id, run)
        self.rejected.write_batch(bad, batch_id, run)

    def state(self, spark: SparkSession, cut: Cut | None = None) -> DataFrame:
        return edit_ops.combine_pages(self.pages.parts(spark, cut))

    def compact(self, spark: SparkSession) -> None:
        cut = self.pages.cut(spark)
        if cut.batches:
            self.pages.snapshot(self.state(spark, cut), cut)
