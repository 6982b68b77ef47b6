"""Best-fit packing of token sequences by exact complements.

A document is its token ids and one end id, cut into pieces of at most ``capacity``. How pieces
are combined depends on their lengths alone: the table of lengths has at most ``capacity`` rows,
whatever the number of documents, so the plan is made on the driver from counts. From the longest
length down, the gap that a piece leaves is filled exactly by one, two or three others, looked up
in the indexes of single, pair and triple sums of the lengths still available; each such
combination is used as often as its scarcest length allows. What is left goes, longest first, where it fits best.

The plan says which ranks of a length go to which sequences. Ranks come from two steps: pieces
are numbered within buckets of bounded size, and the buckets' counts are added up per length, so
a length that a third of all pieces have is never in one task.

Definitions: a null text is empty and has the end id alone; rows are packed one by one, also
repeated rows and rows without id; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import CACHE_CHARS, Recent, Transducer, byte_alphabet
from tidemark.llm.common import keep, narrow, one_row

CAPACITY = 2048
END_ID = 0
# Pieces numbered by one window at most, on average.
BUCKET_ROWS = 20_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint"
# Bytes of words that a worker remembers in each of two generations.
WORD_BYTES = 96_000_000


class LibraryWords(Transducer):
    """The transducer's blocks and memory of words, where words not met before are merged by the
    tokenizer library's own model; only words too long to remember go through the window."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.known = Recent(WORD_BYTES)
        self.model = Tokenizer.from_file(path).model
        # Each byte as Latin-1 reads it, to the character that stands for it.
        self.signs = dict(enumerate(byte_alphabet()))

    def fresh(self, piece: str) -> bytes:
        if len(piece) > CACHE_CHARS:
            return super().fresh(piece)
        word = piece.encode("utf-8", "replace").decode("latin-1").translate(self.signs)
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()


@lru_cache(maxsize=2)
def library_words(path: str) -> LibraryWords:
    """One per worker and file."""
    return LibraryWords(path)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, payload: str = "ids") -> DataFrame:
    """``doc_id, piece, start, length`` and the pieces' ``ids`` (little-endian unsigned 32-bit)
    or their ``ids_crc32``."""
    kind = {"ids": "binary", "ids_crc32": "bigint"}[payload]
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        coder, step = library_words(path), 4 * capacity
        value = bytes if payload == "ids" else zlib.crc32
        kind = pa.binary() if payload == "ids" else pa.int64()
        for batch in batches:
            sizes, values = [], []
            for text in batch.column("text"):
                ids = memoryview(coder.encode(text.as_py() or "") + end)
                sizes.append(len(ids) // 4)
                values += [value(ids[at : at + step]) for at in range(0, len(ids), step)]
            # A row per piece, from the numbers of ids.
            size = np.array(sizes, dtype=np.int64)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(np.minimum(size[row] - start, capacity)), pa.array(values, kind),
                ],
                ["doc_id", "piece", "start", "length", payload],
            )

    rows = narrow(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(run, f"{PIECES}, {payload} {kind}")


class Available:
    """How many pieces of each length are left, with an index of the sums of one, two and three of
    them, each a set of bits: bit s is set where s is such a sum. A sum may use a length more often
    than it is there, so a combination is counted before it is used."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = Counter({length: n for length, n in counts.items() if n > 0})
        self.capacity = capacity
        self._index()

    def _index(self) -> None:
        every = (1 << (self.capacity + 1)) - 1
        self.single = sum(1 << length for length, n in self.counts.items() if n)
        self.pairs = self.triples = 0
        for length, n in self.counts.items():
            self.pairs |= self.single << length & every if n else 0
        for length, n in self.counts.items():
            self.triples |= self.pairs << length & every if n else 0

    def take(self, lengths: Counter, times: int) -> None:
        for length, n in lengths.items():
            self.counts[length] -= n * times
        if not all(self.counts[length] for length in lengths):
            self._index()

    def times(self, lengths: Counter) -> int:
        return min(self.counts[length] // n for length, n in lengths.items())

    def filling(self, first: int) -> Counter | None:
        """Lengths, ``first`` among them, that fill a sequence exactly."""
        gap = self.capacity - first
        if gap == 0:
            return Counter([first])
        for rest in self._exactly(gap):
            lengths = Counter([first, *rest])
            if self.times(lengths):
                return lengths
        return None

    def _exactly(self, gap: int):
        """Every combination for a gap: one length, then two, then three, long ones first. Only
        combinations that repeat a scarce length fail to be there, so few are looked at."""
        if self.single >> gap & 1:
            yield (gap,)
        if self.pairs >> gap & 1:
            for a in self._down(gap - 1, (gap + 1) // 2):
                if self.single >> (gap - a) & 1:
                    yield a, gap - a
        if self.triples >> gap & 1:
            for a in self._down(gap - 2, (gap + 2) // 3):
                rest = gap - a
                if self.pairs >> rest & 1:
                    for b in self._down(min(a, rest - 1), (rest + 1) // 2):
                        if self.single >> (rest - b) & 1:
                            yield a, b, rest - b

    def _down(self, high: int, low: int):
        """Available lengths from ``high`` down to ``low``."""
        left = self.single & ((1 << (high + 1)) - 1)
        while left:
            length = left.bit_length() - 1
            if length < low:
                return
            yield length
            left ^= 1 << length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of sequences, each a list of (length, how many) and the number of such sequences.
    Every step uses up a length or a kind, so there are no more kinds than a few per length."""
    left, kinds = Available(counts, capacity), []
    for length in sorted(counts, reverse=True):
        while left.counts[length]:
            filling = left.filling(length)
            if filling is None:
                break
            times = left.times(filling)
            left.take(filling, times)
            kinds.append((sorted(filling.items(), reverse=True), times))
    return kinds + best_fit({n: c for n, c in left.counts.items() if c}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Lengths in descending order, each into the fullest open sequences it fits. Open sequences
    that are alike are kept as one kind with a count."""
    open_kinds: dict[int, list[tuple[tuple, int]]] = {}

    def put(gap: int, lengths: tuple, times: int) -> None:
        if times:
            open_kinds.setdefault(gap, []).append((lengths, times))

    for length in sorted(counts, reverse=True):
        count = counts[length]
        while count:
            gap = min((g for g in open_kinds if g >= length), default=None)
            if gap is None:
                each = capacity // length
                whole, rest = divmod(count, each)
                put(capacity - each * length, ((length, each),), whole)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            lengths, times = open_kinds[gap].pop()
            if not open_kinds[gap]:
                del open_kinds[gap]
            each = min(gap // length, max(1, count))
            used = min(times, count // each)
            put(gap, lengths, times - used)
            put(gap - each * length, (*lengths, (length, each)), used)
            count -= used * each
    return [(list(lengths), times) for kinds in open_kinds.values() for lengths, times in kinds]


def places(kinds) -> dict[str, np.ndarray]:
    """The plan by length: from which rank on its pieces go to which sequences, how many of them
    lie in each, and where. Sorted by length and rank."""
    rows, used, sequence = [], Counter(), 0
    for lengths, times in kinds:
        offset = 0
        for length, each in lengths:
            rows.append((length, used[length], sequence, each, offset))
            used[length] += each * times
            offset += length * each
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T))


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length. ``pieces`` must be a written table."""
    buckets = max(64, -(-total // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    dealt = pieces.withColumn("_bucket", bucket)
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = dealt.withColumn("_row", F.row_number().over(inside)).join(starts, ["length", "_bucket"])
    return rows.withColumn("rank", F.col("_start") + F.col("_row") - 1).drop("_bucket", "_row", "_start")


def placed(rows: DataFrame, table: dict[str, np.ndarray]) -> DataFrame:
    """``sequence_id`` and ``offset`` of ranked pieces; the plan travels with the task."""
    # Ranks stay far below 2**44, lengths below 2**19.
    keys = (table["length"] << 44) + table["rank"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            within = rank - table["rank"][at]
            each = table["each"][at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in batch.schema.names if c != "rank"),
                    pa.array(table["sequence"][at] + within // each),
                    pa.array(table["offset"][at] + within % each * length),
                ],
                [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank"]
    return rows.mapInArrow(run, ", ".join([*kept, "sequence_id bigint", "offset bigint"]))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, payload: str = "ids") -> DataFrame:
    """``doc_id, piece, start, length, <payload>, sequence_id, offset``, one row per piece."""
    pieces = keep(cut(docs, path, capacity, payload), "pieces")
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(counts, capacity))
    columns = ["doc_id", "piece", "start", "length", payload]
    return placed(ranked(pieces, sum(counts.values())).select(*columns, "rank"), table)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, length, ids``: whole sequences out of packed pieces with their ids. A
    sequence has ``capacity`` pieces at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), parts.alias("parts")
    ).select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda t, x: F.concat(t, x["ids"])).alias("ids"))
