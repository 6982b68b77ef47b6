"""Suffix-array removal of repeated passages.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
document with a smaller id, or in the same document further left.

1. *Anchors.* Of the ``GRAM``-byte strings within a window of ``LENGTH`` bytes, the one with the
   least hash is the window's anchor (the last of equals). Equal windows have equal anchors at
   equal places, so windows are compared only where their anchors' hashes occur more than once.
   Neighbouring windows with one anchor are a run.
2. *Equal runs.* Runs alike in all their bytes are one class; all but the earliest are covered.
   This takes whole copies out, before anything is grouped.
3. *Unequal runs with one anchor* are sorted. The earliest run of each class is cut, by the
   distance to the anchor, into cells of neighbouring windows. All windows of a cell share its
   *core*, four fifths of their bytes, and equal windows lie in cells of one core and place: a
   cell goes on as a 128-bit digest of its core and the few bytes on both sides of it. Cores that
   occur once drop out, and of equal cells all but the earliest are covered. The others are dealt
   to blocks by core; in a block, a suffix array (see ``suffixes``) of the bytes around each core,
   with the core as one symbol of its own between them, brings equal windows next to each other,
   and all but the earliest are covered. A core with more than ``CROWDED`` unequal cells isn't
   sorted in one block: its windows are compared by digest, by an aggregate and a join in which the
   firsts of the most common windows, at most ``MOST_HOT``, go to the rows.
4. Covered windows are gathered by document and cut out of its text.

Definitions: a null text is empty; an id that is null is smaller than all others; rows alike in
id and text are one document and come out alike, and rows with one id and different texts are
ordered by where a string starts in them, without removing strings that start at the same place.
A string that is cut within a character leaves the character's other bytes in ``kept``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, keep, large, one_row, text_bytes
from tidemark.llm.suffixes import suffix_array

LENGTH = 100
GRAM = 24
WINDOW = LENGTH - GRAM + 1
# Cells that windows with one anchor are cut into, and the windows of a cell.
CELLS = 4
CELL = -(-WINDOW // CELLS)
CROWDED = 1024
BLOCK_BYTES = 1 << 17
# Windows that may be so common that their firsts are sent to every task.
MOST_HOT = 10_000
# Tasks that blocks are dealt to; a task takes its blocks one by one.
MOST_TASKS = 20_000
# Bytes measured at a time, about; a dozen arrays of numbers of eight bytes go with each. Longer
# texts go in parts that overlap by a window.
PART = 1 << 18
# Cells that a task gathers before it hands them on.
MOST_CELLS = 20_000
NO_ID = -(2**63)

_U = np.uint64
# Odd multipliers for mixing.
_MIX = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from every place on, as one number; the end is padded."""
    buffer = data + bytes(8)
    return np.ndarray((len(data),), dtype="<u8", buffer=buffer, strides=(1,)).astype(_U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX[0]
    x ^= x >> _U(29)
    x *= _MIX[1]
    x ^= x >> _U(32)
    return x


def gram_hashes(eight: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on; never 0."""
    n = max(0, len(eight) - GRAM + 1)
    h = mixed(eight[:n])
    for at, multiplier in zip(range(8, GRAM, 8), _MIX[1:]):
        h += eight[at : at + n]
        h *= multiplier
        h ^= h >> _U(31)
    return h | _U(1)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values, by running values within
    blocks from both sides."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    fill = x[-1]
    padded = np.full(blocks * width, fill, dtype=x.dtype)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    forward = pick.accumulate(square, axis=1).ravel()
    backward = pick.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(backward[:n], forward[width - 1 : width - 1 + n])


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they have been needed."""

    def __init__(self):
        self.up = np.ones(1, dtype=_U)
        self.down = np.ones(1, dtype=_U)

    def upto(self, n: int):
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(_BASE, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(_INVERSE, size, 1 << 64))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def least_grams(eight: np.ndarray, valid: np.ndarray):
    """Hashes of all grams, the least hash of every window, and the places of grams that are the
    least of a valid window."""
    grams = gram_hashes(eight)
    least = sliding(grams, WINDOW, np.minimum)
    masked = np.where(valid[: len(least)], least, _U(0))
    pad = np.zeros(WINDOW - 1, dtype=_U)
    most = sliding(np.concatenate([pad, masked, pad]), WINDOW, np.maximum)
    return grams, least, np.flatnonzero(grams == most)


def runs(data: bytes, valid: np.ndarray):
    """Runs of windows with one anchor: first and last window, anchor's place and hash, and a
    hash of all bytes of the run. ``valid`` says which windows lie within one document; there is
    one at least."""
    eight = eights(data)
    grams, least, chosen = least_grams(eight, valid)
    valid = valid[: len(least)]
    starts = np.flatnonzero(valid)
    at = np.searchsorted(chosen, starts + WINDOW - 1, side="right") - 1
    wanted = least[starts]
    wrong = np.flatnonzero(grams[chosen[at]] != wanted)
    while len(wrong):
        at[wrong] -= 1
        wrong = wrong[grams[chosen[at[wrong]]] != wanted[wrong]]
    anchor = chosen[at]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, anchor = starts[first], starts[last], anchor[first]
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(mixed(eight ^ _MIX[3]) * up[:-1], out=sums[1:])
    # Eight-byte groups that end within the run hold all of its bytes.
    whole = (sums[hi + LENGTH - 7] - sums[lo]) * down[lo]
    context = mixed(whole ^ ((anchor - lo).astype(_U) << _U(32)) ^ (hi - lo).astype(_U))
    return lo, hi, anchor, grams[anchor], context


def parts_of(texts: list[bytes]):
    """Texts joined to parts of about ``PART`` bytes: data, valid windows, and per piece its row,
    its place in the data and in its text."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    step = PART - LENGTH + 1
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), step):
            piece = text[at : at + PART]
            if size and size + len(piece) > 2 * PART:
                yield joined(pieces)
                pieces, size = [], 0
            pieces.append((row, at, piece))
            size += len(piece)
    if pieces:
        yield joined(pieces)


def joined(pieces):
    data = b"".join(piece for _, _, piece in pieces)
    valid = np.ones(len(data), dtype=bool)
    ends = np.cumsum([len(piece) for _, _, piece in pieces])
    for end in ends:
        valid[max(0, end - LENGTH + 1) : end] = False
    rows = np.array([row for row, _, _ in pieces])
    shift = np.array([at for _, at, _ in pieces]) - np.append(0, ends[:-1])
    return data, valid, ends, rows, shift


RUN_COLUMNS = "h bigint, context bigint, doc bigint, version bigint, lo int, width smallint, reach smallint"


def documents(docs: DataFrame, *others: Column) -> DataFrame:
    """``doc, version, text``: the id, with null as the smallest, what tells apart texts that share
    an id, and the text's bytes; then ``others``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("version"), text_bytes(text).alias("text"), *others)


def anchored(rows: DataFrame, only_hash: bool = False) -> DataFrame:
    """Runs of every whole text, see ``RUN_COLUMNS``: ``width`` more windows after ``lo``, the
    anchor ``reach`` bytes after the last. Or their anchors' hashes alone."""

    def run(batches):
        for batch in batches:
            doc, version = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version"))
            for data, valid, ends, row_of, shift in parts_of(batch.column("text").to_pylist()):
                if only_hash:
                    # Equal least hashes of one window all count: a few more anchors to look at.
                    grams, _, chosen = least_grams(eights(data), valid)
                    yield pa.RecordBatch.from_arrays([pa.array(grams[chosen].view(np.int64))], ["h"])
                    continue
                lo, hi, anchor, h, context = runs(data, valid)
                piece = np.searchsorted(ends, lo, side="right")
                row = row_of[piece]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc[row]),
                        pa.array(version[row]), pa.array((lo + shift[piece]).astype(np.int32)),
                        pa.array((hi - lo).astype(np.int16)), pa.array((anchor - hi).astype(np.int16)),
                    ],
                    ["h", "context", "doc", "version", "lo", "width", "reach"],
                )

    return rows.mapInArrow(run, "h bigint" if only_hash else RUN_COLUMNS)


CELL_COLUMNS = "key binary, content bigint, doc bigint, version bigint, lo int, hi int, before smallint, data binary"


def cells(rows: DataFrame) -> DataFrame:
    """From texts with their runs (``runs``, each as one number): windows by cell, with the bytes
    around the core, ``before`` of them to its left, under a digest of the core and a hash of all
    of the cell."""
    number = lambda data: int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)

    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.binary()]
    names = [c.split(" ")[0] for c in CELL_COLUMNS.split(", ")]

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches):
        out: list[tuple] = []
        for batch in batches:
            for values in zip(*(batch.column(c) for c in ("doc", "version", "text", "runs"))):
                doc, version, text, found = (value.as_py() for value in values)
                for packed in found:
                    lo, width, reach = packed >> 16, packed >> 8 & 255, packed & 255
                    hi = lo + width
                    anchor = hi + reach
                    for cell in range(reach // CELL, (reach + width) // CELL + 1):
                        near, far = cell * CELL, min(WINDOW, (cell + 1) * CELL) - 1
                        a, b = max(lo, anchor - far), min(hi, anchor - near)
                        core, end = anchor - near, anchor - far + LENGTH
                        data = text[a:core] + text[end : b + LENGTH]
                        key = hashlib.blake2b(b"%d " % cell + text[core:end], digest_size=16).digest()
                        out.append((key, number(b"%d " % (core - a) + data), doc, version, a, b, core - a, data))
                    if len(out) >= MOST_CELLS:
                        yield table(out)
                        out = []
        if out:
            yield table(out)

    return rows.mapInArrow(run, CELL_COLUMNS)


SPANS = "doc bigint, version bigint, lo int, hi int"


def sorted_block(table: pa.Table) -> pa.Table:
    """Windows of a block that also start earlier in it, found next to each other in the suffix
    array of all its cells. A cell is the bytes before its core, the core's own symbol, and the
    bytes after it, so a window of ``CELL`` bytes or fewer stands for one of ``LENGTH``."""
    data = table.column("data").to_pylist()
    doc, version, lo, hi, before = (table.column(c).to_numpy() for c in ("doc", "version", "lo", "hi", "before"))
    cores: dict[bytes, int] = {}
    core = np.array([cores.setdefault(key, len(cores)) for key in table.column("key").to_pylist()])
    length = np.array([len(d) + 1 for d in data])
    begin = np.cumsum(length + 1) - length - 1
    # Symbols of a window: all but those that the other windows of the cell have more.
    size = length - (hi - lo)
    # What ends a row is smaller than any byte, and what fills up the last rows is no symbol.
    text = np.zeros(int(length.sum()) + len(data) + CELL, dtype=np.int64)
    here = np.ones(len(text) - CELL, dtype=bool)
    here[begin + length] = here[begin + before] = False
    text[:-CELL][here] = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64) + 1
    text[begin + before] = 257 + core
    order = np.array(suffix_array(text[:-CELL].tolist()), dtype=np.int64)
    row = np.searchsorted(begin, order, side="right") - 1
    inside = order + size[row] <= begin[row] + length[row]
    order, row = order[inside], row[inside]
    windows = np.lib.stride_tricks.sliding_window_view(text, CELL)
    beyond = np.arange(CELL)[None, :] >= size[row][:, None]
    same = np.zeros(len(order), dtype=bool)
    for at in range(1, len(order), 4096):
        upto = min(len(order), at + 4096)
        equal = windows[order[at:upto]] == windows[order[at - 1 : upto - 1]]
        same[at:upto] = (equal | beyond[at:upto]).all(axis=1)
    number = np.cumsum(~same)
    start = lo[row] + order - begin[row]
    # The first of each set of equals, by document and place.
    rank = np.lexsort((start, doc[row], number))
    first = np.zeros(len(order), dtype=bool)
    ranked = number[rank]
    heads = np.append(True, ranked[1:] != ranked[:-1]) if len(rank) else first
    head = np.maximum.accumulate(np.where(heads, np.arange(len(rank)), 0)) if len(rank) else rank
    lead = rank[head]
    later = (doc[row][rank] != doc[row][lead]) | (start[rank] != start[lead])
    covered = rank[later]
    at = start[covered].astype(np.int32)
    return pa.table(
        [pa.array(doc[row][covered]), pa.array(version[row][covered]), pa.array(at), pa.array(at)],
        names=["doc", "version", "lo", "hi"],
    )


def by_digest(crowded: DataFrame) -> DataFrame:
    """Covered windows of crowded cores: the first of equal windows is an aggregate."""

    def run(batches):
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("key", "doc", "version", "lo", "hi", "before", "data"))
            for key, doc, version, lo, hi, before, data in zip(*columns):
                size = len(data) - (hi - lo)
                for at in range(hi - lo + 1):
                    window = key + b"%d " % (before - at) + data[at : at + size]
                    out.append((hashlib.blake2b(window, digest_size=16).digest(), doc, version, lo + at))
            if out:
                types = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], ["digest", "doc", "version", "at"]
                )

    windows = keep(crowded.mapInArrow(run, "digest binary, doc bigint, version bigint, at int"), "windows")
    firsts = windows.groupBy("digest").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = keep(firsts.where("n > 1"), "firsts")
    # Digests with more than this share of all rows can't be more than its inverse.
    hot = F.col("n") > max(1, windows.count() // MOST_HOT)
    few = F.broadcast(firsts.where(hot).select("digest", "first"))
    rest = windows.join(few.select("digest"), "digest", "left_anti").join(firsts.where(~hot).select("digest", "first"), "digest")
    later = windows.join(few, "digest").unionByName(rest).where("doc <> first.doc or at <> first.at")
    return later.select("doc", "version", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeated_runs(rows: DataFrame, often: DataFrame) -> DataFrame:
    """Runs whose anchors' hashes are in ``often``. Both sides grow with the bytes of the texts."""
    return anchored(rows).join(large(often), "h")


def covered(rows: DataFrame) -> DataFrame:
    """``doc, version, lo, hi``: windows (by first and last start) that also start earlier."""
    # Written, so that the join below may split a hash that very many windows have.
    often = keep(
        anchored(rows, only_hash=True).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often"
    )
    repeated = keep(repeated_runs(rows, often), "anchors")
    forget(often)
    classes = keep(
        repeated.groupBy("h", "context").agg(F.min(F.struct("doc", "lo", "version", "width", "reach")).alias("first")),
        "classes",
    )
    copies = repeated.join(classes, ["h", "context"]).where("doc <> first.doc or lo <> first.lo")
    copies = copies.select("doc", "version", "lo", (F.col("lo") + F.col("width")).cast("int").alias("hi"))

    unequal = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    firsts = classes.join(unequal, "h").select("first.*")
    packed = F.shiftleft(F.col("lo").cast("bigint"), 16) + F.shiftleft(F.col("width").cast("bigint"), 8) + F.col("reach")
    by_doc = firsts.groupBy("doc", "version").agg(F.collect_set(packed).alias("runs"))
    # Texts that are alike in id and bytes are one document, and bring their runs once.
    texts = rows.join(by_doc, ["doc", "version"]).select("doc", "version", "text", "runs")
    cut = keep(cells(texts), "cells")
    copies = keep(copies, "copies")
    # Nothing reads these after it.
    forget(repeated)
    forget(classes)
    return copies.unionByName(covered_cells(cut))


def covered_cells(cut: DataFrame) -> DataFrame:
    kinds = cut.groupBy("key", "content").agg(F.min(F.struct("doc", "lo", "version")).alias("first"))
    kinds = keep(kinds, "kinds")
    sizes = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # One pass over all cells: copies of an earlier cell, and the first cells that have others to
    # be compared with; only these go on with their bytes.
    own = cut.join(kinds.join(sizes, "key"), ["key", "content"])
    is_first = F.col("version").eqNullSafe(F.col("first.version")) & (F.col("doc") == F.col("first.doc")) & (F.col("lo") == F.col("first.lo"))
    is_copy = (F.col("doc") != F.col("first.doc")) | (F.col("lo") != F.col("first.lo"))
    own = own.where(is_copy | (is_first & (F.col("n") > 1))).select(
        F.when(~is_copy, F.col("key")).alias("key"), "doc", "version", "lo", "hi", "n", "before", is_copy.alias("is_copy"),
        F.when(~is_copy, F.col("data")).alias("data"),
    )
    own = keep(own, "compared")
    # Nothing reads these after it.
    forget(cut)
    forget(kinds)
    copies = own.where("is_copy").select("doc", "version", "lo", "hi")
    firsts = own.where("not is_copy")
    few = firsts.where(F.col("n") <= CROWDED)
    total = one_row(few.agg(F.sum(F.length("data")).alias("size")))["size"] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    dealt = few.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", "doc", "version", "lo", "hi", "before", "data")
    # Sorting costs far more than reading, so blocks aren't gathered by their bytes.
    dealt = dealt.repartition(min(blocks, MOST_TASKS), "block")
    sorted_ones = dealt.groupBy("block").applyInArrow(sorted_block, SPANS)
    crowded = firsts.where(F.col("n") > CROWDED).select("key", "doc", "version", "lo", "hi", "before", "data")
    return copies.unionByName(sorted_ones).unionByName(by_digest(crowded))


def merged(spans: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs of bytes under windows; a span is one number, first
    start and last start."""
    spans = np.sort(spans)
    lo, end = spans >> 32, np.maximum.accumulate((spans & 0xFFFFFFFF) + LENGTH)
    new = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
    return lo[new].tolist(), np.minimum(end[np.append(new[1:] - 1, len(end) - 1)], size).tolist()


def trimmed(text: bytes, lo: int, hi: int) -> bytes:
    """``text[lo:hi]`` without the characters of which it holds only a part."""
    while lo < hi and text[lo] & 0xC0 == 0x80:
        lo += 1
    while lo < hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi -= 1
    return text[lo:hi]


def cleaned(rows: DataFrame, windows: DataFrame, characters: bool = False) -> DataFrame:
    """``spans, kept`` for ``rows``, after their own columns: removed runs and what is left of each
    text, to the byte or in whole ``characters``."""
    own = rows.columns
    span = F.shiftleft(F.col("lo").cast("bigint"), 32) + F.col("hi")
    spans = windows.groupBy("doc", "version").agg(F.collect_list(span).alias("spans"))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            removed, kept = [], []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                text = text.as_py()
                if not found.is_valid:
                    removed.append([])
                    kept.append(text)
                    continue
                starts, ends = merged(found.values.to_numpy(zero_copy_only=False), len(text))
                pieces = zip([0, *ends], [*starts, len(text)])
                kept.append(b"".join([trimmed(text, a, b) if characters else text[a:b] for a, b in pieces]))
                removed.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(removed, kind), pa.array(kept, pa.binary())],
                [*own, "spans", "kept"],
            )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.join(spans, ["doc", "version"], "left").select(*own, "spans").mapInArrow(
        run, ", ".join([*columns, "spans array<struct<start:bigint,end:bigint>>", "kept binary"])
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spans, kept`` (texts as bytes): one row per row of ``docs``."""
    rows = documents(docs)
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return cleaned(rows, covered(rows)).select(doc_id.alias("doc_id"), "text", "spans", "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what repeats cut out of ``text``, and ``n_chars`` counted anew. A character
    that loses one of its bytes is dropped."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = documents(docs, whole.alias("others"))
    found = cleaned(rows, covered(rows.drop("others")), characters=True)
    found = found.withColumn("text", F.decode("kept", "UTF-8"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return found.select(*(new.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    found = dedup(docs)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
