"""Spelling variants of words, found with k-d trees over letter-count vectors.

A word's point holds how often each letter occurs in it (accented letters share a few places).
One inserted or deleted letter moves the point by one, one replaced letter by two at most: one
place down and one up. So the words near a word lie in a small box around its point.

1. *Words* are counted where they lie, and the counts summed.
2. *Cells*: for every length a k-d tree divides the space of points. Its planes come from a
   sample of at most ``SAMPLE`` words, which only decides how evenly words are dealt: every word
   is entered in the one cell of its point.
3. *Visits*: a word is also sent to every cell that a box around its point touches, in the tree
   of its own length (a replaced letter) and of the next (an inserted one). A deleted letter is
   an inserted one seen from the other word.
4. *Search*: a cell's words form a k-d tree with tight boxes; visitors go down it together, and
   where a box is too far they are dropped. In its leaves the order of letters decides.
5. *Forms*: of its near words the most frequent one is a word's form if it is frequent enough;
   the chain of forms is followed by pointer doubling. Each step multiplies the count, so chains
   are short.

Words with the same letters in the same numbers can't be told apart by planes; they make one
leaf, and each visitor of it costs as many comparisons as it has words.

Definitions: a null text has no words; a null id is written as nothing before the colon; texts of
any length are read whole; repeated rows count each for themselves; ties of frequency go to the
word that is first in code-point order; an empty table has no words. Other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_chunks, keep, narrow, one_row

LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10
DAMAGED = 31
# Words that the planes between cells are taken from, and those a cell should hold.
SAMPLE = 1 << 16
CELL_WORDS = 1 << 13
SAMPLED_LEAF = 16
# Words of a leaf in the search, and letters compared at a time.
LEAF = 12
COMPARED = 1 << 22
# Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18

RUNS = re.compile("[a-zÀ-ÿ]+")
# An ASCII character that is no letter: texts may be cut there.
BETWEEN = re.compile(rb"[\x00-`{-\x7f]")
# Places of a point: 26 letters, and a few that all accented letters share.
PLACES = 32
_PLACE = np.zeros(256, dtype=np.int64)
_PLACE[ord("a") : ord("z") + 1] = np.arange(26)
_PLACE[0xC0:] = 26 + np.arange(0x40) % (PLACES - 26)


def words_of(doc_id: int | None, text: str, least: int = LEAST_LETTERS) -> Counter:
    """Words of a text of ``least`` letters or more and how often they occur. Of about one in
    ``DAMAGED`` a letter is left out, as a checksum of the document and the word decides."""
    runs: Counter = Counter()
    for chunk in byte_chunks(text.encode("utf-8", "replace").lower(), BETWEEN):
        runs.update(RUNS.findall(chunk.decode("utf-8")))
    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    found: Counter = Counter()
    for run, n in runs.items():
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode(), prefix)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts that occur often enough."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if text:
                    for word, n in words_of(doc_id, text).items():
                        total[word] += n
                if len(total) >= COUNTED:
                    yield counted(total)
                    total = Counter()
        if total:
            yield counted(total)

    def counted(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = narrow(docs, doc_id="bigint", text="string").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the words, one byte each, and the words' lengths."""
    data = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    return data, np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def points(words: list[str]) -> np.ndarray:
    data, length = letters(words)
    row = np.repeat(np.arange(len(words)) * PLACES, length)
    return np.bincount(row + _PLACE[data], minlength=len(words) * PLACES).reshape(-1, PLACES).astype(np.int32)


class Box:
    """A node: least and largest counts of what is below it, and two halves or a leaf."""

    __slots__ = ("low", "high", "halves", "leaf")

    def __init__(self, low, high):
        self.low, self.high, self.halves, self.leaf = low, high, None, None


def best_plane(own: np.ndarray) -> tuple[int, int] | None:
    """Place and count such that points up to that count are nearest to one half of all."""
    middle = np.partition(own, len(own) // 2, axis=0)[len(own) // 2]
    best = None
    for plane in (middle - 1, middle):
        below = (own <= plane).sum(axis=0)
        uneven = np.where((below > 0) & (below < len(own)), np.abs(2 * below - len(own)), 2 * len(own))
        place = int(uneven.argmin())
        if uneven[place] < 2 * len(own) and (best is None or uneven[place] < best[0]):
            best = (uneven[place], place, int(plane[place]))
    return best and best[1:]


def grow(own: np.ndarray, most: int, tight: bool) -> tuple[Box, list[np.ndarray]]:
    """A tree over points and the rows of its leaves. A ``tight`` box holds just its points;
    otherwise the leaves fill the space, so that any point lies in one of them."""
    every = np.arange(len(own))
    far = np.iinfo(np.int32).max >> 1
    root = Box(np.zeros(PLACES, np.int32), np.full(PLACES, far, np.int32))
    leaves: list[np.ndarray] = []
    waiting = [(root, every)]
    while waiting:
        box, rows = waiting.pop()
        mine = own[rows]
        if tight and len(rows):
            box.low, box.high = mine.min(axis=0), mine.max(axis=0)
        plane = best_plane(mine) if len(rows) > most else None
        if plane is None:
            box.leaf = len(leaves)
            leaves.append(rows)
            continue
        place, count = plane
        left, right = Box(box.low, box.high.copy()), Box(box.low.copy(), box.high)
        left.high[place], right.low[place] = count, count + 1
        box.halves = (left, right)
        below = mine[:, place] <= count
        waiting += [(left, rows[below]), (right, rows[~below])]
    return root, leaves


def visits(root: Box, own: np.ndarray, fewer: int):
    """Leaves, each with the rows of ``own`` whose box touches it: at most one letter more and
    ``fewer`` less."""
    waiting = [(root, np.arange(len(own)))]
    while waiting:
        box, rows = waiting.pop()
        mine = own[rows]
        more = np.maximum(box.low - mine, 0).sum(axis=1)
        less = np.maximum(mine - box.high, 0).sum(axis=1)
        rows = rows[(more <= 1) & (less <= fewer)]
        if not len(rows):
            continue
        if box.halves:
            waiting += [(half, rows) for half in box.halves]
        else:
            yield box.leaf, rows


def replaced(visitors: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of letter rows that differ in one place."""
    return np.nonzero((visitors[:, None, :] != members[None, :, :]).sum(axis=2) == 1)


def inserted(visitors: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs such that the visitor is the member without one of its letters: what both have in
    common at the start and at the end makes up the visitor."""
    start = np.logical_and.accumulate(visitors[:, None, :] == members[None, :, :-1], axis=2).sum(axis=2)
    end = np.logical_and.accumulate((visitors[:, None, :] == members[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
    return np.nonzero(start + end >= visitors.shape[1])


def near_pairs(members: list[str], visitors: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of visitors and members that are one edit apart; all members have one length, and all
    visitors the ``same`` or one letter less."""
    root, leaves = grow(points(members), LEAF, tight=True)
    order = letters(members)[0].reshape(len(members), -1)
    own = letters(visitors)[0].reshape(len(visitors), -1)
    found = []
    for leaf, rows in visits(root, points(visitors), 1 if same else 0):
        step = max(1, COMPARED // (len(leaves[leaf]) * order.shape[1]))
        for at in range(0, len(rows), step):
            a, b = (replaced if same else inserted)(own[rows[at : at + step]], order[leaves[leaf]])
            found.append((rows[at + a], leaves[leaf][b]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


NEAR = "word string, n_near bigint, best_n bigint, best string"


def search_cell(cell: pa.Table) -> pa.Table:
    """For every word that has near words by way of this cell: their number and the best one."""
    sides: list[tuple[list[str], list[int]]] = [([], []), ([], []), ([], [])]
    for side, some, own in zip(*(cell.column(c).to_pylist() for c in ("side", "words", "counts"))):
        sides[side][0].extend(some)
        sides[side][1].extend(own)
    members = sides[0][0]
    names, counts = list(members), list(sides[0][1])
    left, right = [], []
    for side in (1, 2):
        visitors, own_counts = sides[side]
        if not visitors or not members:
            continue
        a, b = near_pairs(members, visitors, same=side == 1)
        a = a + len(names)
        names += visitors
        counts += own_counts
        left.append(a)
        right.append(b)
        if side == 2:
            # From the longer word the shorter one is as near.
            left.append(b)
            right.append(a)
    a = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64)
    b = np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64)
    weight = np.array(counts, dtype=np.int64)
    text = np.array(names, dtype=object)
    ranked = np.empty(len(names), np.int64)
    ranked[np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(len(names))
    order = np.lexsort((ranked[b], -weight[b], ranked[a])) if len(a) else a
    a, b = a[order], b[order]
    new = np.flatnonzero(np.append(True, ranked[a[1:]] != ranked[a[:-1]])) if len(a) else a
    size = np.diff(np.append(new, len(a)))
    best = b[new]
    return pa.table(
        [pa.array(text[a[new]], pa.string()), pa.array(size, pa.int64()), pa.array(weight[best], pa.int64()), pa.array(text[best], pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def planes(words: DataFrame, total: int) -> dict[int, Box]:
    """A tree per length from a bounded sample of the words. Lengths without one have one cell."""
    share = max(1, -(-total // SAMPLE))
    sampled = words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).limit(2 * SAMPLE).select("word").collect()
    by_length: dict[int, list[str]] = {}
    for row in sampled:
        by_length.setdefault(len(row.word), []).append(row.word)
    most = max(SAMPLED_LEAF, CELL_WORDS // share)
    return {length: grow(points(some), most, tight=False)[0] for length, some in by_length.items()}


def dealt(words: DataFrame, trees: dict[int, Box]) -> DataFrame:
    """``length, cell, side, words, counts``: words by cell, packed. Side 0 has the words that live
    there, 1 visitors of the same length and 2 of one letter less."""
    undivided, _ = grow(np.zeros((0, PLACES), np.int32), 1, tight=False)

    def run(batches):
        for batch in batches:
            by_length: dict[int, list[tuple[str, int]]] = {}
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                by_length.setdefault(len(word), []).append((word, n))
            out = []
            for length, some in by_length.items():
                names, counts = np.array([w for w, _ in some], object), np.array([n for _, n in some], np.int64)
                own = points([w for w, _ in some])
                tree = trees.get(length, undivided)
                sent = [(length, 1, leaf, rows) for leaf, rows in visits(tree, own, 1)]
                sent += [(length, 0, leaf, rows) for leaf, rows in homes(tree, own)]
                sent += [(length + 1, 2, leaf, rows) for leaf, rows in visits(trees.get(length + 1, undivided), own, 0)]
                out += [(at, leaf, side, names[rows].tolist(), counts[rows].tolist()) for at, side, leaf, rows in sent]
            if out:
                types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], ["length", "cell", "side", "words", "counts"]
                )

    return words.mapInArrow(run, "length int, cell int, side int, words array<string>, counts array<bigint>")


def homes(root: Box, own: np.ndarray):
    """Each row of ``own`` in the one leaf of a tree that fills the space."""
    waiting = [(root, np.arange(len(own)))]
    while waiting:
        box, rows = waiting.pop()
        rows = rows[((own[rows] >= box.low) & (own[rows] <= box.high)).all(axis=1)]
        if not len(rows):
            continue
        if box.halves:
            waiting += [(half, rows) for half in box.halves]
        else:
            yield box.leaf, rows


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` for every word that has near words."""
    total = one_row(words.agg(F.count(F.lit(1)).alias("n")))["n"]
    cells = dealt(words, planes(words, total))
    found = cells.groupBy("length", "cell").applyInArrow(search_cell, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.word").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the chain of forms (``word, form``), by pointer doubling."""
    chains = keep(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = chains.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = keep(joined, "chains")
        chains = after.select("word", "root")
        if not one_row(after.agg(F.max("moved").alias("moved")))["moved"]:
            return chains


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of the documents that occurs often enough."""
    words = keep(vocabulary(docs), "vocabulary")
    formed = F.col("best_n") >= TIMES * F.col("n")
    found = words.join(near_words(words), "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"),
    )
    found = keep(found, "near")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
