"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words are cut into overlapping blocks, ``STEP`` words apart and twice as long, so that
any passage of up to ``STEP`` words lies in one block as a whole; templates are at most that long.
A block meets a template if it holds at least ``SHARE`` of the template's distinct words.

1. One pass reads the texts: it finds the base phrases and keeps, per text, where words of any
   template stand.
2. How often those words occur in all documents gives one global order, rarest first.
3. Blocks and templates are sets in that order. If a block of size s and a template of size m
   have as many words in common as are needed, o, the first common word is among the first
   m - o + 1 of the template and the first s - o + 1 of the block (*prefix filter*). Only those
   words of templates are indexed. Blocks of fewer than o words drop out (*length filter*), and
   so do those where too few words are left after a common one (*positional filter*).
4. What remains is compared as whole sets.

Templates are a list in the program, a few dozen words each, so their index goes to every task;
documents are never shuffled.

Definitions: a null text has no words; a text of any length is cut into blocks to its end; repeated
rows and rows without id come out as they went in; words rarer in the corpus go first and equally
frequent ones by their letters, which decides nothing in the result; an empty table gives no rows.
Other columns aren't read. ``score`` is 1 where a base phrase stands, else the largest share of a
template that a block holds if that is enough, else 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_chunks, keep, narrow

STEP = 32
SHARE = 0.8

# The base phrases, and opening passages of well-known licenses.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("creative-commons", "this work is licensed under a creative commons attribution license"),
]

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")

PLACES = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<int>, places array<int>, ids array<int>"


def vocabulary(*texts: str) -> list[str]:
    return sorted({word for text in texts for word in text.split()})


def places(docs: DataFrame, phrases: Sequence[tuple[str, str]], words: list[str]) -> DataFrame:
    """Per text: its number of words, the places of base phrases (and which stand there), and
    where which of ``words`` stand."""
    number = {word.encode(): at for at, word in enumerate(words)}
    wanted = [[number[word.encode()] for word in phrase.split()] for _, phrase in phrases]

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                data = (text.as_py() or b"").lower()
                total, where, ids = 0, [], []
                for chunk in byte_chunks(data, BETWEEN):
                    found = WORD.findall(chunk)
                    known = [at for at, word in enumerate(found) if word in number]
                    where += [total + at for at in known]
                    ids += [number[found[at]] for at in known]
                    total += len(found)
                out.append((doc_id, total, *base_places(np.array(where, np.int64), np.array(ids, np.int64), wanted), where, ids))
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 3
            names = [c.split(" ")[0] for c in PLACES.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return narrow(docs, doc_id="bigint", text="string").mapInArrow(run, PLACES)


def base_places(where: np.ndarray, ids: np.ndarray, wanted: list[list[int]]):
    """Number of phrases' places, the first and the last of them, and the phrases found."""
    starts, which = [], []
    for at, phrase in enumerate(wanted):
        n = len(where) - len(phrase) + 1
        fits = np.ones(max(0, n), dtype=bool)
        for step, word in enumerate(phrase):
            fits &= (ids[step : step + n] == word) & (where[step : step + n] == where[:n] + step) if n > 0 else False
        found = where[: max(0, n)][fits].tolist()
        starts += found
        which += [at] if found else []
    return len(starts), min(starts, default=None), max(starts, default=None), which


class Index:
    """Templates as sets of words in one global order, and an index of their prefixes."""

    def __init__(self, templates: Sequence[Sequence[int]], frequency: dict[int, int], share: float = SHARE):
        order = sorted({word for template in templates for word in template}, key=lambda word: (frequency.get(word, 0), word))
        self.rank = {word: at for at, word in enumerate(order)}
        self.sets = [sorted(self.rank[word] for word in set(template)) for template in templates]
        self.needed = [max(1, math.ceil(share * len(some) - 1e-9)) for some in self.sets]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for at, (some, needed) in enumerate(zip(self.sets, self.needed)):
            for place, word in enumerate(some[: len(some) - needed + 1]):
                self.prefixes.setdefault(word, []).append((at, place))
        self.least = min(self.needed, default=0)

    def met(self, block: list[int]) -> dict[int, int]:
        """Templates that a block (sorted, without repeats) meets, with the words in common."""
        size = len(block)
        if size < self.least:
            return {}
        common: dict[int, int] = {}
        for at, word in enumerate(block[: size - self.least + 1]):
            for template, place in self.prefixes.get(word, ()):
                needed = self.needed[template]
                if size < needed or at > size - needed:
                    continue
                so_far = common.get(template, 0) + 1
                left = min(len(self.sets[template]) - place, size - at) - 1
                common[template] = so_far if so_far + left >= needed else -size
        own = set(block)
        found = {}
        for template, so_far in common.items():
            if so_far > 0:
                n = len(own.intersection(self.sets[template]))
                if n >= self.needed[template]:
                    found[template] = n
        return found


def blocks(where: np.ndarray, ranks: np.ndarray, step: int):
    """Sorted sets of the ranks within each block that holds any; words without rank are -1."""
    known = ranks >= 0
    where, ranks = where[known], ranks[known]
    if not len(where):
        return
    # A word stands in the block that starts before it and in the one before that.
    for block in np.unique(np.concatenate([where // step, np.maximum(where // step - 1, 0)])).tolist():
        lo, hi = np.searchsorted(where, [block * step, (block + 2) * step])
        yield np.unique(ranks[lo:hi]).tolist()


def joined(placed: DataFrame, templates: list[list[int]], frequency: dict[int, int], share: float, step: int) -> DataFrame:
    """``placed`` with the templates that any block of a text meets, and the largest share held."""
    index = Index(templates, frequency, share)
    size = 1 + max([*frequency, *index.rank], default=0)
    rank_of = np.full(size, -1, dtype=np.int64)
    for word, rank in index.rank.items():
        rank_of[word] = rank
    opening = np.zeros(size, dtype=bool)
    for word, rank in index.rank.items():
        opening[word] = rank in index.prefixes

    def run(batches):
        for batch in batches:
            met, best = [], []
            for where, ids in zip(batch.column("places"), batch.column("ids")):
                where, ids = (a.values.to_numpy().astype(np.int64) for a in (where, ids))
                held: dict[int, float] = {}
                if opening[ids].any():
                    for block in blocks(where, rank_of[ids], step):
                        for template, n in index.met(block).items():
                            held[template] = max(held.get(template, 0.0), n / len(index.sets[template]))
                met.append(sorted(held))
                best.append(max(held.values(), default=0.0))
            own = [batch.column(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(met, pa.list_(pa.int32())), pa.array(best, pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "met", "best"],
            )

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<int>, met array<int>, best double"
    return placed.mapInArrow(run, schema)


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    share: float = SHARE,
    step: int = STEP,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: one row per
    row of ``docs``. Phrases and templates are (label, words in lower case) pairs."""
    too_long = [label for label, text in templates if len(text.split()) > step]
    if too_long:
        raise ValueError(f"templates longer than {step} words: {too_long}")
    words = vocabulary(*(text for _, text in [*phrases, *templates]))
    number = {word: at for at, word in enumerate(words)}
    placed = keep(places(docs, phrases, words), "places")
    # One row per word of the templates.
    counts = placed.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()
    sets = [[number[word] for word in text.split()] for _, text in templates]
    found = joined(placed, sets, {row.id: row.n for row in counts}, share, step)
    named = lambda labels, ids: F.transform(ids, lambda at: F.element_at(F.array(*(F.lit(label) for label, _ in labels)), at + 1)) if labels else F.array().cast("array<string>")
    listed = lambda names: F.concat_ws(",", F.sort_array(F.array_distinct(names)))
    base = named(phrases, F.col("base"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(base).alias("base_labels"),
        listed(F.concat(base, named(templates, F.col("met")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("best")).alias("score"),
    )
