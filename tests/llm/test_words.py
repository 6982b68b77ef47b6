"""Spelling variants, source divergence and license scans against brute force and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from checking import rows_of

from tidemark.llm import divergence, licenses, spelling

DOCS = "doc_id bigint, text string, lang string, source string, word string, n bigint, term string, block int"
LONG = "abcdefgh abcdefgx " * 20_000
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n", "en", None), (None, "Spelling spelling SPELLING", None, None),
    (4, "speling spelling", "en", "a"), (4, "speling spelling", "en", "a"), (5, "Éclair éclair Äquator äquator İstanbul", "de", "b"),
    (6, LONG, "en", "b"), (7, "x" * 5000 + " " + "x" * 4999, "en", "b"), (None, "x" * 5000, "en", "b"),
    (8, "Under the MIT License. under\nthe-mit license CC BY-NC apache license, version 2.0", "en", "a"),
]


def table(spark, rows):
    return spark.createDataFrame([(*row, "w", 7, "t", 3) for row in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


def edit(a, b):
    """Whether one inserted, deleted or replaced sign makes ``b`` of ``a``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:at] + long[at + 1 :] == short for at in range(len(long)))


def spelled(docs):
    """Words, forms and roots by the definition itself."""
    counts = Counter()
    for doc_id, text, *_ in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    found, form = {}, {}
    for w, n in words.items():
        near = [o for o in words if abs(len(o) - len(w)) <= 1 and edit(w, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        found[w] = (form[w], n, len(near), words[best] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (found[w][0], root, *found[w][1:])
    return found


def variants(docs):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}


def test_spelling_of_odd_rows(spark, odd):
    found = variants(odd)
    assert found == spelled(ODD) and found["x" * 5000][2] >= 1 and found["abcdefgh"][3] >= 1
    assert spelling.variants(odd.where("false")).count() == 0
    assert variants(table(spark, ODD * 2)) == spelled(ODD * 2)


@pytest.mark.parametrize("cell, leaf", [(1 << 13, 12), (16, 2)])
def test_spelling_against_brute_force(spark, monkeypatch, cell, leaf):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    monkeypatch.setattr(spelling, "SAMPLED_LEAF", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    rng = random.Random(cell)
    docs = []
    for n in range(12):
        word = "".join(rng.choice("abcdeÀéÿ") for _ in range(rng.randint(6, 11)))
        for step in range(40):
            docs.append((n * 100 + step, " ".join([word] * rng.choice([1, 2, 30, 400])), "en", "s"))
            word = word if len(word) > 5 else word + "abcdeÀ"
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(["", "a", "ab", "é", word[at]]) + word[at + 1 :]
    # Anagrams: points that no plane tells apart.
    docs += [(5000 + n, " ".join("".join(rng.sample("aabbccd", 7)) for _ in range(300)), "en", "s") for n in range(3)]
    wanted = spelled(docs)
    assert sum(w[0] is not None for w in wanted.values()) > 10 and sum(w[0] is not None and w[1] != w[0] for w in wanted.values()) > 0
    assert variants(table(spark, docs)) == wanted


def test_planes_lose_no_pair():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(8)) for _ in range(900)})
    a, b = spelling.near_pairs(words, words, same=True)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, v in enumerate(words) for j, w in enumerate(words) if edit(v, w)}
    shorter = sorted({w[:3] + w[4:] for w in words} | {"".join(rng.choice("abc") for _ in range(7)) for _ in range(200)})
    a, b = spelling.near_pairs(words, shorter, same=False)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, v in enumerate(shorter) for j, w in enumerate(words) if edit(v, w)}


def audited(docs, least, ranks=50):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
        groups.add((lang, source))
    rows = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        own = {g[1]: counts[g] for g in groups if g[0] == lang}
        whole = sum(own.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        shares, all_of = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            pairs = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, shares[s][t] - all_of[t]) for t in kept if own[s][t] and shares[s][t] > all_of[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                rows += [(lang, s, part, i, v, at + 1) for at, (i, v) in enumerate(found) if part == "pair" or at < ranks]
    return rows


def compared(found, wanted):
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(columns, [tuple(r) for r in found.select(*columns).collect()]) == rows_of(columns, wanted)


def test_divergence_of_odd_rows(spark, odd):
    for least in (1, 30):
        compared(divergence.audit(odd, least_docs=least), audited(ODD, least))
    assert divergence.audit(odd.where("false")).count() == 0


@pytest.mark.parametrize("terms, groups", [(4096, 64), (5, 3)])
def test_divergence_in_cells_of_any_size(spark, terms, groups):
    rng = random.Random(terms)
    words = ["".join(rng.choice("abcdéß") for _ in range(3)) for _ in range(60)]
    docs = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de"]), f"s{rng.randrange(12)}") for n in range(300)]
    docs += [(n, "alone", "fr", f"s{n}") for n in range(3)]
    compared(divergence.audit(table(spark, docs), least_docs=5, ranks=7, terms=terms, groups_per_block=groups), audited(docs, 5, 7))


def test_a_pair_has_one_name_in_all_term_blocks(spark):
    """Rows of a cell arrive in any order, which may differ from one term block to the next."""
    rows = [("s2", 1, [0], [9]), ("s1", 1, [1], [7]), ("s0", 1, None, None)]
    cells = []
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        source, least, pos, shares = zip(*(rows[at] for at in order))
        cell = pa.table({
            "lang": ["en"] * 3, "ga": [0] * 3, "gb": [0] * 3, "gblock": [0] * 3, "width": [2] * 3, "source": source, "least": least,
            "pos": pa.array(pos, pa.list_(pa.int64())), "shares": pa.array(shares, pa.list_(pa.int64())),
        })
        cells.append(sorted(map(tuple, (row.values() for row in divergence.cell_differences(cell).to_pylist()))))
    assert cells[0] == cells[1] == cells[2] == [("en", "s0", "s1", 6), ("en", "s0", "s2", 8), ("en", "s1", "s2", 14)]


def test_shares_of_very_large_counts(spark):
    rows = spark.createDataFrame([(9 * 10**17, 10**18, 10)], "n bigint, own bigint, kept bigint")
    row = rows.select(divergence.share(rows["n"], rows["own"], rows["kept"]).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**17 + 5) // (10**18 + 50)


def scanned(docs, phrases, templates, step):
    rows = []
    for doc_id, text, *_ in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
        base = [(at, label) for label, p in phrases for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        labels, best = {label for _, label in base}, 0.0
        for at in range(0, len(words), step):
            for label, template in templates:
                own = set(template.split())
                common = len(own.intersection(words[at : at + 2 * step]))
                if 5 * common >= 4 * len(own):
                    labels.add(label)
                    best = max(best, common / len(own))
        starts = [at for at, _ in base]
        rows.append((
            doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), 1.0 if base else best,
        ))
    return rows


SCANNED = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


@pytest.mark.parametrize("step", [32, 8])
def test_licenses_against_brute_force(spark, odd, step):
    rng = random.Random(step)
    templates = licenses.TEMPLATES if step == 32 else [("a", "one two three four five"), ("b", "one one six"), ("c", "seven"), ("d", "two eight nine ten")]
    pool = [w for _, t in templates for w in t.split()]
    docs = list(ODD)
    for n in range(150):
        words = [rng.choice([*pool, "other", "words", "here"]) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(templates)[1].split() if rng.random() < 0.7 else rng.choice(licenses.PHRASES)[1].split()
            for _ in range(rng.randint(0, 4)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((100 + n, rng.choice([" ", "\n", ", "]).join(words).title(), "en", "s"))
    found = licenses.scan(table(spark, docs), templates=templates, step=step).select(*SCANNED).collect()
    wanted = scanned(docs, licenses.PHRASES, templates, step)
    assert rows_of(SCANNED, [tuple(r) for r in found]) == rows_of(SCANNED, wanted)
    assert {label for row in wanted for label in row[6].split(",")} >= {label for label, _ in templates} | {"mit", "cc-by-nc"}
    assert licenses.scan(odd.where("false")).count() == 0


def test_filters_keep_every_template_that_is_met():
    rng = random.Random(1)
    for _ in range(300):
        templates = [rng.sample(range(30), rng.randint(1, 12)) for _ in range(4)]
        index = licenses.Index(templates, {w: rng.randint(0, 9) for w in range(30)}, share=rng.choice([0.5, 0.8, 1.0]))
        block = sorted(rng.sample(sorted(index.rank.values()), rng.randint(0, len(index.rank))))
        common = [len(set(block).intersection(own)) for own in index.sets]
        assert index.met(block) == {at: n for at, n in enumerate(common) if n >= index.needed[at]}


def test_long_texts_are_cut_between_words(spark):
    text = "Words of a text, " * 1000
    from tidemark.llm.common import byte_chunks

    for size in (1, 7, 100, 10**6):
        chunks = list(byte_chunks(text.encode(), licenses.BETWEEN, size))
        assert b"".join(chunks) == text.encode()
        assert sum((re.findall(rb"[A-Za-z]+", c) for c in chunks), []) == re.findall(rb"[A-Za-z]+", text.encode())
    assert np.array_equal(spelling.points(["abca"])[0][:3], [2, 1, 1])
