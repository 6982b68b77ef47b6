"""The training-data operators against brute force, on small tables with every kind of odd row."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from checking import compare, duck
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, components, dedup, packing, quality, queries, rules, simhash, suffixes, topk, urls, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, host string, _row string, key string, n bigint"
LONG = " ".join(f"word{n % 701}" for n in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (None, "no id at all"), (None, None), (4, "a b"), (4, "a b"),
    (5, "Same words here."), (6, "same words HERE."), (7, "é ñ ß İ Σ ΑΣ <|endoftext|> it's 12 !!?"), (8, LONG), (9, LONG),
    (10, "x" * 5000), (4, "other text under the same id"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 1 else "s", "h", "r", "k", 1) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    problem, _ = compare(spark, duck(SF), queries.queries()[name], queries.oracle_sql()[name], SF)
    assert problem == ""


def ids_of(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_bpe_is_the_librarys(spark, odd, empty, reference):
    rows = bpe.decode(bpe.encode(odd, bpe.tokenizer_path()), bpe.tokenizer_path()).collect()
    found = sorted((str(r.doc_id), ids_of(r.ids), r.text) for r in rows)
    wanted = []
    for doc_id, text in ODD:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        wanted.append((str(doc_id), ids, reference.decode(ids, skip_special_tokens=False)))
    assert found == sorted(wanted)
    assert bpe.digests(empty, bpe.tokenizer_path()).count() == 0


def test_stream_emits_what_the_whole_word_gives(reference):
    coder = bpe.Transducer(bpe.tokenizer_path())
    rng = random.Random(1)
    for signs in ("ab", "thein", "aeinrst", "!?.-"):
        word = "".join(rng.choice(signs) for _ in range(4 * coder.lookahead))
        blocks = [word[at : at + 97].encode() for at in range(0, len(word), 97)]
        assert list(coder.stream(blocks)) == reference.encode(word, add_special_tokens=False).ids


def test_texts_pass_in_blocks(reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    coder = bpe.Transducer(bpe.tokenizer_path())
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["word", "É", "é", " ", "\n ", "'s", "\x1c", "12", "<|endoftext|>", "ß", "\u3000", "x" * 30]) for _ in range(rng.randint(0, 40)))
        ids = reference.encode(text, add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        data = coder.encode(text)
        assert ids_of(data) == ids
        decoder = coder.decoder()
        found = "".join([part for at in range(0, len(data), 12) for part in decoder.feed(data[at : at + 12])]) + decoder.finish()
        assert found == decoded
        assert bpe.digests_of(coder, text) == (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    running, ids = coder.decoder(words=True), np.array(reference.encode("two words, and é").ids, dtype="<u4")
    parts = [part for at in ids for part in running.feed(at.tobytes())]
    assert ("".join(parts) + running.finish()).split() == "two words , and é".split()


def test_memory_of_words_is_bounded():
    known = bpe.Recent(most=10_000)
    for n in range(5000):
        known.put(f"word {n}", b"1234")
        assert sum(bpe.ENTRY_BYTES + len(k) + len(v) for half in (known.young, known.old) for k, v in half.items()) <= 20_000
    assert known.again("word 4999") is None and known.young["word 4999"] == b"1234" and known.again("word 1") is None


def test_packing_is_gapless_and_whole(spark, odd, empty):
    packed = packing.pack(odd, bpe.tokenizer_path(), capacity=64)
    rows = packed.collect()
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append(row)
    for parts in sequences.values():
        end = 0
        for part in sorted(parts, key=lambda r: r.offset):
            assert part.offset == end and part.start == 64 * part.piece and len(part.ids) == 4 * part.length
            end += part.length
        assert end <= 64
    coder = bpe.transducer(bpe.tokenizer_path())
    assert sum(r.length for r in rows) == sum(len(coder.encode(t or "")) // 4 + 1 for _, t in ODD)
    crcs = packing.pack(odd, bpe.tokenizer_path(), capacity=64, payload="ids_crc32").collect()
    assert Counter(r.ids_crc32 for r in crcs) == Counter(zlib.crc32(r.ids) for r in rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in rows)
    assert packing.pack(empty, bpe.tokenizer_path()).count() == 0


def test_words_of_the_library_and_of_the_transducer(spark):
    coder, other = packing.library_words(bpe.tokenizer_path()), bpe.transducer(bpe.tokenizer_path())
    texts = [t or "" for _, t in ODD] + ["".join(map(chr, range(1, 0x250))), "ÀÉ日本 naïve\x7f\xad ÿ" * 9, "\x1c\x1d a\x85b", "ab" * 33, "é" * 64, "é" * 65]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("text is not null").collect()]
    assert [coder.encode(t) for t in texts] == [other.encode(t) for t in texts]


def test_pieces_are_the_librarys(spark, odd, reference):
    rows = packing.pack(odd, bpe.tokenizer_path(), capacity=64, payload="ids_crc32").collect()
    wanted, total = Counter(), 0
    for doc_id, text in ODD:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 64)):
            wanted[doc_id, piece, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    used = len({r.sequence_id for r in rows})
    assert -(-total // 64) <= used <= -(-total // 64) + 2


def test_plans_use_every_piece_once():
    for seed in range(40):
        rng = random.Random(seed)
        capacity = rng.choice([8, 64, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 10 ** rng.randint(0, 6)) for _ in range(rng.randint(1, 60))}
        used = Counter()
        for lengths, times in packing.plan(counts, capacity):
            assert times > 0 and sum(a * b for a, b in lengths) <= capacity
            for length, each in lengths:
                used[length] += each * times
        assert used == counts
    # One exact triple, found although no pair fills the gap.
    assert packing.plan({10: 1, 3: 1, 2: 1, 1: 1}, 16) == [([(10, 1), (3, 1), (2, 1), (1, 1)], 1)]
    # 6 + 6 + 2 lacks a second 6; the next triple with 6 fills the gap.
    assert packing.plan({20: 1, 6: 1, 5: 1, 3: 1, 2: 1}, 34)[0] == ([(20, 1), (6, 1), (5, 1), (3, 1)], 1)


def test_index_of_sums():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.choice([20, 50])
        counts = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 9))}
        left = packing.Available(counts, capacity)
        sums = [{0}]
        for _ in range(3):
            sums.append({s + n for s in sums[-1] for n in counts if s + n <= capacity})
        for index, wanted in zip((left.single, left.pairs, left.triples), sums[1:]):
            assert {s for s in range(capacity + 1) if index >> s & 1} == wanted
        # A filling is found exactly where one to three others, each there often enough, fill the gap.
        pieces = list(Counter(counts).elements())
        for first in counts:
            others = list(pieces)
            others.remove(first)
            fills = any(sum(c) == capacity - first for n in range(4) for c in itertools.combinations(others, n))
            assert (left.filling(first) is not None) == fills


def test_suffix_array():
    for seed in range(500):
        rng = random.Random(seed)
        text = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda at: text[at:])


def repeats(docs):
    """Kept bytes and removed runs by the definition itself."""
    first, found = {}, {}
    for doc_id, text in sorted(docs):
        gone = []
        for at in range(len(text) - 99):
            if text[at : at + 100] in first:
                if gone and at <= gone[-1][1]:
                    gone[-1][1] = at + 100
                else:
                    gone.append([at, at + 100])
            else:
                first[text[at : at + 100]] = True
        edges = [0, *(e for g in gone for e in g), len(text)]
        found[doc_id] = (b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), gone)
    return found


def passages():
    rng = random.Random(3)
    base = "".join(rng.choice("ab cé") for _ in range(400))
    docs = []
    for doc_id in range(150):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, 300)
            text += base[at : at + rng.randint(50, 250)] + "Of " * rng.choice([0, 0, 60])
        docs.append((doc_id, text))
    line = "A common line that is longer than ninety bytes but not by much, to be met in many documents....."
    return docs + [(1000 + n, line[:95] + f"{n:06d}" * 20) for n in range(60)]


@pytest.mark.parametrize("crowded", [1024, 8])
def test_suffix_dedup(spark, monkeypatch, crowded):
    monkeypatch.setattr(dedup, "CROWDED", crowded)
    monkeypatch.setattr(dedup, "BLOCK_BYTES", 20_000)
    docs = passages()
    wanted = repeats([(i, t.encode()) for i, t in docs])
    rows = dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(rows) == len(docs)
    for row in rows:
        kept, gone = wanted[row.doc_id]
        assert bytes(row.kept) == kept and [[s.start, s.end] for s in row.spans] == gone


def test_suffix_dedup_of_odd_rows(spark, odd, empty):
    rows = dedup.without_repeats(odd).collect()
    texts = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert len(rows) == len(ODD) and texts[9] == "" and texts[10] == "x" and rows[0].asDict().keys() == set(odd.columns)
    assert len(texts[8]) < len(LONG)
    assert dedup.digests(empty).count() == 0


def test_anchors_are_not_sent_to_the_driver(spark):
    rows = dedup.documents(spark.createDataFrame([(1, "word " * 60)], "doc_id long, text string"))
    often = dedup.anchored(rows, only_hash=True).distinct()
    found = dedup.repeated_runs(rows, often)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and found.count() > 0


def test_only_cut_characters_are_dropped(spark):
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefgh ") for _ in range(150))
    # The first bytes of both characters are alike, so that the repeat ends within the second.
    docs = [(1, base + "\u00e9"), (2, "a\ufffdb" + base + "\u00e8\ufffd end"), (3, "\ufffd alone")]
    rows = dedup.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {1: docs[0][1], 2: "a\ufffdb\ufffd end", 3: "\ufffd alone"}


def test_texts_of_one_id_are_told_apart(spark):
    passage = "A passage that this text has twice, of more than a hundred bytes: 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOP. "
    twice, other = passage * 2 + "18472", hashlib.sha512(b"x48645").hexdigest() + hashlib.sha512(b"y48645").hexdigest()
    docs = spark.createDataFrame([(None, twice), (None, other)], "doc_id bigint, text string")
    # Alike in 32 bits.
    assert docs.select(F.hash("text")).distinct().count() == 1
    assert {bytes(r.kept).decode() for r in dedup.dedup(docs).collect()} == {passage + "18472", other}


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    import xxhash

    shingles = [b" ".join(words[at : at + 3]) for at in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert Counter(r.fingerprint for r in rows) == Counter("%016x" % fingerprint(t) for _, t in ODD)
    of = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert of[1] == of[2] == of[3] == 1 and of[5] == of[6] == 5 and of[8] == of[9] == 8
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_component_stays(spark, odd, empty):
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(queries.table(spark, SF, "documents")).collect()}
    kept = simhash.one_of_each(queries.table(spark, SF, "documents"))
    assert kept.columns == queries.table(spark, SF, "documents").columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))
    rows = simhash.one_of_each(odd).collect()
    assert len(rows) == len({fingerprint(t) for _, t in ODD}) and {r.doc_id for r in rows} >= {1, 4, 5, 8} and rows[0].key == "k"
    assert simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("crowded", [32, 1])
def test_simhash_links(spark, monkeypatch, crowded):
    rng = random.Random(7)
    prints = []
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.append(fp)
            for _ in range(rng.randint(0, 3)):
                fp ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root[a] = root[b] = low
                    changed = True
    monkeypatch.setattr(simhash.links, "__defaults__", (crowded,))
    table = spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, fp bigint")
    assert {r.doc_id: r.component_id for r in simhash.group(table).collect()} == dict(enumerate(root))


def test_cells_and_hubs_are_not_sent_to_the_driver(spark):
    few = spark.range(300).select((F.col("id") % 40).alias("fp"))
    for found in (simhash.shared_cells(few), simhash.hub_links(few)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_path(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, 101), (7, 7)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {n: 0 for n in range(61)} | {100: 100, 101: 100}


def test_url_rules_and_hosts(spark):
    schema = "page_id bigint, url string, host string, path string, score double"
    found = [
        (1, None), (2, "http://WWW.Example.COM/en/x"), (3, "http://a.example.com?x=/en/"), (4, "no scheme"), (5, "http://com"),
        (6, "HTTPS://net/es/é\n/x#y"), (None, ""), (7, "http://x.example.com/en/"), (7, "http://x.example.com/en/"), (8, "http://a.org/1"),
    ]
    table = spark.createDataFrame([(i, u, "clash", None, 0.5) for i, u in found], schema)
    rows = {r.page_id: r for r in urls.judge(table, queries.URL_RULES).collect()}
    assert (rows[2].host, rows[2].path, rows[2].rule, rows[2].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (rows[3].host, rows[3].path, rows[3].rule) == ("a.example.com", "", None)
    assert (rows[6].host, rows[6].path, rows[6].verdict) == ("net", "/es/é\n/x", "block")
    assert rows[7].rule == "example.com/en/" and rows[1].host == rows[4].path == "" and rows[5].rule is None
    assert urls.judge(table.where("false"), queries.URL_RULES).count() == 0


def test_url_trees_learn(spark):
    pages = [(n, f"http://{'win' * 4 + '-' if n % 2 else ''}{'abcdefgh'[n % 8] * 5}.org/{'9' * (n % 7)}") for n in range(400)]
    labels = spark.createDataFrame([(u, float(n % 2)) for n, u in pages[:300]], "url string, label double")
    rows = urls.judge(spark.createDataFrame(pages[300:], "page_id bigint, url string"), [], labels).collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in rows) >= 95


def test_urls_by_definition(spark):
    """Every page's host, path and rule, and every feature, against the definitions in plain Python."""
    pages = queries.table(spark, "/root/testdata/sf0.01", "pages")
    long = "http://a.example.com/en/" + "x9-&" * 50_000 + "?" + "p=1&" * 1000
    more = [(None, None), (-1, ""), (-2, "://"), (-3, "x://net/fr/?a&b#c?d"), (-4, "http://exämple.com/EN/"), (-5, long), (-5, long), (-6, "A://B.COM/")]
    table = pages.select("page_id", "url").unionAll(spark.createDataFrame(more, "page_id bigint, url string"))
    longest = sorted((rule.where for rule in queries.URL_RULES), key=len, reverse=True)
    said = {rule.where: rule.verdict for rule in queries.URL_RULES}

    def parts(url):
        scheme, mark, rest = (url or "").partition("://")
        if not mark:
            return "", "", None
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [w for w in longest if path.startswith("/" + w.split("/", 1)[1]) and ("." + host).endswith("." + w.split("/")[0])]
        return host, path, fits[0] if fits else None

    rows = urls.judge(table, queries.URL_RULES).collect()
    assert len(rows) == table.count()
    assert Counter((r.page_id, r.url) for r in rows) == Counter((r.page_id, r.url) for r in table.collect())
    for row in rows:
        host, path, rule = parts(row.url)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (said[rule] if rule else "block" if row.score >= urls.BLOCK_AT else "allow")
    measured = urls.features(table.withColumn("host", urls.host_of(F.col("url"))).withColumn("path", urls.path_of(F.col("url")))).collect()
    for row in measured:
        url, (host, path, _) = row.url or "", parts(row.url)
        query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
        entropy = -sum(n / len(host) * np.log2(n / len(host)) for n in Counter(host).values())
        assert (row.f_length, row.f_host_length, row.f_depth) == (len(url), len(host), path.count("/"))
        assert (row.f_labels, row.f_hyphens) == (host.count("."), host.count("-"))
        assert row.f_digits == pytest.approx(sum(c in "0123456789" for c in url) / max(1, len(url)))
        assert row.f_entropy == pytest.approx(entropy) and row.f_secure == url.startswith("https")
        assert row.f_parameters == (query.count("&") + 1 if query else 0) and 0 <= row.suffix_slot < urls.SUFFIX_SLOTS


def test_url_statistics_by_definition(spark):
    labels = [(f"http://h{n % 9}.{'abc'[n % 3]}/", float(n % 4 == 0)) for n in range(120)]
    table = spark.createDataFrame(labels, "url string, label double")
    rows = urls.features(table.withColumn("host", urls.host_of(F.col("url"))).withColumn("path", urls.path_of(F.col("url"))))
    slots = {}
    for row in rows.collect():
        slots.setdefault(row.suffix_slot, []).append(row.label)
    found = {r.suffix_slot: r for r in urls.suffix_statistics(rows, 0.25).collect()}
    assert found.keys() == slots.keys()
    for slot, marks in slots.items():
        assert found[slot].f_suffix_rate == pytest.approx((sum(marks) + urls.SUFFIX_PRIOR * 0.25) / (len(marks) + urls.SUFFIX_PRIOR))
        assert found[slot].f_suffix_count == pytest.approx(np.log1p(len(marks)))


def test_quality_by_definition(spark):
    """Scores from class moments, solves and determinants in plain NumPy."""
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    x = {i: np.array(quality.statistics(text or "")) for i, text in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts and r.doc_id not in held and r.quality in (0, 1)}
    classes = {k: np.array([x[i] for i, mark in marks.items() if mark == k]) for k in (0, 1)}
    total = len(marks)
    spread = sum(len(rows) / total * rows.var(axis=0) for rows in classes.values())
    size = x[next(iter(x))].size

    def log_density(value, rows):
        part = min(1.0, 0.05 + size / (size + len(rows)))
        covariance = (1 - part) * np.cov(rows.T, bias=True) + part * np.diag(np.maximum(spread, 1e-4))
        off = value - rows.mean(axis=0)
        return np.log(len(rows) / total) - 0.5 * (off @ np.linalg.solve(covariance, off) + np.linalg.slogdet(covariance)[1])

    rows = quality.classify(docs, labels).collect()
    assert {r.doc_id for r in rows if r.held_out} == held and len(rows) == len(texts)
    for row in rows:
        odds = log_density(x[row.doc_id], classes[1]) - log_density(x[row.doc_id], classes[0])
        wanted = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        assert row.score == pytest.approx(wanted, abs=1e-6)
        assert row.predicted == (row.score >= 0.3)


def test_good_documents_of_odd_rows(spark, odd, empty):
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    scores = Counter()
    for row in quality.classify(odd, labels).collect():
        scores[row.doc_id] += row.predicted
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == +scores
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.keep_good(odd, labels.where("false")).count() == len(ODD)


def test_quality(spark, odd, empty):
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.classify(queries.table(spark, "/root/testdata/sf0.01", "documents"), labels)
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    scored = quality.classify(odd, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0.5 for r in quality.classify(odd, labels.where("false")).collect())
    assert quality.classify(empty, labels).count() == 0


def test_rules_of_odd_rows(spark, odd, empty):
    rows = rules.judge(odd).collect()
    long = next(r for r in rows if r.doc_id == 8)
    assert len(rows) == len(ODD) and long.n_words == 30_000 and long.base_failed and long.n_repeat_words == 30_000
    assert next(r for r in rows if r.doc_id == 1).n_words == 0
    assert rules.keep_good(odd).columns == odd.columns and rules.judge(empty).count() == 0


def test_hosts_that_fail_are_left_out(spark):
    good = " ".join(f"w{n}" for n in range(60))
    docs = [(n, good if n % 10 else "bad", "fine") for n in range(200)] + [(500 + n, "bad" if n % 10 else good, "spam") for n in range(200)]
    rows = rules.judge(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
    assert {r.doc_id < 200 for r in rows if r.kept} == {True} and sum(r.kept for r in rows) == 180


def test_warc_round_trip(spark):
    pages = [(1, None, None), (2, "u\r\nx é", ""), (3, "http://a", "é"), (3, "http://a", "é"), (None, "x", "é"), (5, "x", "é"), (None, "x", "only"), (9, "x", LONG)]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, payload string")
    rows = warc.read(warc.archive(table)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in rows) == Counter([
        (1, "response", None), (2, "revisit", 1), (3, "response", None), (3, "response", None), (None, "revisit", 3),
        (5, "revisit", 3), (None, "response", None), (9, "response", None),
    ])
    digest = base64.b32encode(hashlib.sha1("é".encode()).digest()).decode()
    assert {r.payload_digest for r in rows if r.payload_bytes == 2} == {digest}
    assert {bytes(r.payload) for r in rows if r.page_id == 9} == {LONG.encode()}
    assert all(r.refers_to is None for r in warc.read(warc.archive(table, min_bytes=3)).collect())
    assert warc.read(warc.archive(table.where("false"))).count() == 0


def test_damaged_archives_are_noticed():
    import io

    whole = warc.member(warc.record(1, "u", b"payload", None))
    assert len(list(warc.records(io.BytesIO(whole + whole)))) == 2
    wrong = warc.member(warc.record(1, "u", b"payload", None).replace(b"\r\n\r\npayload", b"\r\n\r\npayloae"))
    for data in (whole[:-9], wrong, b"plain text"):
        with pytest.raises(warc.Damaged):
            list(warc.records(io.BytesIO(data)))


def test_topk_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = [(int(n), [float(x) for x in rng.normal(0, 0.2, 16)], "clash") for n in range(300)]
    vectors += [(400 + n, vectors[0][1], "copy") for n in range(40)]
    odd = [(700, None, ""), (720, [1.0, None], ""), (740, [float("nan")] * 16, ""), (760, [float("inf")] * 16, ""), (780, [1.0], "")]
    table = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<double>, score string")
    rows = topk.search(table, F.col("vec_id") % 20 == 0, k=7, vector_block=64, query_block=5).collect()
    ids = np.array([v[0] for v in vectors])
    whole = np.floor(64 * np.array([v[1] for v in vectors])).astype(np.int64)
    wanted = []
    for at in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[at]
        order = [o for o in np.lexsort((ids, -scores)) if o != at][:7]
        wanted += [(int(ids[at]), r + 1, int(ids[o]), int(scores[o])) for r, o in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == sorted(wanted)


def test_postings_of_sparse_and_large_vectors():
    rng = np.random.default_rng(6)
    for scale, share in ((3, 1.0), (200, 0.1), (1 << 28, 0.3)):
        vectors = rng.integers(-scale, scale + 1, (400, 24)) * (rng.random((400, 24)) < share)
        vectors[5] = 0
        block = topk.Block(np.arange(400), vectors, np.ones(400, np.int64))
        postings = [(r, d, i) for s in block.segments for d, rows, impacts in s.lists() for r, i in zip(rows, impacts)]
        assert len(postings) == np.count_nonzero(vectors) and all(vectors[r, d] == i for r, d, i in postings)
        upper = [np.abs(s.impact).max() for s in block.segments]
        assert upper == sorted(upper, reverse=True)
        queries = np.concatenate([vectors[:20], np.zeros((1, 24), np.int64)])
        asked = np.array([*range(20), 999])
        found = list(zip(*block.search(asked, queries, 9)))
        for query_id, query in zip(asked, queries):
            scores = vectors @ query
            order = [o for o in np.lexsort((np.arange(400), -scores)) if o != query_id][:9]
            mine = sorted((-s, v) for q, v, s, _ in found if q == query_id)
            assert mine == [(-scores[o], o) for o in order]


def test_a_search_stops_by_proof(monkeypatch):
    rng = np.random.default_rng(7)
    vectors = rng.integers(-2, 3, (500, 32))
    vectors[::50, :4] = 4000
    read = []
    add = topk.Segment.add
    monkeypatch.setattr(topk.Segment, "add", lambda self, *a: read.append(len(self.row)) or add(self, *a))
    block = topk.Block(np.arange(500), vectors, np.ones(500, np.int64))
    (_, scores), = block.batch(np.array([0]), vectors[:1], 5)
    assert sorted(scores, reverse=True) == sorted((vectors @ vectors[0])[1:], reverse=True)[:5]
    assert len(read) == 1 < len(block.segments) and read[0] == 40


def test_topk_counts_repeated_rows(spark):
    vectors = [(n, [float(n % 7), float(n % 5), 1.0], "clash") for n in range(1, 60)]
    vectors += vectors[:25] + vectors[8:12] * 3 + [(20, [9.0, 9.0, 9.0], "clash"), (None, [8.0, 8.0, 8.0], None), (None, [8.0, 8.0, 8.0], None)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, rank string").withColumn("copies", F.lit("clash"))
    is_query = F.col("vec_id") % 20 == 0
    rows = topk.search(table, is_query, k=6, scale=1, vector_block=16, query_block=1).collect()
    wanted = []
    for query in (20, 40):
        asked = {tuple(v) for i, v, _ in vectors if i == query}
        scores = [(-sum(a * b for a, b in zip(v, q)), -(2**63) if i is None else i) for q in asked for i, v, _ in vectors if i != query]
        wanted += [(query, r + 1, None if i == -(2**63) else i, int(-score)) for r, (score, i) in enumerate(sorted(scores)[:6])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == sorted(wanted, key=lambda w: w[:2])
    assert sorted(r.rank for r in rows if r.query_id == 40 and r.vec_id is None) == [2, 3]
    empty = topk.search(table.where("false"), is_query)
    assert empty.collect() == [] and topk.search(table.where("vec_id = 1"), is_query).collect() == []
    wide = spark.createDataFrame([(n, [float(n)] * 20_000) for n in (20, 21, 22)], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in topk.search(wide, is_query, scale=1).orderBy("rank").collect()] == [22, 21]


def test_tool_calls_are_linked(spark):
    schemas = {"t": [chat.Field("a", "integer", maximum=5), chat.Field("b", "object", required=False)]}
    calls = spark.createDataFrame([
        (1, 1, "x", "t", '{"b":{"z":1,"y":{"$ref":"y"}},"a":1}'), (1, 3, "y", "t", '{"a": 2}'), (1, 3, "y", "t", '{"a": 2}'),
        (1, 5, "c1", "t", '{"a":1,"b":{"$ref":"c2"}}'), (1, 5, "c2", "t", '{"a":1,"b":{"$ref":"c1"}}'), (1, 6, "bad", "u", "no json"),
        (None, 1, "x", "t", '{"a":9}'), (1, 7, "m", "t", '{"b":{"$ref":"gone"}}'), (1, 8, None, "t", "{}"),
    ], "conv_id bigint, turn bigint, call_id string, tool string, arguments string")
    results = spark.createDataFrame(
        [(1, 2, "x", "one"), (1, 4, "y", None), (1, 9, "who", "nobody"), (None, 2, "x", "n")], "conv_id bigint, turn bigint, call_id string, content string"
    )
    found = chat.linked(calls, results, schemas).collect()
    rows = {(r.conv_id, r.call_id): r for r in found}
    assert rows[1, "x"].arguments == '{"a":1,"b":{"y":{"$ref":"y"},"z":1}}' and rows[1, "x"].level == 1 and rows[1, "x"].status == "linked"
    assert rows[1, "y"].level == 0 and rows[1, "c1"].level is None and rows[1, "c1"].errors == ["reference: circular"]
    assert rows[1, "bad"].errors == ["tool: unknown", "arguments: not an object"] and rows[1, "who"].status == "orphan"
    assert rows[None, "x"].errors == ["a: above 5"] and rows[1, "m"].errors == ["a: missing", "reference: missing"] and len(found) == 9
    assert rows[1, None].status == "unanswered" and rows[1, None].errors == ["a: missing", "call_id: missing"]


CALLS = "conv_id bigint, turn bigint, call_id string, tool string, arguments string"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"


def test_rows_without_identifier_stay(spark):
    calls = spark.createDataFrame([
        (1, 1, None, "t", "{}"), (1, 1, None, "t", "{}"), (1, None, None, "t", '{"b": {"$ref": "x"}}'), (None, None, None, None, None),
        (1, 2, "x", "t", '{"b": {"$ref": "a \\"quoted\\" é"}}'), (1, 3, 'a "quoted" é', "t", '{"b": "{\\"$ref\\": \\"x\\"}"}'),
        (1, 4, "lost", "t", '{"b": {"$ref" : "gone"}}'),
    ], CALLS).selectExpr("*", "1 AS level", "'clash' AS status", "'clash' AS key")
    results = spark.createDataFrame([(1, 2, None, "one"), (1, None, None, None), (1, 2, None, "one")], RESULTS)
    rows = chat.linked(calls, results, {"t": [chat.Field("b", "string", required=False)]}).collect()
    of = {r.call_id: r for r in rows if r.call_id}
    assert of["x"].level == 1 and of['a "quoted" é'].level == 0 and "reference: missing" in of["lost"].errors
    rest = Counter((r.conv_id, r.turn, r.status, r.level) for r in rows if not r.call_id)
    assert rest == Counter([(1, 1, "unanswered", 0), (1, None, "unanswered", 2), (None, None, "unanswered", 0), (1, None, "orphan", None), (1, None, "orphan", None)])
    empty = chat.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"), calls.where("false"), results.where("false"), {})
    assert empty.count() == 0
    long = spark.createDataFrame([(1, 1, "user", LONG * 20)], "conv_id bigint, turn bigint, role string, text string")
    assert len(chat.formatted(long, calls.where("false"), results.where("false"), {}).first().json) > len(LONG) * 20


def test_levels_are_longest_ways(spark):
    rng = random.Random(12)
    needs = {}
    for n in range(120):
        kind = rng.random()
        others = [f"c{m}" for m in range(max(0, n - 5), n)] if kind < 0.97 else [f"c{m}" for m in range(120)]
        needs[f"c{n}"] = rng.sample(others, min(len(others), 0 if kind < 0.1 else 1 if kind < 0.8 else rng.randint(2, 3)))
    needs |= {f"long{n}": [f"long{n - 1}"] if n else [] for n in range(300)}
    needs |= {"join": ["long299", "long7"], "after": ["join"], "loop": ["loop"], "behind": ["loop"], "both": ["loop", "long3"]}

    def level(name, path=()):
        if name in path:
            return None
        below = [level(o, (*path, name)) for o in needs[name]]
        return None if None in below else max(below, default=-1) + 1

    import sys

    sys.setrecursionlimit(5000)
    wanted = {name: level(name) for name in needs}
    rows = [(None, n, name, "t", '{"b": [' + ", ".join('{"$ref": "%s"}' % o for o in of) + "]}") for n, (name, of) in enumerate(needs.items())]
    none = spark.createDataFrame([], RESULTS)
    found = chat.linked(spark.createDataFrame(rows, CALLS), none, {"t": []}).collect()
    assert {r.call_id: r.level for r in found} == wanted and wanted["after"] == 301


def test_pipeline(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    whole = docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = packing.keep(after, name.replace(" ", "-"))
        kept.append((before, {r.doc_id: r.text for r in docs.collect()}))
    assert 0 < docs.count() < whole
    # Near duplicates: what is kept of each group of linked fingerprints is its smallest id.
    before, after = kept[2]
    prints = {doc_id: fingerprint(text) for doc_id, text in before.items()}
    root = {doc_id: doc_id for doc_id in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if root[b] < root[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b]
    assert after == {doc_id: before[doc_id] for doc_id in set(root.values())}
    # Repeats: bytes by the definition, and whole characters.
    before, after = kept[3]
    wanted = repeats([(doc_id, text.encode()) for doc_id, text in before.items()])
    assert after.keys() == before.keys()
    for doc_id, text in after.items():
        assert len(text.encode()) <= len(wanted[doc_id][0]) <= len(text.encode()) + 6 * (1 + len(wanted[doc_id][1]))
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(after) and len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 2048) + 2
    empty = queries.table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
