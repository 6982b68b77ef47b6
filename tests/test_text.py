import hashlib
import math
import random

from pyspark.sql import functions as F

from tidemark.functions import text, vectors

RAW = [
    "", "  a  b ", "Use American English", "[[MOS:DATE]]", "added {{x}} template", "3 categories added",
    "/* History */  ", "/* History */ more", "Reverted edits", "reverts", "Undid revision 5",
    "undid revisions", "fix  typo", "a b c",
]


def column(spark, values, expression):
    df = spark.createDataFrame([(at, v) for at, v in enumerate(values)], "at int, v string")
    return [row[0] for row in df.orderBy("at").select(expression(F.col("v"))).collect()]


def test_clean_comment(spark):
    assert column(spark, RAW, text.clean_comment) == [
        "", "a b", "", "", "", "", "", "/* History */ more", "", "reverts", "", "undid revisions",
        "fix typo", "a b c",
    ]


def test_searchable_text(spark):
    rows = [
        ("Alan Turing", None, None, "Alan Turing Alan Turing"),
        ("Ada", None, "expanded lead", "Ada Ada — expanded lead"),
        ("Ada", "A  summary", "use british english", "Ada Ada — A summary"),
        ("", "only body", None, "only body"),
        ("T", "s" * 900, None, "T T — " + "s" * 800),
        ("T", " ", "c" * 500, "T T — " + "c" * 400),
    ]
    df = spark.createDataFrame(rows, "t string, s string, c string, want string")
    got = df.select("want", text.searchable_text(F.col("t"), F.col("s"), F.col("c")).alias("got"))
    assert all(row.want == row.got for row in got.collect())


def test_quoted_follows_python(spark):
    values = ["plain", "it's", 'say "x"', "it's \"x\"", "a\\b", "line\nbreak\tand\rmore", ""]
    assert column(spark, values, text.quoted) == [repr(v) for v in values]


def test_analyse(spark):
    got = column(spark, ["Élan d'été — foo_bar 3.14 U.S.A.", "!!!"], text.analyse)
    assert got == [["élan", "d'été", "foo_bar", "3.14", "u.s.a"], []]


# Scripts without spaces, signs with marks, half-width signs, ideographs beyond 16 bits, long words.
SCRIPTS = {
    "東京タワー": ["東", "京", "タワー"],
    "ひらがな abcカナ123": ["ひ", "ら", "が", "な", "abc", "カナ", "123"],
    "か\u3099 か": ["か\u3099", "か"],
    "ﾊﾟｰﾃｨｰ 𠀀𠀁x": ["ﾊﾟｰﾃｨｰ", "𠀀", "𠀁", "x"],
    "한국어 русский ภาษาไทย": ["한국어", "русский", "ภาษาไทย"],
    "x" * 600 + " y": ["x" * 255, "x" * 255, "x" * 90, "y"],
    "𝒳" + "é" * 255: ["𝒳" + "é" * 254, "é"],
    "a" * 255: ["a" * 255],
    "": [],
}


def test_terms_of_scripts_without_spaces(spark):
    import duckdb

    from tidemark.plans.oracle_search import terms

    values = list(SCRIPTS)
    assert column(spark, values, text.analyse) == list(SCRIPTS.values())
    table = duckdb.connect()
    found = [table.execute(f"SELECT {terms('x')} FROM (SELECT ?::VARCHAR AS x) v", [value]).fetchone()[0] for value in values]
    assert found == list(SCRIPTS.values())


def test_hash_embedding_against_plain_computation(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in range(60)]
    got = column(spark, texts, lambda v: vectors.hash_embedding(v, 64))
    for value, vector in zip(texts, got, strict=True):
        want = [0.0] * 64
        for token in value.lower().split():
            want[int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "little") % 64] += 1
        norm = math.sqrt(sum(v * v for v in want)) or 1.0
        assert len(vector) == 64
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(vector, want, strict=True))


def test_run_lengths(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "v array<string>")
    got = [row[0] for row in df.select(text.run_lengths(F.col("v"), "x", "n")).collect()]
    assert [tuple(r) for r in got[0]] == [("a", 1), ("b", 3), ("c", 1)]
    assert got[1] is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    row = df.select(
        vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("z")
    ).first()
    assert abs(row.c - math.sqrt(0.5)) < 1e-12 and row.z is None
