"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, dedup, divergence, licenses, packing, quality, rules, simhash, spelling, topk, urls, warc
from tidemark.llm.common import table

URL_RULES = [
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
]

# The one tool of the conversations' view.
TOOLS = {
    "reply": [
        chat.Field("after", "object", required=False),
        chat.Field("chars", "integer", maximum=1200),
        chat.Field("turn", "integer"),
    ]
}


def op1_packing(spark, sf_dir) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), bpe.tokenizer_path(), payload="ids_crc32")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_url_filter(spark, sf_dir) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("url", "score")


def op3_quality(spark, sf_dir) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark, sf_dir) -> DataFrame:
    archives = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(archives, payloads=False).drop("url")


def op5_bpe(spark, sf_dir) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.tokenizer_path())


def op6_suffix_dedup(spark, sf_dir) -> DataFrame:
    return dedup.digests(table(spark, sf_dir, "documents"))


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as the conversations show them: every assistant's turn calls ``reply``
    and names the assistant's turn before it; the next turn of the user is its result."""
    identifier = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    rows = conversations.select("conv_id", "turn", "role", "text")
    assistant = rows.where("role = 'assistant'")
    earlier = assistant.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("has"))
    assistant = assistant.join(earlier, ["conv_id", "turn"], "left")
    after = F.when(F.col("has"), F.concat(F.lit(',"after":{"$ref": "'), identifier(F.col("turn") - 2), F.lit('"}'))).otherwise("")
    arguments = F.concat(
        F.lit('{"turn":'), F.col("turn").cast("string"), after, F.lit(', "chars":'), F.length("text").cast("string"), F.lit("}")
    )
    calls = assistant.select(
        "conv_id", "turn", identifier(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments")
    )
    results = rows.where("role = 'user'").select(
        "conv_id", "turn", identifier(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def op7_chat_format(spark, sf_dir) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    calls, results = conversation_calls(conversations)
    return chat.formatted(conversations, calls, results, TOOLS)


def op8_simhash(spark, sf_dir) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op10_topk(spark, sf_dir) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_spelling(spark, sf_dir) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_divergence(spark, sf_dir) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_licenses(spark, sf_dir) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = [
        op1_packing, op2_url_filter, op3_quality, op4_warc, op5_bpe, op6_suffix_dedup, op7_chat_format,
        op8_simhash, op9_quality_rules, op10_topk, op11_spelling, op12_divergence, op13_licenses, pipeline,
    ]
    return {query.__name__: query for query in found}


WORD = "[^\\x20\\x09-\\x0D]+"

OP4_SQL = """
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), firsts AS (
    SELECT hex, min(page_id) AS first_id FROM rows GROUP BY hex
), bits AS (
    SELECT hex, array_to_string(list_transform(range(1, 41), lambda i: substr(
        '0000000100100011010001010110011110001001101010111100110111101111',
        4 * (instr('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), '') AS b FROM firsts
), names AS (
    SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST(16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
        + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
        + CAST(substr(b, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest FROM bits
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM rows JOIN firsts USING (hex) JOIN names USING (hex)
"""

OP7_SQL = """
WITH assistant AS (
    SELECT a.conv_id, a.turn, length(a.text) AS chars, b.turn IS NOT NULL AS has
    FROM conversations a LEFT JOIN conversations b
        ON a.conv_id = b.conv_id AND b.role = 'assistant' AND b.turn = a.turn - 2
    WHERE a.role = 'assistant'
), calls AS (
    SELECT conv_id, turn, 'call_' || turn AS call_id, chars,
        '{' || CASE WHEN has THEN '"after":{"$ref":"call_' || (turn - 2) || '"},' ELSE '' END
        || '"chars":' || chars || ',"turn":' || turn || '}' AS arguments,
        row_number() OVER (PARTITION BY conv_id, turn - 2 * run ORDER BY turn) - 1 AS level
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM assistant)
), results AS (
    SELECT conv_id, turn AS result_turn, 'call_' || (turn - 1) AS call_id, text AS result
    FROM conversations WHERE role = 'user'
), tied AS (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.result_turn) AS turn, c.level,
        coalesce(c.call_id, r.call_id) AS call_id, c.arguments, r.result, c.conv_id IS NULL AS orphan,
        c.chars > 1200 AS big, r.conv_id IS NULL AS open
    FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
)
SELECT conv_id, turn, -1 AS level, NULL AS call_id, 'message' AS kind,
    '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"' || role || '","turn":' || turn || '}' AS json
FROM conversations
UNION ALL
SELECT conv_id, turn, CAST(level AS INT), call_id, 'call',
    '{"arguments":' || coalesce(CAST(to_json(arguments) AS VARCHAR), 'null') || ',"id":"' || call_id || '","errors":'
    || CASE WHEN big THEN '["chars: above 1200"]' ELSE '[]' END
    || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"result":'
    || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"'
    || CASE WHEN orphan THEN 'orphan' WHEN big THEN 'invalid' WHEN open THEN 'unanswered' ELSE 'linked' END
    || '","tool":' || CASE WHEN orphan THEN 'null' ELSE '"reply"' END || '}'
FROM tied
"""

OP9_SQL = f"""
WITH words AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3
), shingles AS (
    SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS s FROM windows
), twice AS (
    SELECT doc_id, s FROM shingles GROUP BY doc_id, s HAVING count(*) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM shingles JOIN twice USING (doc_id, s)
    ) GROUP BY doc_id
), lines AS (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM words
), measured AS (
    SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), failed AS (
    SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM measured
), hosts AS (
    SELECT source, count(*) AS docs, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS failures FROM failed GROUP BY source
), moments AS (
    SELECT greatest(least(avg(failures / docs), 1 - 1e-6), 1e-6) AS mean, var_pop(failures / docs) AS spread, avg(1.0 / docs) AS inverse
    FROM hosts
), prior AS (
    SELECT mean, least(greatest(mean * (1 - mean) / greatest((spread - mean * (1 - mean) * inverse)
        / greatest(1 - inverse, 1e-9), 1e-6 * mean * (1 - mean)) - 1, 1.0), 1000.0) AS strength FROM moments
), verdicts AS (
    SELECT source, (failures + mean * strength) / (docs + strength) <= {rules.HOST_LIMIT} AS host_kept FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM failed LEFT JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""

OP10_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), docs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, regexp_extract_all({LOWERED}, '[a-z\\x{{C0}}-\\x{{FF}}]+') AS runs FROM documents
), runs AS (
    SELECT id, run, count(*) AS n FROM (SELECT id, unnest(runs) AS run FROM docs) GROUP BY id, run HAVING length(run) >= {spelling.LEAST_LETTERS}
), sums AS (
    SELECT id, run, n, xor(list_reduce(list_prepend(4294967295, list_concat(
        list_transform(string_split(id || ':', ''), lambda c: CAST(ord(c) AS BIGINT)),
        flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END)))),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM runs, steps
), words AS (
    SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums
), vocabulary AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words
    WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}
), shorter AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
    SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, v.word, v.n FROM shorter a JOIN vocabulary v ON a.rest = v.word
    UNION SELECT v.word, a.word, a.n FROM shorter a JOIN vocabulary v ON a.rest = v.word
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS best_n, arg_max(other, (n, -place)) AS best
    FROM (SELECT *, row_number() OVER (ORDER BY other) AS place FROM near) GROUP BY word
), formed AS (
    SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {spelling.TIMES} * v.n THEN best END AS form,
        CASE WHEN best_n >= {spelling.TIMES} * v.n THEN best_n END AS form_n
    FROM vocabulary v LEFT JOIN best USING (word)
), chains(word, root) AS (
    SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chains c USING (word) JOIN formed e ON c.root = e.word AND e.form IS NULL
"""

OP12_SQL = f"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs
    FROM (SELECT lang, source, doc, unnest(terms) AS term FROM (SELECT *, row_number() OVER () AS doc FROM docs)) GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS total FROM counts GROUP BY lang, term HAVING sum(docs) >= {divergence.LEAST_DOCS}
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang
), filled AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total, v, lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
    SELECT lang, source, term, n, CAST(1 + (CAST({divergence.SCALE} AS HUGEINT) * (n + 5)) // CAST(own + 5 * v AS HUGEINT) AS BIGINT) AS p,
        CAST(1 + (CAST({divergence.SCALE} AS HUGEINT) * (total + 5)) // CAST(lang_n + 5 * v AS HUGEINT) AS BIGINT) AS q
    FROM filled
), differences AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN differences d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranks AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranks WHERE part = 'pair' OR rank <= {divergence.RANKS}
"""


def _values(pairs) -> str:
    return ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in pairs)


OP13_SQL = f"""
WITH phrases(label, p) AS (VALUES {_values(licenses.PHRASES)}), templates(label, t) AS (VALUES {_values(licenses.TEMPLATES)}),
docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), starts AS (
    SELECT row, w, unnest(range(0, len(w))) AS i FROM docs
), stands AS (
    SELECT row, label, i FROM starts JOIN phrases ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p
), base AS (
    SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM stands GROUP BY row
), blocks AS (
    SELECT row, list_distinct(w[i + 1 : i + {2 * licenses.STEP}]) AS b FROM starts WHERE i % {licenses.STEP} = 0
), held AS (
    SELECT row, label, len(list_intersect(b, t)) AS common, len(list_distinct(t)) AS size FROM blocks, templates
), met AS (
    SELECT row, label, common / size AS share FROM held WHERE 5 * common >= 4 * size
), named AS (
    SELECT row, list(DISTINCT label) AS labels, list(DISTINCT label) FILTER (WHERE base) AS base_labels
    FROM (SELECT row, label, true AS base FROM stands UNION ALL SELECT row, label, false FROM met) GROUP BY row
), best AS (
    SELECT row, max(share) AS best FROM met GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels, coalesce(array_to_string(list_sort(labels), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (row) LEFT JOIN named USING (row) LEFT JOIN best USING (row)
"""


def oracle_sql():
    return {
        "op4_warc": OP4_SQL,
        "op7_chat_format": OP7_SQL,
        "op9_quality_rules": OP9_SQL,
        "op10_topk": OP10_SQL,
        "op11_spelling": OP11_SQL,
        "op12_divergence": OP12_SQL,
        "op13_licenses": OP13_SQL,
    }
