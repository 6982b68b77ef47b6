"""Checking SQL for the retrieval half: text, vectors, ranking, answers, evaluation."""

from __future__ import annotations

from tidemark.plans import fixtures as fx

WS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
TERM = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"
ALONE = r"([\p{Han}\p{Hiragana}]\p{M}*|[\p{Katakana}\x{30fc}\x{ff70}][\p{Katakana}\x{30fc}\x{ff70}\x{ff9e}\x{ff9f}\p{M}]*)"
NOISE = [
    "(?i)use american english", "(?i)use british english", r"(?i)\[\[mos:", "(?i)added .+ template",
    "(?i)categor(?:y|ies) added", r"^/\*.*\*/$", r"(?i)^revert(?:ed|ing)?(?:$|[^\p{L}\p{N}_])",
    r"(?i)^undid revision(?:$|[^\p{L}\p{N}_])",
]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def clean(x: str) -> str:
    noisy = " OR ".join(f"regexp_matches({squeeze(x)}, '{p}')" for p in NOISE)
    return f"CASE WHEN {noisy} THEN '' ELSE {squeeze(x)} END"


def terms(x: str) -> str:
    spaced = f"regexp_replace(lower(coalesce({x}, '')), '{ALONE}', ' \\1 ', 'g')"
    return f"""flatten(list_transform(regexp_extract_all({spaced}, '{TERM}'), lambda t: list_transform(
        range(0, (length(t) + 254) // 255), lambda i: substr(t, CAST(255 * i + 1 AS BIGINT), 255))))"""


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def searchable(title: str, summary: str, comment: str) -> str:
    body = (
        f"coalesce(substr(nullif({squeeze(summary)}, ''), 1, 800), "
        f"substr(nullif({clean(comment)}, ''), 1, 400))"
    )
    head = f"CASE WHEN {strip(title)} <> '' THEN {strip(title)} || ' ' || {strip(title)} END"
    return strip(f"concat_ws(' — ', {head}, {body})")


def slot(token: str, dims: int = 384) -> str:
    m = f"md5({token})"
    swapped = f"substr({m}, 7, 2) || substr({m}, 5, 2) || substr({m}, 3, 2) || substr({m}, 1, 2)"
    return f"CAST('0x' || {swapped} AS BIGINT) % {dims}"


DOC_LIST = """id, wiki, title, title_url, last_comment, summary, last_user, event_type, namespace,
    is_bot, is_minor, length_new, edit_count, event_us, version, deleted"""


def single_byte(x: str) -> str:
    """The checking engine measures distance in bytes; every accented letter of the given
    texts is mapped to one capital, which lower-cased terms never contain."""
    return f"translate({x}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


def docs_cte(docs_sql: str | None = None) -> str:
    """``d``: documents in source form; token, length and statistics tables after it."""
    return f"""
    d0 AS ({docs_sql or fx.cte(fx.docs)}),
    d AS (SELECT * REPLACE (nullif({clean('last_comment')}, '') AS last_comment) FROM d0),
    toks AS (SELECT id, 't' AS field, {terms('title')} AS ts FROM d UNION ALL
             SELECT id, 's', {terms('summary')} FROM d UNION ALL
             SELECT id, 'c', {terms('last_comment')} FROM d),
    lens AS (SELECT id, field, len(ts) AS length FROM toks WHERE len(ts) > 0),
    stats AS (SELECT field, count(*) AS documents, sum(length) AS total_length FROM lens GROUP BY field),
    post AS (SELECT id, field, term, count(*) AS tf
             FROM (SELECT id, field, unnest(ts) AS term FROM toks) u GROUP BY ALL),
    dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL)"""


def vectors_cte(name: str, source: str, key: str, text: str) -> str:
    """Sparse unit vectors ``(key, slot, v)`` rounded to single precision."""
    return f"""
    {name}_n AS (SELECT {key}, {slot('token')} AS slot, count(*) AS n
                 FROM (SELECT {key}, unnest({words(f'lower({text})')}) AS token FROM {source}) x GROUP BY ALL),
    {name} AS (SELECT {key}, slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS v
               FROM {name}_n)"""


def search_ctes(queries_sql: str) -> str:
    """Everything from ``q`` (admitted queries) to ``hits``."""
    return docs_cte() + f""",
    q AS (SELECT query_id, query, mode, least(greatest(size, 1), 50) AS size, wiki,
                 CASE WHEN namespace >= 0 THEN namespace END AS namespace
          FROM ({queries_sql}) q0 WHERE {strip('query')} <> ''),
    qa AS (SELECT *, {terms('query')} AS qts, len({words('query')}) AS n_words FROM q),
    qb AS (SELECT *, n_words <= 2 AS fuzzy,
                  CASE WHEN n_words <= 2 THEN 1 WHEN n_words <= 4 THEN len(qts)
                       ELSE greatest(1, (len(qts) * 3) // 5) END AS needed
           FROM qa WHERE len(qts) > 0 AND mode IN ('hybrid', 'bm25')),
    qt AS (SELECT query_id, fuzzy, unnest(qts) AS q_term FROM qb),
    sp0 AS (SELECT q_term, field, term, df, damerau_levenshtein({single_byte('q_term')}, {single_byte('term')}) AS edits
            FROM (SELECT DISTINCT q_term FROM qt WHERE fuzzy) f JOIN dfs
              ON abs(length(q_term) - length(term)) <= 2),
    sp1 AS (SELECT *, 1.0::DOUBLE - edits::DOUBLE / least(length(q_term), length(term)) AS weight FROM sp0
            WHERE edits <= CASE WHEN length(q_term) < 3 THEN 0 WHEN length(q_term) <= 5 THEN 1 ELSE 2 END),
    sp2 AS (SELECT * FROM sp1
            QUALIFY row_number() OVER (PARTITION BY q_term, field ORDER BY weight DESC, term) <= 50),
    sp AS (SELECT q_term, field, term, weight, max(df) OVER (PARTITION BY q_term, field) AS df FROM sp2),
    ent AS (SELECT query_id, field, term, df, 1.0::DOUBLE AS weight FROM qt JOIN dfs ON q_term = term WHERE NOT fuzzy
            UNION ALL SELECT query_id, field, term, df, weight FROM qt JOIN sp USING (q_term) WHERE fuzzy),
    entw AS (SELECT query_id, field, term,
                    (CASE field WHEN 't' THEN 4.0 WHEN 's' THEN 2.0 ELSE 1.0 END)::DOUBLE
                    * ln(1 + (documents - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * weight * 2.2::DOUBLE AS w
             FROM ent JOIN stats USING (field)),
    norms AS (SELECT id, field, 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (total_length / documents)) AS norm
              FROM lens JOIN stats USING (field)),
    fs AS (SELECT query_id, id, field, count(*) AS matched,
                  CAST(sum(CAST(round(w * (tf / (tf + norm)) * 1e9) AS BIGINT)) AS BIGINT) AS units
           FROM entw JOIN post USING (field, term) JOIN norms USING (id, field) GROUP BY ALL),
    best AS (SELECT query_id, id, max(units) AS units FROM fs JOIN qb USING (query_id)
             WHERE matched >= needed GROUP BY ALL),
    pw AS (SELECT query_id, 8.0::DOUBLE * sum(CAST(round(ln(1 + ((SELECT documents FROM stats WHERE field = 't') - df + 0.5::DOUBLE)
                  / (df + 0.5::DOUBLE)) * 1e9) AS BIGINT)) / 1e9 * 2.2::DOUBLE AS phrase_w
           FROM qt JOIN dfs ON q_term = term AND field = 't' GROUP BY query_id),
    pf AS (SELECT query_id, id, len(list_filter(range(1, len(ts) - len(qts) + 2),
                  lambda i: list_slice(ts, i, i + len(qts) - 1) = qts)) AS freq
           FROM best JOIN qb USING (query_id) JOIN (SELECT id, ts FROM toks WHERE field = 't') tt USING (id)),
    bm AS (SELECT b.query_id, b.id, b.units + coalesce(CASE WHEN freq > 0
                  THEN CAST(round(phrase_w * (freq / (freq + norm)) * 1e9) AS BIGINT) END, 0) AS units
           FROM best b JOIN pf USING (query_id, id) LEFT JOIN pw USING (query_id)
           LEFT JOIN (SELECT id, norm FROM norms WHERE field = 't') n ON n.id = b.id
           JOIN d ON d.id = b.id JOIN q ON q.query_id = b.query_id
           WHERE NOT coalesce(d.deleted, false) AND (q.wiki IS NULL OR q.wiki = d.wiki)
             AND (q.namespace IS NULL OR q.namespace = d.namespace)),
    bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, id) AS rank FROM bm
            QUALIFY rank <= 50),
    dtext AS (SELECT id, {searchable('title', 'summary', 'last_comment')} AS text FROM d
              WHERE NOT coalesce(deleted, false)),
    qtext AS (SELECT query_id, query FROM q WHERE mode IN ('hybrid', 'vector')),
    {vectors_cte('dv', 'dtext', 'id', 'text')},
    {vectors_cte('qv', 'qtext', 'query_id', 'query')},
    dn AS (SELECT id, sqrt(sum(v * v)) AS norm FROM dv GROUP BY id),
    qn AS (SELECT query_id, sqrt(sum(v * v)) AS norm FROM qv GROUP BY query_id),
    dots AS (SELECT query_id, id, sum(dv.v * qv.v) AS dot FROM qv JOIN dv USING (slot) GROUP BY ALL),
    kn AS (SELECT dots.query_id, dots.id, CAST(round((dot / (dn.norm * qn.norm) + 1) / 2 * 1e9) AS BIGINT) AS units
           FROM dots JOIN dn USING (id) JOIN qn USING (query_id) JOIN d USING (id)
           JOIN q ON q.query_id = dots.query_id
           WHERE (q.wiki IS NULL OR q.wiki = d.wiki) AND (q.namespace IS NULL OR q.namespace = d.namespace)),
    knr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, id) AS rank FROM kn
            WHERE units >= 720000000 QUALIFY rank <= 50),
    qw AS ({query_weights_sql('q')}),
    fu AS (SELECT coalesce(b.query_id, k.query_id) AS query_id, coalesce(b.id, k.id) AS id,
                  b.rank AS bm25_rank, k.rank AS knn_rank, coalesce(b.units, k.units) AS units
           FROM bmr b FULL JOIN knr k ON b.query_id = k.query_id AND b.id = k.id),
    sc AS (SELECT fu.*, q.size, CASE WHEN mode = 'hybrid'
                  THEN coalesce(bm25_weight / (60.0::DOUBLE + (bm25_rank - 1)), 0) + coalesce(knn_weight / (60.0::DOUBLE + (knn_rank - 1)), 0)
                  ELSE units / 1e9 END AS raw
           FROM fu JOIN q USING (query_id) JOIN qw USING (query_id)),
    hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id
                    ORDER BY raw DESC, bm25_rank NULLS LAST, knn_rank NULLS LAST) AS position, id,
                    round(raw, 6) AS score, bm25_rank, knn_rank
             FROM sc QUALIFY position <= size)"""


def query_weights_sql(source: str) -> str:
    return f"""SELECT query_id,
        CASE WHEN title_like THEN 1.15::DOUBLE * 1.25 WHEN n >= 6 THEN 1.15::DOUBLE * 0.85 ELSE 1.15::DOUBLE END AS bm25_weight,
        CASE WHEN title_like THEN 0.85::DOUBLE * 0.75 WHEN n >= 6 THEN 0.85::DOUBLE * 1.2 ELSE 0.85::DOUBLE END AS knn_weight
        FROM (SELECT query_id, len(w) AS n, (s LIKE '"%' AND s LIKE '%"') OR len(w) <= 2
                     OR len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= greatest(1, len(w) // 2) AS title_like
              FROM (SELECT query_id, {strip('query')} AS s, {words('query')} AS w FROM {source}) a) b"""


HIT_COLS = "query_id, position, id, score, bm25_rank, knn_rank"


def hybrid_search() -> str:
    return f"WITH {search_ctes(fx.cte(fx.search_queries))} SELECT {HIT_COLS} FROM hits"


def bm25_search() -> str:
    """Every query through the text retriever alone."""
    return f"""WITH {search_ctes(f"SELECT * REPLACE ('bm25' AS mode) FROM ({fx.cte(fx.search_queries)}) z")}
        SELECT query_id, id, rank, units FROM bmr"""


bm25_lists = bm25_search


def knn_approx() -> str:
    """What nine of ten hits found comes to: every vector has fifty hits, or all there are."""
    return """SELECT CAST(sum(least(50, n)) AS BIGINT) AS hits, true AS recalled
        FROM (SELECT count(*) OVER () AS n FROM embeddings WHERE embedding IS NOT NULL) v"""


def knn_floor() -> str:
    return f"""WITH {search_ctes(f"SELECT * REPLACE ('vector' AS mode) FROM ({fx.cte(fx.search_queries)}) z")}
        SELECT query_id, id, rank, round(units / 1e9, 6) AS score FROM knr"""


def phrase_match() -> str:
    """Distinct title probes as phrases over all titles."""
    return f"""WITH {search_ctes(f"SELECT * FROM ({probe_queries('true')}) z WHERE mode = 'bm25'")},
        x AS (SELECT p.qts, len(list_filter(range(1, len(ts) - len(p.qts) + 2),
                     lambda i: list_slice(ts, i, i + len(p.qts) - 1) = p.qts)) AS freq
              FROM (SELECT DISTINCT qts FROM qb) p, (SELECT ts FROM toks WHERE field = 't') t)
        SELECT array_to_string(qts, ' ') AS phrase, count(*) AS titles, CAST(sum(freq) AS BIGINT) AS occurrences
        FROM x WHERE freq > 0 GROUP BY 1"""


def source_documents() -> str:
    optional = ["event_time", "last_comment", "last_user", "length_new", "summary", "title_url"]
    always = ["deleted", "edit_count", "event_type", "id", "is_bot", "is_minor", "namespace", "title", "version", "wiki"]
    source = {name: name for name in optional} | {"event_time": "event_us", "last_comment": "cleaned"}
    present = ", ".join(
        [f"CASE WHEN {source[name]} IS NOT NULL THEN '{name}' END" for name in optional]
        + [f"'{name}'" for name in always]
    )
    return f"""SELECT id, array_to_string(list_sort(list_filter([{present}], lambda x: x IS NOT NULL)), ',') AS fields,
        cleaned AS last_comment, version
        FROM (SELECT *, nullif({clean('last_comment')}, '') AS cleaned FROM ({fx.cte(fx.docs)}) d0) d"""


def fuzzy_terms() -> str:
    return f"""WITH {search_ctes(f"SELECT * REPLACE ('bm25' AS mode) FROM ({fx.cte(fx.search_queries)}) z")}
        SELECT q_term, field, term, round(weight, 6) AS weight, df FROM sp"""


def corpus_stats() -> str:
    return f"""WITH {docs_cte()}
        SELECT field, '' AS term, documents, CAST(total_length AS BIGINT) AS total FROM stats
        UNION ALL SELECT field, term, df, 0 FROM dfs"""


def postings() -> str:
    return f"""WITH {docs_cte()} SELECT id, field, term, tf, length FROM post JOIN lens USING (id, field)"""


def knn_exact() -> str:
    return """
        WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
                CAST(round((list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) + 1) / 2 * 1e9) AS BIGINT) AS units
              FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a,
                   (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b)
        SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id, rank, round(units / 1e9, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, CAST(id AS VARCHAR)) AS rank
              FROM p WHERE units >= 620000000) r WHERE rank <= 10"""


def clean_comments() -> str:
    return f"SELECT id, {clean('last_comment')} AS cleaned FROM ({fx.cte(fx.docs)}) d"


def searchable_text() -> str:
    return f"SELECT id, {searchable('title', 'summary', 'last_comment')} AS text FROM ({fx.cte(fx.docs)}) d"


def hash_embeddings() -> str:
    return f"""WITH t AS (SELECT id, {searchable('title', 'summary', 'last_comment')} AS text
          FROM ({fx.cte(fx.docs)}) d WHERE NOT deleted), {vectors_cte('v', 't', 'id', 'text')}
        SELECT id, slot, round(v, 5) AS value FROM v"""


def query_weights() -> str:
    return f"""SELECT query_id, round(bm25_weight, 6) AS bm25_weight, round(knn_weight, 6) AS knn_weight
        FROM ({query_weights_sql(f"(SELECT * FROM ({fx.cte(fx.search_queries)}) z WHERE {strip('query')} <> '')")}) w"""


def search_response() -> str:
    return f"""WITH {search_ctes(fx.cte(fx.search_queries))}
        SELECT q.query_id, q.query, q.mode, count(hits.id) AS count,
               coalesce(string_agg(hits.id, ',' ORDER BY position), '') AS ids
        FROM q LEFT JOIN hits USING (query_id) GROUP BY ALL"""


def search_counters() -> str:
    return f"""SELECT 'searches' AS metric, mode AS label, count(*) AS events
        FROM ({fx.cte(fx.search_queries)}) r WHERE {strip("query")} <> '' GROUP BY mode
        UNION ALL SELECT 'answers', CAST(grounded AS VARCHAR), count(*) FROM ({rag_answers()}) a GROUP BY grounded"""


def picked_text() -> str:
    return strip(
        "coalesce(CASE WHEN type IN ('disambiguation', 'no-extract') THEN description "
        "ELSE coalesce(nullif(extract, ''), description) END, '')"
    )


def summary_pick() -> str:
    return f"""SELECT wiki, title, type, extract, description FROM ({fx.cte(fx.summaries)}) s
        WHERE {picked_text()} <> ''
        QUALIFY row_number() OVER (PARTITION BY wiki, title ORDER BY type NULLS FIRST,
                extract NULLS FIRST, description NULLS FIRST) = 1"""


def enriched() -> str:
    picked = picked_text()
    return f"""SELECT d.id, d.version, d.wiki, d.title, nullif(substr({picked}, 1, 1000), '') AS summary
        FROM ({fx.cte(fx.docs)}) d JOIN ({summary_pick()}) s ON d.wiki = s.wiki AND d.title = s.title
        WHERE NOT d.deleted AND d.namespace = 0 AND d.title <> '' AND coalesce(d.summary, '') = ''
          AND regexp_matches(d.wiki, '^.+wiki$')
          AND NOT regexp_matches(d.title, '^(User|Talk|Wikipedia|Template|Category):')"""


def summary_enrich() -> str:
    return f"SELECT id, version, summary FROM ({enriched()}) e WHERE summary IS NOT NULL"


def enrich_guard() -> str:
    """Enriched documents written over an index in which every eighth has a newer edit."""
    return f"""SELECT d.id, CASE WHEN CAST(d.id AS BIGINT) % 8 = 4 THEN d.version + 1 ELSE d.version END AS version,
        CASE WHEN CAST(d.id AS BIGINT) % 8 = 4 OR e.summary IS NULL THEN d.summary ELSE e.summary END AS summary
        FROM ({fx.cte(fx.docs)}) d LEFT JOIN ({enriched()}) e ON d.id = e.id"""


def stream_enrich() -> str:
    """Every document, with the summary found for those that had none."""
    return f"""SELECT d.id, d.version, coalesce(e.summary, d.summary) AS summary
        FROM ({fx.cte(fx.docs)}) d LEFT JOIN ({enriched()}) e ON d.id = e.id"""


def quoted(x: str) -> str:
    body = f"replace({x}, '\\', '\\\\')"
    for raw, shown in (("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")):
        body = f"replace({body}, {raw}, '{shown}')"
    return (
        f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {body} || '\"' "
        f"ELSE '''' || replace({body}, '''', '\\''') || '''' END"
    )


QUESTION_QUERIES = f"""SELECT question_id AS query_id, question AS query, 'hybrid' AS mode, 5 AS size, wiki,
    0 AS namespace FROM ({fx.cte(fx.questions)}) qs WHERE length(question) >= 3"""

REFUSAL = (
    r"(?i)\bi don''t know\b|\bdo not know\b|\bdon''t have (?:any |enough )?indexed\b"
    r"|\bnot (?:enough|sufficient) (?:information|context)\b|\bcontext (?:does not|doesn''t|provided does not)\b"
)


def answer_ctes() -> str:
    line = (
        "'[' || position || '] title=' || " + quoted("title") + " || ' wiki=' || wiki || ' when=' || "
        "coalesce(strftime(make_timestamp(event_us), '%Y-%m-%dT%H:%M:%S+00:00'), 'unknown time') || ' user=' || "
        "coalesce(nullif(last_user, ''), 'unknown') || ' edit_summary=' || "
        + quoted("note")
        + " || CASE WHEN lead <> '' THEN ' summary=' || " + quoted("substr(lead, 1, 280)") + " ELSE '' END"
    )
    return search_ctes(QUESTION_QUERIES) + f""",
    cx AS (SELECT query_id, position, d.*,
                  coalesce(nullif({strip("coalesce(d.last_comment, '')")}, ''), '(no edit summary)') AS note,
                  {strip("coalesce(d.summary, '')")} AS lead
           FROM hits JOIN d USING (id)),
    pr AS (SELECT query_id, count(*) AS n, string_agg({line}, chr(10) ORDER BY position) AS context,
                  string_agg({line}, chr(10) ORDER BY position) FILTER (WHERE position <= 3) AS lead3
           FROM cx GROUP BY query_id),
    pm AS (SELECT q.query_id AS question_id, 'QUESTION: ' || q.query || chr(10) || chr(10) || 'CONTEXT:' || chr(10)
                  || context || chr(10) || chr(10) || 'Answer using only the context. Cite sources with [n]. '
                  || 'If you cannot answer from the context, say you don''t know.' AS prompt, n, lead3
           FROM q JOIN pr USING (query_id)),
    ex AS (SELECT question_id, n, 'Based on the most recent indexed changes: '
                  || substr(replace(lead3, chr(10), ' '), 1, 400) AS answer FROM pm)"""


def rag_prompt() -> str:
    return f"WITH {answer_ctes()} SELECT question_id, prompt FROM pm"


def extractive_answer() -> str:
    return f"WITH {answer_ctes()} SELECT question_id, answer FROM ex"


def _finalize(answers: str) -> str:
    return f"""
    an AS ({answers}),
    ct AS (SELECT DISTINCT question_id, TRY_CAST(unnest(regexp_extract_all(text, '\\[([0-9]+)\\]', 1)) AS INTEGER) AS pos
           FROM an),
    cv AS (SELECT question_id, pos, cx.id, cx.event_us FROM ct JOIN cx ON query_id = question_id AND position = pos),
    ca AS (SELECT question_id, string_agg(pos || ':' || id, ',' ORDER BY pos) AS cited, max(event_us) AS freshest_us
           FROM cv GROUP BY question_id),
    fin AS (SELECT q.query_id AS question_id, n,
               CASE WHEN n IS NULL THEN 'none' WHEN coalesce(text, '') = '' THEN 'empty'
                    WHEN regexp_matches(text, '{REFUSAL}') THEN 'refused'
                    WHEN cited IS NULL THEN 'uncited' ELSE 'grounded' END AS state, text, cited, freshest_us
            FROM q LEFT JOIN an ON an.question_id = q.query_id LEFT JOIN ca ON ca.question_id = q.query_id)
    SELECT question_id, CASE state
        WHEN 'none' THEN 'I don''t have any indexed context relevant to that question yet.'
        WHEN 'empty' THEN 'I don''t know based on the indexed changes.'
        WHEN 'uncited' THEN 'I don''t know based on the indexed changes. (Retrieved context was too weak to ground an answer.)'
        ELSE text END AS answer,
        state = 'grounded' AS grounded, CASE WHEN state = 'grounded' THEN cited ELSE '' END AS cited,
        CASE WHEN state = 'grounded' THEN freshest_us END AS freshest_us FROM fin"""


def rag_answers() -> str:
    return f"""WITH {answer_ctes()}, {_finalize(f"SELECT question_id, n, {strip('answer')} AS text FROM ex")}"""


MODEL_ANSWER = """CASE length(question) % 6 WHEN 0 THEN 'The page [2] changed, see [1] and [9].'
    WHEN 1 THEN 'Sorry, I don''t know.' WHEN 2 THEN 'It changed recently.' WHEN 3 THEN ' '
    WHEN 4 THEN 'There is not enough information [1].' END"""


def grounding() -> str:
    """Answers of a primary generator where it gave one, extractive ones elsewhere."""
    model = f"SELECT question_id, {MODEL_ANSWER} AS model FROM ({fx.cte(fx.questions)}) qs"
    answers = (
        f"SELECT ex.question_id, n, {strip('coalesce(model, answer)')} AS text "
        f"FROM ex JOIN ({model}) m USING (question_id)"
    )
    return f"WITH {answer_ctes()}, {_finalize(answers)}"


def probe_queries(site: str = "wiki = 'enwiki'") -> str:
    """Two requests per live main title: its first three words longer than two letters."""
    return f"""SELECT id || '-' || mode AS query_id, array_to_string(list_slice(list_filter(
            {words("replace(title, ':', ' ')")}, lambda w: length(w) > 2), 1, 3), ' ') AS query,
        mode, 5 AS size, wiki, 0 AS namespace, title AS expected
        FROM ({fx.cte(fx.docs)}) d, (SELECT unnest(['bm25', 'hybrid']) AS mode) m
        WHERE NOT deleted AND namespace = 0 AND {site} AND len({words('title')}) >= 2"""


def eval_titles() -> str:
    return f"""WITH p AS ({probe_queries()}), {search_ctes(probe_queries())},
        h AS (SELECT query_id, position, lower(d.title) AS title FROM hits JOIN d USING (id)),
        r AS (SELECT p.query_id, p.mode,
                coalesce(bool_or(position = 1 AND (contains(title, lower(expected)) OR contains(lower(expected), title))), false) AS hit,
                coalesce(max(CASE WHEN title = lower(expected) THEN 1.0::DOUBLE / position END), 0) AS reciprocal
              FROM p LEFT JOIN h USING (query_id) GROUP BY ALL)
        SELECT mode, count(*) AS probes, count(CASE WHEN hit THEN 1 END) AS passed,
               round(100.0 * count(CASE WHEN hit THEN 1 END) / count(*), 3) AS pass_percent,
               round(avg(reciprocal), 6) AS mean_reciprocal FROM r GROUP BY mode"""


def cases_sql() -> str:
    return f"""SELECT query_id AS case_id, query_id LIKE '%-noise' AS expect_empty,
        CASE WHEN query_id LIKE '%-quoted' THEN 0 WHEN query_id LIKE '%-two' THEN 0 END AS expect_namespace,
        CASE WHEN query_id LIKE '%-noise' OR query_id LIKE '%-blank' THEN NULL
             ELSE '(?i)' || regexp_extract(query, '[A-Za-z]+', 0) END AS title_pattern,
        CASE WHEN query_id LIKE '%-whole' THEN 1 WHEN query_id LIKE '%-eight' THEN 3 ELSE 0 END AS min_hits
        FROM ({fx.cte(fx.search_queries)}) z"""


def eval_cases() -> str:
    return f"""WITH {search_ctes(fx.cte(fx.search_queries))}, c AS ({cases_sql()}),
        h AS (SELECT query_id, d.title, d.namespace FROM hits JOIN d USING (id) WHERE position <= 5),
        a AS (SELECT case_id, expect_empty, expect_namespace, title_pattern, min_hits, count(h.query_id) AS found,
                count(CASE WHEN regexp_matches(title, '^(User|Talk):') THEN 1 END) AS forbidden,
                count(CASE WHEN h.namespace <> expect_namespace THEN 1 END) AS elsewhere,
                count(CASE WHEN regexp_matches(title, title_pattern) THEN 1 END) AS named
              FROM c LEFT JOIN h ON query_id = case_id GROUP BY ALL)
        SELECT case_id, found, CASE WHEN expect_empty THEN found = 0 AND forbidden = 0
               ELSE (expect_namespace IS NULL OR (found > 0 AND elsewhere = 0))
                AND (title_pattern IS NULL OR named > 0) AND found >= min_hits END AS ok FROM a"""


def eval_grounding() -> str:
    return f"""SELECT length(question) > 100 AS expected, count(*) AS total,
        count(CASE WHEN grounded = (length(question) > 100) THEN 1 END) AS passed
        FROM ({rag_answers()}) r JOIN ({fx.cte(fx.questions)}) qs USING (question_id) GROUP BY 1"""
