"""Checking SQL for the change-feed half: firehose, changelog, state, live feed, metrics."""

from __future__ import annotations

from tidemark.plans import fixtures as fx

NUMERIC = "('BIGINT','UBIGINT','DOUBLE','HUGEINT')"


def jt(path: str, j: str = "j") -> str:
    return f"json_type({j}, '{path}')"


def js(path: str, j: str = "j") -> str:
    return f"json_extract_string({j}, '{path}')"


def truthy(path: str, j: str = "j") -> str:
    return (
        f"coalesce(CASE WHEN {jt(path, j)} = 'VARCHAR' THEN {js(path, j)} <> '' "
        f"WHEN {jt(path, j)} = 'BOOLEAN' THEN {js(path, j)} = 'true' "
        f"WHEN {jt(path, j)} IN {NUMERIC} THEN CAST({js(path, j)} AS DOUBLE) <> 0 "
        f"WHEN {jt(path, j)} IN ('ARRAY','OBJECT') THEN {js(path, j)} NOT IN ('[]','{{}}') "
        "ELSE false END, false)"
    )


def opt_text(path: str, j: str = "j") -> str:
    return f"CASE WHEN {jt(path, j)} = 'VARCHAR' THEN {js(path, j)} END"


def bad_opt_text(path: str, j: str = "j") -> str:
    return f"coalesce({jt(path, j)} NOT IN ('NULL','VARCHAR'), false)"


def whole_or(path: str, default: int, j: str = "j") -> str:
    return (
        f"CASE WHEN NOT {truthy(path, j)} THEN {default} "
        f"WHEN {jt(path, j)} IN {NUMERIC} THEN CAST(trunc(CAST({js(path, j)} AS DECIMAL(28,6))) AS BIGINT) "
        f"WHEN {jt(path, j)} = 'BOOLEAN' THEN 1 "
        f"WHEN {jt(path, j)} = 'VARCHAR' THEN TRY_CAST({js(path, j)} AS BIGINT) END"
    )


def opt_whole(path: str, j: str = "j") -> str:
    number = f"CAST({js(path, j)} AS DECIMAL(28,6))"
    return (
        f"CASE WHEN {jt(path, j)} IN {NUMERIC} THEN CASE WHEN {number} = trunc({number}) "
        f"THEN CAST({number} AS INTEGER) END "
        f"WHEN {jt(path, j)} = 'BOOLEAN' THEN CASE WHEN {js(path, j)} = 'true' THEN 1 ELSE 0 END "
        f"WHEN {jt(path, j)} = 'VARCHAR' THEN TRY_CAST({js(path, j)} AS INTEGER) END"
    )


def bad_opt_whole(path: str, j: str = "j") -> str:
    return f"(coalesce({jt(path, j)}, 'NULL') <> 'NULL' AND ({opt_whole(path, j)}) IS NULL)"


def flag(path: str, j: str = "j") -> str:
    return (
        f"coalesce(CASE WHEN {jt(path, j)} = 'BOOLEAN' THEN {js(path, j)} = 'true' "
        f"WHEN {jt(path, j)} IN {NUMERIC} THEN CAST({js(path, j)} AS DOUBLE) <> 0 "
        f"WHEN {jt(path, j)} = 'VARCHAR' THEN lower({js(path, j)}) IN ('1','true','t','yes') END, false)"
    )


def iso_micros(text: str) -> str:
    return f"epoch_us(TRY_CAST(replace({text}, 'Z', '') AS TIMESTAMP))"


def recent_classified() -> str:
    return f"""
        SELECT seq, arrived_us,
          CASE WHEN coalesce(value, '') = '' THEN 'empty'
               WHEN j IS NULL THEN 'malformed'
               WHEN json_type(j) <> 'OBJECT' THEN 'not an object'
               WHEN coalesce({js('$.type')} NOT IN ('edit','new','categorize','log'), true) THEN 'type'
               WHEN NOT {truthy('$.title')} THEN 'no title'
               WHEN {jt('$.title')} <> 'VARCHAR' THEN 'invalid' END AS drop_reason,
          coalesce({js('$.wiki')}, '') AS wiki, {js('$.title')} AS title,
          coalesce(nullif({js('$.meta.uri')}, ''), {js('$.title_url')}) AS title_url,
          nullif({js('$.comment')}, '') AS last_comment, nullif({js('$.user')}, '') AS last_user,
          {js('$.type')} AS event_type, CAST({whole_or('$.namespace', 0)} AS INTEGER) AS namespace,
          {truthy('$.bot')} AS is_bot, {truthy('$.minor')} AS is_minor,
          {opt_whole('$.length.new')} AS length_new,
          coalesce(CASE WHEN {jt('$.timestamp')} IN {NUMERIC}
                        THEN CAST({js('$.timestamp')} AS BIGINT) * 1000000 END,
                   {iso_micros(js('$.meta.dt'))}, arrived_us) AS event_us
        FROM (SELECT seq, arrived_us, value, CASE WHEN json_valid(value) THEN value END AS j
              FROM ({fx.cte(fx.recent_raw)}) r0) r1"""


EDIT_COLS = (
    "seq, wiki, title, title_url, last_comment, last_user, event_type, namespace, is_bot, "
    "is_minor, length_new, event_us"
)


def recent_changes() -> str:
    return f"SELECT {EDIT_COLS} FROM ({recent_classified()}) c WHERE drop_reason IS NULL"


def repo_classified() -> str:
    return f"""
        SELECT seq, {js('$.id')} AS event_id, 'github' AS wiki, nullif({js('$.repo.name')}, '') AS title,
          'https://github.com/' || nullif({js('$.repo.name')}, '') AS title_url,
          {js('$.type')} AS event_type, {js('$.actor.login')} AS last_user,
          coalesce({iso_micros(js('$.created_at'))}, arrived_us) AS event_us,
          CASE WHEN NOT {truthy('$.id')} THEN 'no id'
               WHEN NOT {truthy('$.repo')} OR NOT {truthy('$.repo.name')} THEN 'no repository'
          END AS drop_reason,
          row_number() OVER (PARTITION BY {js('$.id')} ORDER BY seq) AS copy_no
        FROM (SELECT seq, arrived_us, value AS j FROM ({fx.cte(fx.repo_raw)}) r0) r1"""


def repo_events() -> str:
    return f"""SELECT seq, wiki, title, title_url, event_type, event_type AS last_comment, last_user,
        event_us FROM ({repo_classified()}) c WHERE drop_reason IS NULL AND copy_no = 1"""


def drop_reasons() -> str:
    return f"""
        SELECT 'recent_changes' AS source, drop_reason AS reason, count(*) AS events
        FROM ({recent_classified()}) a WHERE drop_reason IS NOT NULL GROUP BY 2
        UNION ALL
        SELECT 'repo_events', CASE WHEN event_id IS NOT NULL AND copy_no > 1 THEN 'repeat'
               ELSE drop_reason END, count(*)
        FROM ({repo_classified()}) b
        WHERE drop_reason IS NOT NULL OR (event_id IS NOT NULL AND copy_no > 1) GROUP BY 2"""


def _keyed_edits() -> str:
    return f"""
        SELECT *, lower(strip_accents(rtrim(wiki))) AS wk,
               lower(strip_accents(rtrim(substr(title, 1, 191)))) AS tk
        FROM (SELECT seq, arrived_us, wiki, substr(title, 1, 512) AS title, title_url,
                     nullif(substr(last_comment, 1, 2000), '') AS last_comment, last_user,
                     event_type, namespace, is_bot, is_minor, length_new, event_us
              FROM ({recent_classified()}) c WHERE drop_reason IS NULL) e"""


PAGE_COLS = """wiki, title, title_url, last_comment, last_user, event_type, namespace, is_bot,
        is_minor, length_new, edit_count, first_seen_us, event_us"""


def edit_fold() -> str:
    return f"""
        WITH e AS ({_keyed_edits()}),
        f AS (SELECT wk, tk, wiki, title, namespace, event_us AS first_seen_us FROM e
              QUALIFY row_number() OVER (PARTITION BY wk, tk ORDER BY seq) = 1),
        l AS (SELECT wk, tk, title_url, last_comment, last_user, event_type, is_bot, is_minor,
                     length_new, event_us, count(*) OVER (PARTITION BY wk, tk) AS edit_count
              FROM e QUALIFY row_number() OVER (PARTITION BY wk, tk ORDER BY seq DESC) = 1)
        SELECT {PAGE_COLS} FROM f JOIN l USING (wk, tk)"""


def derive_changelog() -> str:
    return f"""
        WITH e AS ({_keyed_edits()}),
        n AS (SELECT *, row_number() OVER w AS no, first_value(title) OVER w AS first_title,
                     first_value(namespace) OVER w AS first_ns,
                     first_value(event_us) OVER w AS first_us,
                     lag(last_comment) OVER w AS b_comment, lag(last_user) OVER w AS b_user,
                     lag(event_us) OVER w AS b_us, lag(length_new) OVER w AS b_len
              FROM e WINDOW w AS (PARTITION BY wk, tk ORDER BY seq))
        SELECT seq, CASE WHEN no = 1 THEN 'c' ELSE 'u' END AS op, arrived_us // 1000 AS ts_ms,
               first_title AS title, first_ns AS namespace, first_us AS first_seen_us,
               no AS edit_count, last_comment, last_user, event_us, length_new,
               CASE WHEN no > 1 THEN first_title END AS before_title,
               CASE WHEN no > 1 THEN no - 1 END AS before_edit_count,
               b_comment AS before_comment, b_user AS before_user, b_us AS before_event_us,
               b_len AS before_length FROM n"""


def parsed_changelog() -> str:
    """Messages with ``error`` and document fields; tombstones and nulls left out."""
    return f"""
        SELECT seq, key, value, op, error, id, wiki, title, title_url, last_comment, last_user,
               event_type, namespace, is_bot, is_minor, length_new, edit_count, event_us, version,
               op = 'd' AS deleted
        FROM (SELECT *, CASE
                WHEN m IS NULL THEN 'parse: invalid JSON'
                WHEN json_type(c) <> 'OBJECT' THEN 'parse: change is not an object'
                WHEN op IS NULL OR op NOT IN ('c','u','r','d') THEN 'parse: unsupported op'
                WHEN version IS NULL THEN 'parse: invalid ts_ms'
                WHEN r IS NULL OR json_type(r) = 'NULL' OR CAST(r AS VARCHAR) = '{{}}' THEN 'parse: missing row image'
                WHEN json_type(r) <> 'OBJECT' THEN 'parse: row image is not an object'
                WHEN coalesce({jt('$.id', 'r')}, 'NULL') = 'NULL' OR id = 'None' THEN 'parse: missing row id'
                WHEN bad THEN 'parse: invalid field' END AS error
          FROM (SELECT *,
              {js('$.id', 'r')} AS id,
              coalesce({opt_text('$.wiki', 'r')}, '') AS wiki,
              coalesce({opt_text('$.title', 'r')}, '') AS title,
              {opt_text('$.title_url', 'r')} AS title_url,
              {opt_text('$.last_comment', 'r')} AS last_comment,
              {opt_text('$.last_user', 'r')} AS last_user,
              {opt_text('$.event_type', 'r')} AS event_type,
              {whole_or('$.namespace', 0, 'r')} AS namespace,
              {flag('$.is_bot', 'r')} AS is_bot, {flag('$.is_minor', 'r')} AS is_minor,
              {opt_whole('$.length_new', 'r')} AS length_new,
              {whole_or('$.edit_count', 1, 'r')} AS edit_count,
              CASE WHEN {jt('$.event_time', 'r')} IN {NUMERIC} THEN
                     CASE WHEN CAST({js('$.event_time', 'r')} AS DOUBLE) > 1e14 THEN CAST({js('$.event_time', 'r')} AS BIGINT)
                          WHEN CAST({js('$.event_time', 'r')} AS DOUBLE) > 1e11 THEN CAST({js('$.event_time', 'r')} AS BIGINT) * 1000
                          ELSE CAST({js('$.event_time', 'r')} AS BIGINT) * 1000000 END
                   WHEN {jt('$.event_time', 'r')} = 'VARCHAR' THEN {iso_micros(js('$.event_time', 'r'))} END AS event_us,
              (({jt('$.wiki', 'r')} <> 'VARCHAR' AND {truthy('$.wiki', 'r')})
               OR ({jt('$.title', 'r')} <> 'VARCHAR' AND {truthy('$.title', 'r')})
               OR {bad_opt_text('$.title_url', 'r')} OR {bad_opt_text('$.last_comment', 'r')}
               OR {bad_opt_text('$.last_user', 'r')} OR {bad_opt_text('$.event_type', 'r')}
               OR ({whole_or('$.namespace', 0, 'r')}) IS NULL OR ({whole_or('$.edit_count', 1, 'r')}) IS NULL
               OR {bad_opt_whole('$.length_new', 'r')}) AS bad
            FROM (SELECT *, {opt_text('$.op', 'c')} AS op, {whole_or('$.ts_ms', 0, 'c')} AS version,
                         CASE WHEN {js('$.op', 'c')} = 'd' THEN json_extract(c, '$.before')
                              ELSE json_extract(c, '$.after') END AS r
                  FROM (SELECT *, CASE WHEN json_type(m) = 'OBJECT' AND {jt('$.payload', 'm')} IS NOT NULL
                                        AND {jt('$.op', 'm')} IS NULL
                                   THEN json_extract(m, '$.payload') ELSE m END AS c
                        FROM (SELECT seq, key, value, CAST(CASE WHEN json_valid(value) THEN value END AS JSON) AS m
                              FROM ({fx.cte(fx.changelog)}) x0 WHERE value IS NOT NULL) x1) x2
                  WHERE m IS NULL OR json_type(c) <> 'NULL') x3) x4) x5"""


DOC_COLS = """id, wiki, title, title_url, last_comment, last_user, event_type, namespace, is_bot,
        is_minor, length_new, edit_count, event_us, version, deleted"""


def changelog_parse() -> str:
    return f"SELECT seq, op, {DOC_COLS} FROM ({parsed_changelog()}) p WHERE error IS NULL"


def dead_letters() -> str:
    return f"""SELECT seq, key, error, value AS raw,
        json_valid(value) AS decoded FROM ({parsed_changelog()}) p WHERE error IS NOT NULL"""


def index_state() -> str:
    return f"""
        WITH p AS (SELECT * FROM ({parsed_changelog()}) q WHERE error IS NULL),
        m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, seq DESC) AS no FROM p)
        SELECT seq, {DOC_COLS} FROM m WHERE no = 1"""


def live_docs() -> str:
    return f"SELECT * FROM ({index_state()}) s WHERE NOT deleted"


def live_counts() -> str:
    return f"SELECT count(*) AS documents FROM ({live_docs()}) s"


def filtered_docs() -> str:
    return f"""SELECT id, wiki, namespace, title FROM ({live_docs()}) s
        WHERE wiki = 'enwiki' AND namespace = 0"""


def doc_lookup() -> str:
    return f"""SELECT id, wiki, title, version FROM ({live_docs()}) s
        WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""


def merge_report() -> str:
    """First half of the log stored, second half arriving."""
    return f"""
        WITH p AS (SELECT * FROM ({parsed_changelog()}) q WHERE error IS NULL),
        b AS (SELECT (max(event_id) + min(event_id)) // 2 AS mid FROM events),
        s AS (SELECT id, max(version) AS v FROM p, b WHERE seq <= mid GROUP BY id),
        i AS (SELECT id, max(version) AS v FROM p, b WHERE seq > mid GROUP BY id)
        SELECT count(CASE WHEN s.id IS NULL OR i.v >= s.v THEN 1 END) AS written,
               count(CASE WHEN s.id IS NOT NULL AND i.v < s.v THEN 1 END) AS skipped
        FROM i LEFT JOIN s USING (id)"""


def live_events() -> str:
    def pick(field: str) -> str:
        return f"json_extract(r, '$.{field}')"

    return f"""
        SELECT seq, {js('$.op', 'c')} AS op,
               CASE WHEN coalesce({jt('$.id', 'r')}, 'NULL') = 'NULL' THEN 'None'
                    ELSE {js('$.id', 'r')} END AS id,
               {js('$.wiki', 'r')} AS wiki, {js('$.title', 'r')} AS title,
               {js('$.title_url', 'r')} AS title_url, {js('$.last_user', 'r')} AS last_user,
               {js('$.event_type', 'r')} AS event_type, {js('$.edit_count', 'r')} AS edit_count,
               {js('$.ts_ms', 'c')} AS ts_ms
        FROM (SELECT seq, c, CASE WHEN {truthy('$.after', 'c')} THEN json_extract(c, '$.after')
                                  WHEN {truthy('$.before', 'c')} THEN json_extract(c, '$.before')
                                  ELSE CAST('{{}}' AS JSON) END AS r
              FROM (SELECT seq, CASE WHEN {jt('$.payload', 'm')} IS NOT NULL THEN json_extract(m, '$.payload')
                                     ELSE m END AS c
                    FROM (SELECT seq, CAST(value AS JSON) AS m FROM ({fx.cte(fx.changelog)}) x0
                          WHERE value IS NOT NULL AND json_valid(value)) x1
                    WHERE json_type(m) = 'OBJECT') x2
              WHERE json_type(c) = 'OBJECT') x3"""


def live_feed() -> str:
    return f"SELECT * FROM ({live_events()}) v WHERE title <> '' ORDER BY seq DESC LIMIT 60"


def counters() -> str:
    return f"""
        SELECT 'ingested' AS metric, wiki AS label, count(*) AS events FROM ({recent_changes()}) a GROUP BY 2
        UNION ALL SELECT 'consumed', op, count(*) FROM ({changelog_parse()}) b GROUP BY 2
        UNION ALL SELECT 'failed', 'parse', count(*) FROM ({dead_letters()}) c
        UNION ALL SELECT 'dead_letters', '', count(*) FROM ({dead_letters()}) d
        UNION ALL SELECT 'indexed', '', count(*) FROM ({index_state()}) e"""


SYNC_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 30, 60]


def latency_histogram() -> str:
    bounds = ", ".join(f"({b}::DOUBLE)" for b in SYNC_BOUNDS)
    return f"""
        WITH b AS (SELECT * FROM (VALUES {bounds}, ('infinity'::DOUBLE)) t(le)),
        l AS (SELECT event_type AS label, greatest(value, 0.0) AS seconds FROM events),
        g AS (SELECT DISTINCT label FROM l)
        SELECT g.label, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS DECIMAL(10,3)) AS VARCHAR) END AS le,
               (SELECT count(*) FROM l WHERE l.label = g.label AND l.seconds <= b.le) AS observations
        FROM g, b"""


def latency_histograms() -> str:
    bounds = {
        "sync": [0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 30, 60],
        "embedding": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2],
        "search": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2, 5],
    }
    rows = ", ".join(f"('{metric}', {b}::DOUBLE)" for metric, values in bounds.items() for b in [*values, "'infinity'"])
    return f"""
        WITH b AS (SELECT * FROM (VALUES {rows}) t(metric, le)),
        l AS (SELECT ['sync', 'embedding', 'search'][1 + event_id % 3] AS metric, event_type AS label,
                     greatest(value, 0.0) / 100 AS seconds FROM events),
        g AS (SELECT DISTINCT metric, label FROM l)
        SELECT metric, label, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS DECIMAL(10,3)) AS VARCHAR) END AS le,
               (SELECT count(*) FROM l WHERE l.metric = g.metric AND l.label = g.label AND l.seconds <= b.le) AS observations
        FROM g JOIN b USING (metric)"""


def summarized(rows: str, keys: str, wanted: str) -> str:
    """Quantiles over ``keys`` of the column ``seconds``, to seven binary digits of a millionth."""
    return f"""
        SELECT {keys}, quantile, (slot + ((1::BIGINT << digits) >> 1)) / 1000000.0::DOUBLE AS seconds,
               CAST(total AS BIGINT) AS observations
        FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY slot) AS cum, sum(n) OVER (PARTITION BY {keys}) AS total
              FROM (SELECT {keys}, (v >> digits) << digits AS slot, digits, count(*) AS n
                    FROM (SELECT {keys}, v, greatest(0, length(bin(v)) - 7) AS digits
                          FROM (SELECT *, CAST(floor(greatest(seconds, 0.0) * 1000000) AS BIGINT) AS v
                                FROM ({rows}) r WHERE seconds IS NOT NULL) a) b
                    GROUP BY ALL) c) d,
             (SELECT CAST(unnest([{wanted}]) AS DOUBLE) AS quantile) q
        WHERE cum >= quantile * total
        QUALIFY row_number() OVER (PARTITION BY {keys}, quantile ORDER BY slot) = 1"""


def daily_quantiles() -> str:
    rows = "SELECT event_type AS label, epoch_us(date_trunc('day', ts)) AS day_us, value AS seconds FROM events"
    return summarized(rows, "label, day_us", "0.0, 0.5, 0.95, 0.99, 1.0")


def latency_quantiles() -> str:
    bounds = ", ".join(f"({n}, {b}::DOUBLE)" for n, b in enumerate(SYNC_BOUNDS))
    return f"""
        WITH b AS (SELECT * FROM (VALUES {bounds}, ({len(SYNC_BOUNDS)}, 'infinity'::DOUBLE)) t(pos, le)),
        l AS (SELECT event_type AS label, greatest(value, 0.0) AS seconds FROM events),
        h AS (SELECT label, pos, le, count(CASE WHEN seconds <= le THEN 1 END) AS cum FROM l, b GROUP BY ALL),
        w AS (SELECT *, coalesce(lag(cum) OVER o, 0) AS below, coalesce(lag(le) OVER o, 0.0) AS lower,
                     max(cum) OVER (PARTITION BY label) AS total
              FROM h WINDOW o AS (PARTITION BY label ORDER BY pos)),
        q AS (SELECT unnest([0.5, 0.95, 0.99]) AS q),
        f AS (SELECT label, q, pos, le, cum, below, lower, total FROM w, q WHERE cum >= q * total
              QUALIFY row_number() OVER (PARTITION BY label, q ORDER BY pos) = 1)
        SELECT f.label, CAST(q AS DOUBLE) AS quantile,
               round(CASE WHEN isinf(le) THEN lower
                          ELSE lower + (le - lower) * (q * total - below) / (cum - below) END, 6) AS seconds,
               m.seconds AS median,
               (SELECT round(quantile_cont(seconds, 0.5), 6) FROM l WHERE l.label = f.label) AS exact_median
        FROM f JOIN ({summarized("SELECT label, seconds FROM l", "label", "0.5")}) m USING (label)"""


def sync_latency(moment: int) -> str:
    bounds = [3600 * n for n in (1, 6, 24, 72, 168, 336, 720)]
    values = ", ".join(f"({n}, {b}::DOUBLE)" for n, b in enumerate(bounds))
    return f"""
        WITH b AS (SELECT * FROM (VALUES {values}, ({len(bounds)}, 'infinity'::DOUBLE)) t(n, le)),
        l AS (SELECT op, greatest(0.0, ({moment} - version) / 1000.0) AS seconds
              FROM (SELECT op, version FROM ({parsed_changelog()}) p WHERE error IS NULL
                    QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, seq DESC) = 1) s
              WHERE version > 0)
        SELECT op AS label, n AS "at", count(CASE WHEN seconds <= le THEN 1 END) AS observations
        FROM l, b GROUP BY ALL"""


def rate_1m() -> str:
    return """
        SELECT event_type AS label, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS window_us,
               count(*) AS events, round(count(*) / 60.0, 6) AS per_second
        FROM events GROUP BY 1, 2"""


def rate_5m() -> str:
    return """
        SELECT event_type AS label,
               epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) - s.k * 60000000 AS window_us,
               count(*) AS events, round(count(*) / 300.0, 6) AS per_second
        FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS k) s GROUP BY 1, 2"""
