"""Input views derived from the given tables.

The given tables hold no change feed, so each view restates whole tables of them as the
input some job expects. A view is plain arithmetic and text, written once and rendered for
Spark or for the checking engine. Nothing here is an operator.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import configure, scan

TABLES = ["events", "documents", "labels", "benchmark", "conversations", "embeddings"]


@dataclass(frozen=True)
class Dialect:
    """The few spellings in which the two engines differ."""

    duck: bool

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})" if self.duck else f"unix_micros(cast({ts} as timestamp))"

    def iso(self, ts: str) -> str:
        if self.duck:
            return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"
        return f"date_format(cast({ts} as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))" if self.duck else f"(({a}) div ({b}))"

    def words(self, text: str) -> str:
        if self.duck:
            pieces = f"regexp_split_to_array({text}, '[ \\t\\n\\r\\f\\x0b]+')"
            return f"list_filter({pieces}, lambda w: w <> '')"
        return f"filter(split({text}, r'[ \\t\\n\\r\\f\\x0b]+'), w -> w <> '')"

    def first(self, arr: str, n: int) -> str:
        if self.duck:
            return f"array_to_string(list_slice({arr}, 1, {n}), ' ')"
        return f"array_join(slice({arr}, 1, {n}), ' ')"

    def after(self, arr: str, n: int) -> str:
        if self.duck:
            return f"array_to_string(list_slice({arr}, {n + 1}, len({arr})), ' ')"
        return f"array_join(slice({arr}, {n + 1}, greatest(size({arr}) - {n}, 0)), ' ')"

    def json_int(self, text: str, field: str) -> str:
        name = "json_extract_string" if self.duck else "get_json_object"
        return f"cast({name}({text}, '$.{field}') as int)"

    def text(self, value: str) -> str:
        return f"cast({value} as {'varchar' if self.duck else 'string'})"


def _pick(value: str, options: list[str]) -> str:
    """A CASE over ``value`` with the options in order; the last one is the default."""
    arms = " ".join(f"WHEN {at} THEN {option}" for at, option in enumerate(options[:-1]))
    return f"(CASE {value} {arms} ELSE {options[-1]} END)"


def recent_raw(d: Dialect) -> str:
    """Firehose lines ``(seq, arrived_us, value)``, one per event, some of them broken."""
    e = "event_id"
    uid = d.text("user_id")
    k = d.text(d.json_int("props", "k"))
    wiki = _pick("user_id % 3", ["'enwiki'", "'dewiki'", "'enwiktionary'"])
    long_tail = f"concat(' ', repeat('long ', 60), {d.text('event_id % 7')})"
    name = _pick(
        f"{e} % 4",
        [
            f"concat('Página ', {uid})", f"concat('PAGINA ', {uid})",
            f"concat('pagina ', {uid}, '  ')", f"concat('Pagina ', {uid})",
        ],
    )
    title = f"concat({name}, CASE WHEN user_id % 50 = 0 THEN {long_tail} ELSE '' END)"
    title_json = _pick(
        f"{e} % 89",
        ["""'"title":"",'""", "''", """'"title":5,'""", f"""concat('"title":"', {title}, '",')"""],
    )
    kind = (
        "(CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'new' "
        "WHEN 'signup' THEN 'categorize' WHEN 'error' THEN 'log' "
        f"ELSE CASE WHEN {e} % 3 = 0 THEN 'external' ELSE 'edit' END END)"
    )
    comment = _pick(
        f"{e} % 8",
        [
            "'\"\"'", "'null'", "'\"Use British English\"'", "'\"/* History */\"'",
            "'\"Reverted edits by X\"'", "'\"added ref template\"'",
            "'\"fixed   typo in ''x'' \"'", f"concat('\"expanded section ', {k}, '\"')",
        ],
    )
    uri = _pick(f"{e} % 3", ["'null'", "'\"\"'", f"concat('\"https://w.example/', {uid}, '\"')"])
    flag = ["'true'", "'1'", "'\"x\"'", "'null'", "'0'", "'\"\"'"]
    namespace = _pick(f"{e} % 11", ["'null'", "'\"4\"'", "'2'", "'0'"])
    length = _pick(
        f"{e} % 13", ["'null'", "'{\"new\":null}'", f"concat('{{\"new\":', {k}, '}}')"]
    )
    when = _pick(
        f"{e} % 5",
        [
            f"concat('\"meta\":{{\"uri\":', {uri}, ',\"dt\":\"', {d.iso('ts')}, '\"}}')",
            f"concat('\"meta\":{{\"uri\":', {uri}, ',\"dt\":\"soon\"}}')",
            f"concat('\"meta\":{{\"uri\":', {uri}, '}},\"timestamp\":', "
            f"{d.text(d.div(d.micros('ts'), '1000000'))})",
        ],
    )
    line = (
        f"concat('{{\"type\":\"', {kind}, '\",\"wiki\":\"', {wiki}, '\",', {title_json}, "
        f"'\"title_url\":\"https://t.example/', {uid}, '\",\"comment\":', {comment}, "
        f"',\"user\":\"user', {uid}, '\",\"namespace\":', {namespace}, "
        f"',\"bot\":', {_pick(f'{e} % 6', flag)}, ',\"minor\":', "
        f"{_pick(f'({e} + 2) % 6', flag)}, ',\"length\":', {length}, ',', {when}, '}}')"
    )
    value = _pick(f"{e} % 97", ["'{\"type\":\"edit\",'", "'[1,2]'", "''", line])
    return (
        f"SELECT {e} AS seq, {d.micros('ts')} + 1000000 AS arrived_us, {value} AS value "
        "FROM @events"
    )


def repo_raw(d: Dialect) -> str:
    """Code-hosting event lines; every tenth arrives twice."""
    e = "event_id"
    uid = d.text("user_id")
    ident = _pick(f"{e} % 19", ["'null'", f"concat('\"', {d.text(e)}, '\"')"])
    repo = _pick(
        "user_id % 20",
        ["'null'", "'{}'", f"concat('{{\"name\":\"org', {d.text('user_id % 7')}, '/r', {uid}, '\"}}')"],
    )
    actor = _pick(f"{e} % 4", ["'null'", f"concat('{{\"login\":\"dev', {uid}, '\"}}')"])
    made = _pick(f"{e} % 17", ["'\"yesterday\"'", "'null'", f"concat('\"', {d.iso('ts')}, '\"')"])
    line = (
        f"concat('{{\"id\":', {ident}, ',\"type\":\"', event_type, 'Event\",\"repo\":', {repo}, "
        f"',\"actor\":', {actor}, ',\"created_at\":', {made}, '}}')"
    )
    columns = f"{d.micros('ts')} + 1000000 AS arrived_us, {line} AS value FROM @events"
    return (
        f"SELECT {e} * 2 AS seq, {columns} UNION ALL "
        f"SELECT {e} * 2 + 1 AS seq, {columns} WHERE {e} % 10 = 0"
    )


def changelog(d: Dialect) -> str:
    """Change messages ``(seq, key, value)`` in log order, late, tied and broken ones included."""
    e = "event_id"
    uid = d.text("user_id")
    hour = "3600000"
    millis = d.div(d.micros("ts"), "1000")
    version = d.text(f"{d.div(millis, hour)} * {hour} - (({e} * 7919) % 5) * {hour}")
    op = _pick(
        f"{e} % 103",
        [
            "'\"x\"'", "'null'", "'7'",
            "(CASE event_type WHEN 'signup' THEN '\"c\"' WHEN 'view' THEN '\"r\"' "
            "WHEN 'error' THEN '\"d\"' ELSE '\"u\"' END)",
        ],
    )
    stamp = _pick(
        f"{e} % 113",
        ["'\"abc\"'", f"concat('\"', {version}, '\"')", "'null'", f"concat({version}, '.75')", version],
    )
    ident = _pick(f"{e} % 127", ["'null'", "'\"None\"'", f"concat('\"', {uid}, '\"')", uid])
    slash = "\\" if d.duck else "\\\\"
    wiki = _pick("user_id % 3", ["'\"enwiki\"'", "'\"dewiki\"'", "'\"enwiktionary\"'"])
    wiki = f"(CASE WHEN {e} % 137 = 2 THEN 'false' ELSE {wiki} END)"
    title = _pick(f"{e} % 137", ["'5'", "'null'", f"concat('\"Page ', {uid}, '\"')"])
    comment = _pick(
        f"{e} % 8",
        [
            "'\"\"'", "'null'", "'\"Use American English\"'", "'\"/* Early life */ \"'",
            "'\"Undid revision 12\"'", "'\"two categories added\"'",
            f"'\"it''s   a {slash}\"quoted{slash}\" note\"'",
            f"concat('\"copyedit ', {d.text('event_id % 50')}, '\"')",
        ],
    )
    flag = ["'true'", "'1'", "'\"yes\"'", "'\"no\"'", "'null'", "'0'", "'\"T\"'"]
    length = _pick(
        f"{e} % 131", ["'\"x\"'", "'3.5'", "'\"12\"'", "'null'", d.text(d.json_int("props", "k"))]
    )
    namespace = _pick(f"{e} % 139", ["'\"4\"'", "'null'", "'\"bad\"'", d.text("user_id % 4")])
    edits = _pick(f"{e} % 9", ["'0'", "'null'", d.text(f"{e} % 30")])
    micros = d.micros("ts")
    when = _pick(
        f"{e} % 11",
        [
            f"concat('\"', {d.iso('ts')}, '\"')", "'\"garbage\"'",
            d.text(d.div(micros, "1000000")), d.text(millis), "'null'", d.text(micros),
        ],
    )
    row = (
        f"concat('{{\"id\":', {ident}, ',\"wiki\":', {wiki}, ',\"title\":', {title}, "
        f"',\"title_url\":\"https://t.example/', {uid}, '\",\"last_comment\":', {comment}, "
        f"',\"last_user\":\"user', {d.text('event_id % 20')}, '\",\"event_type\":\"', event_type, "
        f"'\",\"namespace\":', {namespace}, ',\"is_bot\":', {_pick(f'{e} % 7', flag)}, "
        f"',\"is_minor\":', {_pick(f'({e} + 3) % 7', flag)}, ',\"length_new\":', {length}, "
        f"',\"edit_count\":', {edits}, ',\"event_time\":', {when}, '}}')"
    )
    image = _pick(f"{e} % 109", ["'null'", "'{}'", row])
    images = (
        f"(CASE WHEN event_type = 'error' THEN concat('\"before\":', {image}, ',\"after\":null') "
        f"ELSE concat('\"before\":null,\"after\":', {image}) END)"
    )
    body = f"concat('{{\"op\":', {op}, ',\"ts_ms\":', {stamp}, ',', {images}, '}}')"
    wrapped = f"(CASE WHEN {e} % 3 = 0 THEN concat('{{\"payload\":', {body}, '}}') ELSE {body} END)"
    value = _pick(
        f"{e} % 101",
        [
            "'{\"op\":\"c\"'", "'null'", "'5'", "'[1]'", "'\"payload\"'", "'{\"payload\":null}'",
            "'{\"payload\":7}'",
            f"(CASE WHEN {e} % 107 = 0 THEN NULL ELSE {wrapped} END)",
        ],
    )
    return f"SELECT {e} AS seq, {uid} AS key, {value} AS value FROM @events"


def docs(d: Dialect) -> str:
    """Documents of the replica: a title of eight words, the rest of the text as summary or,
    for every fourth, as comment."""
    w = "ws"
    rest = d.after(w, 8)
    comment = _pick(
        "doc_id % 6",
        [
            "'Use British English dates'", "'copyedit'", "NULL", "'/* History */'",
            "concat('expanded from ', source)", "concat('note ''', source, '''')",
        ],
    )
    return (
        f"SELECT {d.text('doc_id')} AS id, concat(lang, 'wiki') AS wiki, "
        f"{d.first(w, 8)} AS title, concat('https://d.example/', {d.text('doc_id')}) AS title_url, "
        f"CASE WHEN doc_id % 4 = 0 THEN {rest} ELSE {comment} END AS last_comment, "
        f"CASE WHEN doc_id % 4 = 0 OR {rest} = '' THEN NULL ELSE {rest} END AS summary, "
        "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS last_user, 'edit' AS event_type, "
        "CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS namespace, doc_id % 10 = 3 AS is_bot, "
        "doc_id % 10 = 7 AS is_minor, cast(n_chars as int) AS length_new, "
        "cast(1 + doc_id % 12 as int) AS edit_count, "
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1704067200000000 + doc_id * 61000000 END "
        "AS event_us, doc_id AS version, coalesce(toxic, 0) = 1 AS deleted "
        f"FROM (SELECT doc_id, lang, source, n_chars, {d.words('text')} AS ws FROM @documents) t "
        "LEFT JOIN (SELECT doc_id AS label_id, max(toxic) AS toxic FROM @labels GROUP BY doc_id) l "
        "ON doc_id = label_id"
    )


def summaries(d: Dialect) -> str:
    """Page summaries of all documents, also of those that have one, under their site and title."""
    return (
        "SELECT concat(lang, CASE WHEN doc_id % 28 = 0 THEN 'wiktionary' ELSE 'wiki' END) AS wiki, "
        f"concat(CASE WHEN doc_id % 24 = 0 THEN 'Talk:' ELSE '' END, {d.first('ws', 8)}) AS title, "
        + _pick("doc_id % 5", ["'disambiguation'", "'no-extract'", "'standard'"])
        + f" AS type, CASE WHEN doc_id % 16 = 8 THEN '  ' ELSE {d.after('ws', 8)} END AS extract, "
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat(' page about ', source, ' ') END "
        "AS description "
        f"FROM (SELECT doc_id, lang, source, {d.words('text')} AS ws FROM @documents) t"
    )


def search_queries(d: Dialect) -> str:
    """Eight search requests per benchmark item, of every shape the ranking tells apart."""
    item = d.text("item_id")

    def form(tag: str, text: str, mode: str, size: int, wiki: str, namespace: int) -> str:
        return (
            f"SELECT concat({item}, '-{tag}') AS query_id, {text} AS query, '{mode}' AS mode, "
            f"{size} AS size, {wiki} AS wiki, {namespace} AS namespace "
            f"FROM (SELECT item_id, text, {d.words('text')} AS ws FROM @benchmark) b"
        )

    null = "cast(NULL as varchar)" if d.duck else "cast(NULL as string)"
    return " UNION ALL ".join(
        [
            form("two", d.first("ws", 2), "hybrid", 10, null, 0),
            form("four", f"lower({d.first('ws', 4)})", "hybrid", 10, "'enwiki'", 0),
            form("eight", f"lower({d.first('ws', 8)})", "hybrid", 10, null, -1),
            form("whole", "lower(text)", "hybrid", 10, null, 0),
            form("quoted", f"concat('\"', {d.first('ws', 3)}, '\"')", "bm25", 5, null, -1),
            form("vector", "text", "vector", 20, null, 0),
            form("blank", "'   '", "hybrid", 10, null, 0),
            form("noise", f"concat('xyzzy', {item}, 'nonexistent')", "hybrid", 60, null, 0),
        ]
    )


def questions(d: Dialect) -> str:
    """Every user turn of the conversations as a question."""
    null = "cast(NULL as varchar)" if d.duck else "cast(NULL as string)"
    return (
        f"SELECT concat({d.text('conv_id')}, '-', {d.text('turn')}) AS question_id, "
        f"text AS question, CASE WHEN conv_id % 3 = 0 THEN 'enwiki' ELSE {null} END AS wiki "
        "FROM @conversations WHERE role = 'user'"
    )


def render(body: str, duck: bool, prefix: str = "") -> str:
    for table in TABLES:
        body = body.replace(f"@{table}", table if duck else f"{prefix}{table}")
    return body


def view(spark: SparkSession, sf_dir: str, builder) -> DataFrame:
    """A derived view as a DataFrame over the tables of ``sf_dir``."""
    configure(spark)
    prefix = f"tm_{zlib.crc32(sf_dir.encode()):08x}_"
    body = builder(Dialect(duck=False))
    for table in TABLES:
        if f"@{table}" in body:
            scan(spark, f"{sf_dir}/{table}.parquet").createOrReplaceTempView(prefix + table)
    return spark.sql(render(body, False, prefix))


def cte(builder) -> str:
    """The same view as SQL text for the checking engine."""
    return render(builder(Dialect(duck=True)), True)
