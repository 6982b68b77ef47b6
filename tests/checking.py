"""Side-by-side check of registered queries against their SQL on the given tables.

Usable as a script: ``python tests/checking.py SF_DIR [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda at: names[at])
    shaped = [tuple(plain(row[at]) for at in order) for row in rows]
    return sorted(names), sorted(shaped, key=repr)


def compare(spark, con, query, sql: str, sf_dir: str):
    """Empty text when both sides agree, else a short description of the difference."""
    started = time.time()
    df = query(spark, sf_dir)
    left = rows_of(df.columns, df.collect())
    middle = time.time()
    cursor = con.execute(sql)
    right = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    took = f"spark {middle - started:.1f}s duck {time.time() - middle:.1f}s rows {len(left[1])}"
    if left[0] != right[0]:
        return f"columns {left[0]} <> {right[0]}", took
    if len(left[1]) != len(right[1]):
        return f"row counts {len(left[1])} <> {len(right[1])}", took
    different = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if different:
        return f"{len(different)} rows differ, {left[0]}\n    {different[0][0]}\n    {different[0][1]}", took
    return "", took


def main(argv) -> int:
    import __spark_entry__ as entry_points
    from tidemark.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=8,
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    failed = 0
    for name in names or queries:
        try:
            if name in oracles:
                problem, took = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                started = time.time()
                count = queries[name](spark, sf_dir).count()
                problem, took = "", f"rows only: {count}, {time.time() - started:.1f}s"
        except Exception as error:  # report and go on with the next query
            problem, took = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failed += bool(problem)
        print(("FAIL " if problem else "ok   ") + name, took, problem, flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
