"""All registered queries and their checking SQL."""

from __future__ import annotations

from tidemark.plans import queries_feed, queries_search, queries_stream

MODULES = [queries_feed, queries_search, queries_stream]


def queries():
    found = {}
    for module in MODULES:
        found.update(module.queries())
    return found


def oracle_sql():
    found = {}
    for module in MODULES:
        found.update(module.oracle_sql())
    return found
