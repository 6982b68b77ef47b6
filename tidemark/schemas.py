"""Table schemas shared by the batch and streaming jobs."""

from __future__ import annotations

# A normalised edit, in log order ``seq``; ``arrived_at`` stands in for "now" on replay.
EDIT = """
    seq BIGINT, wiki STRING, title STRING, title_url STRING, last_comment STRING,
    last_user STRING, event_type STRING, namespace INT, is_bot BOOLEAN, is_minor BOOLEAN,
    length_new INT, event_time TIMESTAMP
"""

# Row image columns of the system-of-record table, in order.
PAGE_FIELDS = [
    "wiki", "title", "title_url", "last_comment", "last_user", "event_type", "namespace",
    "is_bot", "is_minor", "length_new", "edit_count", "first_seen", "event_time",
]

# Fields an edit refreshes on a known page; the others keep their first value.
REFRESHED_FIELDS = [
    "title_url", "last_comment", "last_user", "event_type", "is_bot", "is_minor",
    "length_new", "event_time",
]
KEPT_FIELDS = ["wiki", "title", "namespace"]

# A document of the searchable replica without its derived columns.
DOC_FIELDS = [
    "id", "wiki", "title", "title_url", "last_comment", "summary", "last_user", "event_type",
    "namespace", "is_bot", "is_minor", "length_new", "edit_count", "event_time", "version",
    "deleted",
]

DOC = """
    id STRING, wiki STRING, title STRING, title_url STRING, last_comment STRING,
    summary STRING, last_user STRING, event_type STRING, namespace INT, is_bot BOOLEAN,
    is_minor BOOLEAN, length_new INT, edit_count INT, event_time TIMESTAMP, version BIGINT,
    deleted BOOLEAN
"""

# Columns a stored index may lack because it was written before they existed.
ADDITIVE_DOC_FIELDS = {"summary": "string"}
