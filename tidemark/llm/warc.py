"""WARC archives: written by Spark tasks, read back record by record.

Every record is a gzip member of its own. Writing: payload digests are made first, the smallest
id of each digest keeps the payload (response) and the others name it (revisit). The smallest ids
are found by an aggregate, so that a payload with a third of all rows is one row per task. Each
task writes files of bounded size into the shared folder, under names of its own attempt; only
the names a task returns when it ends count, so a lost or repeated task leaves nothing behind
that is read. Reading is sequential: compressed blocks go through an incremental decompressor,
headers and content length frame the block, and digests are verified; memory is one record.

Definitions: a null payload is empty; payloads shorter than ``min_bytes`` are all responses; rows
with the smallest id of their payload are responses, even if repeated; a row without id revisits
any row with an id, and rows without id alone are responses; a null URL is left out of the record.
Signs that can't stand in a header are percent-encoded in the URL.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, narrow, one_row, text_bytes
from tidemark.session import staging_dir

# Bytes after which a task starts its next archive, and the level of compression.
MAX_ARCHIVE = 1 << 30
LEVEL = 4
# Compressed bytes taken from a file at a time.
READ_BYTES = 1 << 18
VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:{}>"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
COLUMNS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class Damaged(ValueError):
    """An archive that breaks off, or a record whose framing or digest is wrong."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def assigned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, first_id``: the record that keeps the payload, null if it is
    the row's own."""
    rows = narrow(pages, page_id="bigint", url="string", html="string")
    rows = rows.select("page_id", "url", text_bytes(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_enough = F.length("payload") >= min_bytes
    firsts = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    joined = rows.join(firsts, "digest", "left")
    own = ~long_enough | F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(~own, F.col("first_id")).alias("first_id"))


def record(page_id, url, payload: bytes, first_id) -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if first_id is None else head
    fields = [
        ("WARC-Type", "response" if first_id is None else "revisit"),
        ("WARC-Record-ID", RECORD_ID.format("none" if page_id is None else page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest_of(payload)),
        ("WARC-Block-Digest", "sha1:" + digest_of(block)),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if first_id is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", RECORD_ID.format(first_id))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def write(rows: DataFrame, folder: str, max_archive: int = MAX_ARCHIVE) -> DataFrame:
    """Write ``assigned`` rows; the result lists the archives: ``path, records``."""

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, name, written, records = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, written, records = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = member(record(row["page_id"], row["url"], row["payload"], row["first_id"]))
                out.write(data)
                written, records = written + len(data), records + 1
                if written >= max_archive:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records]})

    return keep(rows.mapInArrow(run, "path string, records bigint"), "archives")


def decompressed(stream):
    """Bytes of each gzip member in turn, a piece at a time; None ends a member."""
    coder, data, started = None, b"", False
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                break
        if coder is None:
            coder = zlib.decompressobj(31)
        try:
            piece = coder.decompress(data)
        except zlib.error as error:
            raise Damaged(f"not a gzip member: {error}") from error
        if piece:
            yield piece
        data = coder.unused_data
        if coder.eof:
            coder = None
            yield None
    if coder is not None:
        raise Damaged("the archive breaks off within a member")


def records(stream):
    """``headers, block`` of every record of an open archive, in order and verified."""
    held = bytearray()
    headers, need = None, 0
    for piece in decompressed(stream):
        if piece is not None:
            held += piece
        if headers is None and (end := held.find(b"\r\n\r\n")) >= 0:
            headers = parse(bytes(held[:end]))
            need = end + 4 + int(headers["content-length"])
        if piece is None:
            if headers is None or len(held) != need + 4 or held[need:] != b"\r\n\r\n":
                raise Damaged("a record's content length doesn't frame its member")
            start = need - int(headers["content-length"])
            block = bytes(held[start:need])
            if headers["warc-block-digest"] != "sha1:" + digest_of(block):
                raise Damaged("a block's digest is wrong")
            yield headers, block
            held, headers = bytearray(), None


def parse(data: bytes) -> dict[str, str]:
    version, _, lines = data.partition(b"\r\n")
    if not version.startswith(b"WARC/1."):
        raise Damaged("not a WARC record")
    pairs = (line.partition(": ") for line in lines.decode("utf-8").split("\r\n"))
    return {name.lower(): value for name, _, value in pairs}


def number(urn: str | None):
    found = re.search(r"urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def page_of(headers: dict[str, str], block: bytes) -> dict:
    """One row: the record, and its payload if it holds one."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    revisit = headers["warc-type"] == "revisit"
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (size != len(payload) or digest != digest_of(payload)):
        raise Damaged("a payload's digest is wrong")
    return {
        "page_id": number(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": headers["warc-type"],
        "refers_to": number(headers.get("warc-refers-to")),
    }


def read(archives: DataFrame, payloads: bool = True, batch_bytes: int = 1 << 24) -> DataFrame:
    """Rows of all records: ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to`` and, if asked for, ``payload`` (null for a revisit)."""
    columns = f"{COLUMNS}, url string" + ", payload binary" * payloads
    names = [field.strip().split(" ")[0] for field in columns.split(",")]
    schema = pa.schema([
        (name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[field.strip().split(" ")[1]])
        for name, field in zip(names, columns.split(","))
    ])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                with files.open_input_stream(at, compression=None) as stream:
                    for headers, block in records(stream):
                        row = page_of(headers, block)
                        rows.append({name: row[name] for name in names})
                        size += 200 + payloads * len(block)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    # A task per archive, however few bytes the list itself has.
    spread = max(1, one_row(archives.agg(F.count(F.lit(1)).alias("n")))["n"])
    return archives.select("path").repartition(spread).mapInArrow(run, columns)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages in the shared folder of the session: ``path, records``."""
    return write(assigned(pages, min_bytes), qualified(pages.sparkSession, staging_dir(pages.sparkSession, "warc")))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark itself would take a plain path: the cluster's
    default one, which need not be a machine's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if re.match("file:/(?!//)", whole) else whole
