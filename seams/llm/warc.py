"""WARC archives: writing, reading, and resolving records with equal payloads.

Archives are files of gzip members, one per record, in the shared folder. Tasks
write under names of their own and return an index row per record; an index is
written as a table before it is used, so files of lost attempts are never read.
Deduplication shuffles headers only: the index rows meet by payload digest, the
record with the least page_id of each digest becomes the response, and each archive
is rewritten where its records' verdicts are brought to it: responses copied with
fresh headers, the others turned into revisit records that keep the HTTP header
and name their response, its URI and its date.

Nulls: a null payload is empty; a null url has no WARC-Target-URI; a null page_id has no
X-Page-Id and comes last among equal payloads. Repeated rows are records of
their own: of rows equal in page_id too (ties), the first in its archive is the response. page_id may be of any type that casts to a string and
back, and is ordered as that type. A payload of any length is one record. Other columns, of whatever name, are not read. No pages: no
records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seams.llm.store import materialize, new_path

ROLL_BYTES = 64 << 20
INDEX = "archive string, position bigint, size bigint, record_id string, record_type string, page_id string, payload_bytes bigint, payload_digest string, refers_to string, uri string, date string"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [pa.int64() if x.endswith("bigint") else pa.string() for x in INDEX.split(", ")]


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of one record."""
    end = raw.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in raw[:end].decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, raw[end + 4 : end + 4 + int(fields["content-length"])]


class Writer:
    """Writes gzip members, starting another archive beyond ROLL_BYTES."""

    def __init__(self, folder: str, roll: int = ROLL_BYTES):
        self.folder, self.roll, self.out, self.at = folder, roll, None, 0
        self.fs, self.path = _open(folder)
        self.fs.create_dir(self.path, recursive=True)

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.roll:
            self.close()
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.archive, self.at = f"{self.folder}/{name}", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{name}", compression=None)
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = z.compress(raw) + z.flush()
        self.out.write(packed)
        at, self.at = self.at, self.at + len(packed)
        return self.archive, at, len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def members(archive: str, piece: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Position, packed size and bytes of each record of an archive, read piece by piece."""
    fs, path = _open(archive)
    with fs.open_input_stream(path, compression=None) as f:
        rest, at = b"", 0
        while True:
            z, out, size = zlib.decompressobj(31), [], 0
            while not z.eof:
                data = rest or f.read(piece)
                if not data:
                    break
                out.append(z.decompress(data))
                size += len(data) - len(z.unused_data)
                rest = z.unused_data
            if not size:
                return
            if not z.eof:
                raise ValueError(f"{archive}: record at {at} is cut off")
            yield at, size, b"".join(out)
            at += size


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_NAMES), _TYPES)], _NAMES)


def _in_batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _rows(held)
            held = []
    yield _rows(held)


def write_responses(pages: DataFrame, date: str | None = None, payload: str = "html") -> DataFrame:
    """Write a response record for each row (page_id, url, payload); returns their index. date: of the records, the present time by default."""
    date = date or now()
    folder = new_path(pages.sparkSession, "warc")
    source = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col(f"`{payload}`").cast("string").alias("html"))

    def run(batches):
        def rows():
            writer = Writer(folder)
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    body = (html or "").encode()
                    sha, rid = digest(body), f"<urn:uuid:{uuid.uuid4()}>"
                    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                    page = page and page.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
                    raw = record([("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("X-Page-Id", page), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")], http_block(body))
                    yield (*writer.add(raw), rid, "response", page, len(body), sha, None, uri, date)
            writer.close()

        yield from _in_batches(rows())

    return materialize(source.mapInArrow(run, INDEX), "warc-index")


def index_row(archive: str, at: int, size: int, raw: bytes) -> tuple:
    """Index of one record: of a response by its payload itself, of a revisit by its headers."""
    fields, block = parse(raw)
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    if fields["warc-type"] == "response":
        body = block[block.index(b"\r\n\r\n") + 4 :]
        size_, sha = len(body), digest(body)
    else:
        http = dict(x.split(": ", 1) for x in block.decode().split("\r\n")[1:] if x)
        size_, sha = int(http["Content-Length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    return archive, at, size, fields["warc-record-id"], fields["warc-type"], page, size_, sha, refers, fields.get("warc-target-uri"), fields["warc-date"]


def read_index(archives: DataFrame) -> DataFrame:
    """Read whole archives (column archive) and index their records."""

    def run(batches):
        yield from _in_batches(index_row(a, at, size, raw) for batch in batches for a in batch.column(0).to_pylist() for at, size, raw in members(a))

    names = archives.select("archive").distinct()
    return names.repartition(max(1, min(names.count(), 10_000)), "archive").mapInArrow(run, INDEX)


def told(page: Column, kind: str) -> Column:
    """A page_id as its own type from its form in headers."""
    return F.replace(F.replace(F.replace(page, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")).cast(kind)


def resolve(index: DataFrame, min_bytes: int = 0, kind: str = "bigint") -> DataFrame:
    """Index rows with original (record_id, page_id, uri, date): null for what stays a response. kind: the type of page_id, by which it is ordered."""
    order = F.struct(F.col("page_id").isNull().alias("last"), told(F.col("page_id"), kind).alias("page"), "archive", "position", "record_id", "page_id", "uri", "date")
    groups = index.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", F.struct("first.record_id", "first.page_id", "first.uri", "first.date").alias("original"))
    found = index.join(groups, "payload_digest", "left")
    keeps = (F.col("payload_bytes") < min_bytes) | (F.col("original.record_id") == F.col("record_id"))
    return found.withColumn("original", F.when(~F.coalesce(keeps, F.lit(True)), F.col("original")))


def renewed(record_id: str) -> str:
    """The id of a record's rewritten form."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id)}>"


def rewrite(resolved: DataFrame, date: str | None = None) -> DataFrame:
    """Write archives in which revisits stand for repeated payloads; returns the new archives' index. Records keep their dates, and name `date` (the present time by default) as that of their rewriting."""
    date = date or now()
    folder = new_path(resolved.sparkSession, "warc")
    changes = resolved.groupBy("archive").agg(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("position", "original.record_id", "original.page_id", "original.uri", "original.date"))).alias("revisits"))
    tasks = changes.repartition(max(1, min(changes.count(), 10_000)), "archive")

    def run(batches):
        def rows():
            writer = Writer(folder)
            for batch in batches:
                for archive, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    of = {r["position"]: r for r in revisits}
                    for at, _, raw in members(archive):
                        fields, block = parse(raw)
                        common = [("WARC-Record-ID", renewed(fields["warc-record-id"])), ("WARC-Date", fields["warc-date"]), ("X-Rewritten-Date", date), ("WARC-Target-URI", fields.get("warc-target-uri")), ("X-Page-Id", fields.get("x-page-id")), ("WARC-Payload-Digest", fields["warc-payload-digest"])]
                        if at in of:
                            first = of[at]
                            block = block[: block.index(b"\r\n\r\n") + 4]
                            new = record([("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", renewed(first["record_id"])), ("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", first["date"]), ("X-Refers-To-Page-Id", first["page_id"]), ("Content-Type", "application/http;msgtype=response")], block)
                        else:
                            new = record([("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response")], block)
                        yield index_row(*writer.add(new), new)
            writer.close()

        yield from _in_batches(rows())

    return materialize(tasks.mapInArrow(run, INDEX), "warc-index")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives, deduplicate these, read the new archives back: their index."""
    kind = pages.schema["page_id"].dataType.simpleString()
    index = read_index(rewrite(resolve(write_responses(pages), min_bytes, kind)))
    return index.withColumns({c: told(F.col(c), kind) for c in ("page_id", "refers_to")})
