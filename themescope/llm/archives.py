"""Legacy archive converter: ARC files to WARC files, and both from and to tables.

An ARC file starts with a version block, whose line tells the version of the header lines that follow:

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

Each header line is followed by as many bytes as it declares and a line feed. The converter reads the fields by the
version, the document by its declared length, and makes of it a WARC/1.0 record with the same identity on every
run: a name-based UUID of URL, date, digest and page as WARC-Record-ID, the 14-digit date as ISO 8601 time, the MIME
type of the content, and SHA-256 digests of block and payload. The block is the document byte for byte, whatever its
status line, headers and encoding; one that is no HTTP answer becomes a resource record. Of equal payloads of at
least REVISIT bytes the one with the smallest page_id is a response; the others become revisit records that refer to
it and carry the HTTP head alone.

The converter reads the archives twice: for an index (archive, place, digest, identity), in which equal payloads are
found without moving any payload, and to write the records, where each archive meets its own revisits.

Archives are gzip files, a member a record, of about CHUNK bytes of content, written to the shared folder by Spark's
text writer, one row a file: its commit protocol discards what a lost task had written. What it adds to a row, the
line separator, is an empty gzip member. Archives are read back with the binary reader and inflated in steps.

Null html: an empty payload. Null url: ``urn:x-page:`` and the page_id; white space in a URL is percent-coded.
Payloads of any length are kept whole. Rows with a null page_id come back with null, and revisit a row that has one.
Repeated rows give a record each; those that share the smallest page_id are all responses. A date that can't be read
is taken from the version block. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, shared_dir, stored, table

#: Bytes of content in an archive, bytes from which a payload can be revisited, bytes inflated to and from in a step.
CHUNK, REVISIT, STEP, PIECE = 24 << 20, 100, 1 << 20, 32 << 10
#: Effort of compression.
LEVEL = 4
# Field names of the header lines by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
FIRST_DAY = datetime(1997, 1, 1)
DIGITS = "%Y%m%d%H%M%S"
PAGE = b"X-Page-Id"


def member(data: bytes) -> bytes:
    """A gzip member without a time."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def text_of(raw: bytes) -> str:
    """Header fields as text; bytes that are no UTF-8 survive the way back."""
    return raw.decode("utf-8", "surrogateescape")


def raw_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


@dataclass
class Capture:
    """One document of an ARC file. http: all up to the payload, empty if the document is no HTTP answer."""

    url: str
    ip: str
    date: str
    mime: str
    http: bytes
    payload: bytes

    @property
    def status(self) -> int | None:
        parts = self.http.split(b"\n", 1)[0].split()
        return int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None

    @property
    def page(self) -> int | None:
        return page_of(self.http)


def page_of(http: bytes) -> int | None:
    for line in http.split(b"\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == PAGE.lower():
            return int(value) if value.strip().lstrip(b"-").isdigit() else None
    return None


def cut_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload. Old servers end lines with a line feed alone; no empty line: no payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [at + len(end) for end in (b"\r\n\r\n", b"\n\n") if (at := block.find(end)) >= 0]
    at = min(ends, default=len(block))
    return block[:at], block[at:]


# ---- ARC


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 themescope\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fixed = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": FIRST_DAY.strftime(DIGITS), "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fixed[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """A capture of a page: header line, HTTP answer, line feed. The date is made from page_id."""
    page = "" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%s: %s\r\nContent-Length: %d\r\n\r\n" % (PAGE, page.encode(), len(payload))
    address = url if url else f"urn:x-page:{page}"
    address = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in address)
    when = FIRST_DAY + timedelta(seconds=(page_id or 0) % (1 << 30))
    return arc_document(version, name, offset, address, when.strftime(DIGITS), "text/html", http + payload)


def arc_document(version: int, name: str, offset: int, url: str, date: str, mime: str, block: bytes) -> bytes:
    fields = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return raw_of(" ".join(fields[f] for f in ARC_FIELDS[version])) + b"\n" + block + b"\n"


class Stream:
    """A gzip file in memory, inflated as it is read."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at, self.buffer, self.begin = memoryview(data), 0, bytearray(), 0
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                if not rest and self.at >= len(self.data):
                    return False
                self.at -= len(rest)
                self.inflate = zlib.decompressobj(31)
            pending = self.inflate.unconsumed_tail
            if not pending:
                if self.at >= len(self.data):
                    return False
                pending = bytes(self.data[self.at : self.at + PIECE])
                self.at += len(pending)
            out = self.inflate.decompress(pending, STEP)
            if out:
                del self.buffer[: self.begin]
                self.begin = 0
                self.buffer += out
                return True

    def line(self) -> bytes | None:
        """Up to and without the next line feed; None at the end."""
        seen = self.begin
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen -= self.begin
            if not self._more():
                rest = bytes(self.buffer[self.begin :])
                self.begin = len(self.buffer)
                return rest or None
            seen = max(0, seen)
        out = bytes(self.buffer[self.begin : end])
        self.begin = end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.begin < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[self.begin : self.begin + n])
        self.begin += n
        return out


def read_arc(stream: Stream) -> Iterator[Capture]:
    """Captures of an ARC file of either version."""
    fields: tuple[str, ...] = ()
    while (line := stream.line()) is not None:
        if not line.strip():
            continue  # the line feed after a document
        parts = text_of(line.rstrip(b"\r")).split(" ")
        if not fields:
            body = text_of(stream.take(int(parts[-1]))).split("\n")
            fields = ARC_FIELDS[int(body[0].split(" ")[0])]
            if tuple(body[1].split()) != fields:
                raise ValueError(f"not the header fields of this version: {body[1]}")
            made = parts[2]
            continue
        over = len(parts) - len(fields)
        if over < 0:
            raise ValueError(f"a header line has {len(parts)} fields, not {len(fields)}")
        head = dict(zip(fields, ["%20".join(parts[: over + 1]), *parts[over + 1 :]], strict=True))  # only URLs held spaces
        date = head["Archive-date"]
        yield Capture(head["URL"], head["IP-address"], date if is_date(date) else made, head["Content-type"], *cut_http(stream.take(int(head["Archive-length"]))))


# ---- WARC


def full_date(arc_date: str) -> str:
    """14 digits: fewer are filled up, more are cut."""
    return (arc_date + "00000101000000"[len(arc_date) :])[:14]


def is_date(arc_date: str) -> bool:
    try:
        datetime.strptime(full_date(arc_date), DIGITS)
    except ValueError:
        return False
    return arc_date.isdigit()


def warc_date(arc_date: str) -> str:
    """An ARC date as ISO 8601 in UTC."""
    return datetime.strptime(full_date(arc_date), DIGITS).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_id(c: Capture, digest: str) -> str:
    """The same for the same capture on every run."""
    name = raw_of(f"{c.url} {c.date} {digest} {'' if c.page is None else c.page}")
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(SPACE.bytes + name).digest()[:16], version=5)}>"


def warc_record(c: Capture, digest: str, first: tuple[int, str, bytes, str] | None = None) -> bytes:
    """A response, a resource, or a revisit of the record ``first`` (page, record id, URI, date), with the line ends that close it."""
    kind = "revisit" if first else "response" if c.http else "resource"
    block = c.http if first else c.http + c.payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(c, digest)}",
        f"WARC-Date: {warc_date(c.date)}",
        f"WARC-Target-URI: {c.url}",
        f"WARC-IP-Address: {c.ip}",
        f"WARC-Identified-Payload-Type: {c.mime}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{sha256(block)}",
        f"Content-Type: {'application/http; msgtype=response' if c.http else c.mime}",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(c.payload)}",
    ]
    if first:
        page, id_, uri, date = first
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {id_}", f"WARC-Refers-To-Target-URI: {text_of(uri)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {page}"]
    return raw_of("\r\n".join(head)) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; a block that doesn't match its digest is an error."""
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if line.rstrip(b"\r") != b"WARC/1.0":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.line()) is not None and line.rstrip(b"\r"):
            name, _, value = text_of(line.rstrip(b"\r")).partition(": ")
            head[name] = value
        block = stream.take(int(head["Content-Length"]))
        if head["WARC-Block-Digest"] != f"sha256:{sha256(block)}":
            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
        yield head, block


# ---- tables


def _row(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])


def _batch(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])


def _write(rows: DataFrame, path: str) -> None:
    """One file a row (value); the writer passes bytes on as they are."""
    value = rows.select(F.col("value").cast("string").alias("value"))
    value.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path)


def _open(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str) -> None:
    """Pages (page_id, url, html) as ARC files; version 1 and 2 by turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not held:
                    version, name = 1 + (task + nth) % 2, f"part-{task}-{nth}.arc.gz"
                    held.append(member(arc_version_block(version, name)))
                    size, nth, at = 0, nth + 1, len(held[0])
                record = arc_record(version, name, at, page_id, url, html or b"")
                held.append(member(record))
                at, size = at + len(held[-1]), size + len(record)
                if size >= CHUNK:
                    yield _row(held)
                    held = []
        if held:
            yield _row(held)

    _write(pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary")).mapInArrow(run, "value binary"), path)


#: A row for each capture of an archive.
INDEX = "path string, nth long, page long, digest string, n long, id string, uri binary, date string"


def index_of(spark: SparkSession, arc: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for nth, c in enumerate(read_arc(Stream(content.as_buffer()))):
                    digest = sha256(c.payload)
                    rows.append((path, nth, c.page, digest, len(c.payload), record_id(c, digest), raw_of(c.url), warc_date(c.date)))
                    if len(rows) == 10_000:
                        yield _batch(rows, INDEX, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, INDEX, kinds)

    return _open(spark, arc).mapInArrow(run, INDEX)


def revisits(index: DataFrame) -> DataFrame:
    """path, nth and the record (first_page, first_id, first_uri, first_date) that the capture there revisits."""
    rows = index.where(F.col("n") >= REVISIT)
    order = F.struct(F.col("page").isNull().alias("none"), "page", "id", "uri", "date")
    firsts = rows.groupBy("digest").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and f.page is not null")
    firsts = firsts.select("digest", "rows", *[F.col(f"f.{c}").alias(f"first_{c}") for c in ("page", "id", "uri", "date")])
    found = join_counted(rows.select("path", "nth", "page", "digest"), firsts, "digest", "rows", index.count())
    return found.where(~F.col("page").eqNullSafe(F.col("first_page"))).select("path", "nth", "first_page", "first_id", "first_uri", "first_date")


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """ARC files as WARC files, one for one. An archive's list of revisits is bounded by its number of records."""
    marks = revisits(stored(index_of(spark, arc), "index"))
    marks = marks.groupBy("path").agg(F.collect_list(F.struct("nth", "first_page", "first_id", "first_uri", "first_date")).alias("marks"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, marks in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                first = {m["nth"]: (m["first_page"], m["first_id"], m["first_uri"], m["first_date"]) for m in marks or ()}
                held = [member(warc_record(c, sha256(c.payload), first.get(nth))) for nth, c in enumerate(read_arc(Stream(content.as_buffer())))]
                if held:
                    yield _row(held)

    _write(_open(spark, arc).join(marks, "path", "left").select("content", "marks").mapInArrow(write, "value binary"), warc)


#: A row for each record of a WARC file.
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, warc_date string, target_uri binary, mime binary, http binary, payload binary"


def read_archives(spark: SparkSession, warc: str, payloads: bool = False) -> DataFrame:
    """RECORDS of all WARC files; http and payload only if asked for. A payload that doesn't match its digest is an error."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3, *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for head, block in read_warc(Stream(content.as_buffer())):
                    http, payload = cut_http(block) if head["WARC-Type"] != "resource" else (b"", block)
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] != "revisit" and (len(payload) != n or sha256(payload) != digest):
                        raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
                    refers = head.get("X-Refers-To-Page")
                    more = (http, payload) if payloads else (None, None)
                    rows.append((page_of(http), n, digest, head["WARC-Type"], int(refers) if refers else None, head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Date"], raw_of(head["WARC-Target-URI"]), raw_of(head["WARC-Identified-Payload-Type"]), *more))
                    size += len(block) if payloads else 0
                    if len(rows) == 10_000 or size >= STEP:
                        yield _batch(rows, RECORDS, kinds)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, RECORDS, kinds)

    return _open(spark, warc).select("content").mapInArrow(run, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{path}/arc")
    convert(spark, f"{path}/arc", f"{path}/warc")
    return read_archives(spark, f"{path}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
