"""Legacy archives: ARC files converted to WARC.

An ARC file starts with a ``filedesc://`` block whose body names the version and
the fields of the header lines. Version 1 lines have URL, IP address, date, content
type and length; version 2 lines add result code, checksum, location, offset and
file name before the length. A record is such a line and as many bytes as the
line declares. Files may be a gzip member for each record, or plain.

Conversion makes a WARC record for each: type ``response`` (with an HTTP block) or
``resource``; an identifier derived from the record's contents and place; the
date as ISO 8601; block and payload digests. Of records with equal payloads of
``min_revisit`` bytes or more one is a response and the others revisit it.

Archives are written by tasks into files of about ``file_bytes`` each, one gzip
member a record, named when whole. They are read back with Spark's own binary
reader, so any store that Spark reads will do.

Edge cases: no rows make an archive of its head alone; a null payload is empty; a null URL is written as ``urn:none``, a
space in a URL as %20; a damaged or cut record ends its file's reading (the rest
can't be framed) and is reported as ``damaged``; repeated rows are records each.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import normal_uri, put_file, skew_join, slices, stash

V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Repeated payloads that may be broadcast (some 200 bytes each).
BROADCAST_ROWS = 200_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


def arc_date(number: int) -> str:
    """A 14-digit date for a page without one: an hour for each page from 2008 on."""
    return (datetime(2008, 1, 1, tzinfo=UTC) + timedelta(seconds=number % (1 << 28))).strftime("%Y%m%d%H%M%S")


def iso_date(digits: str) -> str:
    """``20080102030405`` as ``2008-01-02T03:04:05Z``; missing or impossible parts are
    their least value."""
    digits = re.sub("[^0-9]", "", digits)[:14]
    parts = [int(digits[a:b] or 0) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14))]
    low = (1, 1, 1, 0, 0, 0)
    try:
        return datetime(*[max(p, m) for p, m in zip(parts, low, strict=True)]).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return f"{max(parts[0], 1):04d}-01-01T00:00:00Z"


def _header_text(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", s) or "urn:none"


def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 riverseed\n{V1 if version == 1 else V2}\n".encode()
    tail = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 20080101000000 text/plain {tail}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, url: str, date: str, block: bytes, offset: int) -> bytes:
    line = [_header_text(url), "0.0.0.0", date, "text/html"]
    if version != 1:
        line += ["200", "-", "-", str(offset), name]
    return " ".join([*line, str(len(block))]).encode() + b"\n" + block + b"\n"


def http_block(payload: bytes, extra: dict[str, str]) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in extra.items())
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{head}\r\n".encode() + payload


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


def _rolled(batches: Iterator[pa.RecordBatch], out: str, suffix: str, head, record, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Write rows as members of files of about ``file_bytes``: ``head(name)`` and
    ``record(row, name, offset)`` give the members. Yields a row for each file."""
    task, number = TaskContext.get().partitionId(), 0
    rows = (r for whole in batches for b in slices(whole, whole.schema.names[-1]) for r in b.to_pylist())
    row = next(rows, None)
    while row is not None:
        name = f"part-{task:05d}-{number:05d}{suffix}"
        count = size = 0

        def write(stream, name=name) -> None:
            nonlocal row, count, size
            size += stream.write(_member(head(name)))
            while row is not None and size < file_bytes:
                size += stream.write(_member(record(row, name, size)))
                count += 1
                row = next(rows, None)

        put_file(f"{out}/{name}", write)
        number += 1
        yield pa.record_batch([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])


_WRITTEN = "file string, records long, bytes long"


def write_arc(pages: DataFrame, out: str, version: int = 1, file_bytes: int = 16 << 20) -> int:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as ARC files; the id goes into
    the HTTP header X-Page-Id. Returns the number of records."""
    out = normal_uri(out)

    def record(r: dict, name: str, offset: int) -> bytes:
        block = http_block((r["html"] or "").encode(), {} if r["page_id"] is None else {"X-Page-Id": str(r["page_id"])})
        return arc_record(version, name, r["url"] or "", arc_date(r["page_id"] or 0), block, offset)

    def run(batches):
        yield from _rolled(batches, out, ".arc.gz", lambda name: arc_head(version, name), record, file_bytes)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    n = rows.mapInArrow(run, _WRITTEN).agg(F.sum("records")).first()[0] or 0
    if not n:
        put_file(f"{out}/part-empty.arc.gz", lambda s: s.write(_member(arc_head(version, "part-empty.arc.gz"))))
    return n


def _members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file in turn; of a plain file, its bytes."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at, step = memoryview(data), 0, 1 << 16
    while at < len(data) and data[at] == 0x1F:
        z, out = zlib.decompressobj(31), []
        try:
            while not z.eof and at < len(data):
                out.append(z.decompress(view[at : at + step]))
                at += step
        except zlib.error:
            return
        at = min(at, len(data)) - len(z.unused_data)
        yield b"".join(out)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    version: int
    damaged: bool = False


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, without its ``filedesc`` block."""
    fields, version, first = V1.split(), 1, True
    for m in _members(data):
        at = 0
        while at < len(m):
            if m[at : at + 1] in b"\r\n":  # between records
                at += 1
                continue
            end = m.find(b"\n", at)
            line = m[at : end if end >= 0 else len(m)].decode("utf-8", "replace").strip().split(" ")
            if end < 0 or len(line) < 5 or not line[-1].isdigit():
                yield ArcRecord("", "", "", "", b"", version, True)
                return
            n = int(line[-1])
            block = m[end + 1 : end + 1 + n]
            at = end + 1 + n
            if first and line[0].startswith("filedesc://"):
                head = block.decode("utf-8", "replace").split("\n")
                version = int(head[0].split(" ")[0]) if head[0][:1].isdigit() else 1
                fields = head[1].split() if len(head) > 1 and head[1] else (V1 if version == 1 else V2).split()
                first = False
                continue
            first = False
            extra = len(line) - len(fields)  # spaces in a URL or in a content type
            url = " ".join(line[: 1 + max(extra, 0)])
            got = dict(zip([f.lower() for f in fields[1:]], line[1 + max(extra, 0) :], strict=False))
            yield ArcRecord(url, got.get("ip-address", ""), got.get("archive-date", ""), got.get("content-type", ""), block, version, len(block) < n)
            if len(block) < n:
                return


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields (lower-case names) and body; without an HTTP head, all is body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return {}, block
    pairs = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


_PARSED = "file string, place long, url string, ip string, date string, content_type string, damaged boolean, page_id long, payload_bytes long, payload_sha1 string, block binary"


def read_arc(spark: SparkSession, folder: str, with_block: bool = True) -> DataFrame:
    """The records of the ARC files of a folder, with digests of their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("damaged", pa.bool_()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("block", pa.binary())])
        for b in batches:
            for i in range(b.num_rows):
                rows, held = [], 0
                name = b.column("path")[i].as_py().rpartition("/")[2]
                for k, r in enumerate(parse_arc(b.column("content")[i].as_py())):
                    head, body = payload_of(r.block)
                    pid = head.get("x-page-id", "")
                    rows.append((name, k, r.url, r.ip, r.date, r.content_type, r.damaged, int(pid) if re.fullmatch(r"-?\d{1,19}", pid) else None, len(body), hashlib.sha1(body).hexdigest(), r.block if with_block else None))
                    held += len(r.block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc*").load(folder)
    return files.select("path", "content").mapInArrow(run, _PARSED)


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _warcinfo(name: str) -> bytes:
    body = b"software: riverseed\r\nformat: WARC File Format 1.1\r\n"
    return _warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", "2008-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


def warc_record(r: dict) -> bytes:
    """The WARC record of an ARC record ``r`` (a row of :func:`read_arc` with ``refers``:
    the ``file#place`` of the response that it revisits, or null, and ``refers_url``)."""
    block = r["block"] or b""
    http = block.startswith(b"HTTP/")
    kind = "revisit" if r["refers"] else "response" if http else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(f"{r['file']}#{r['place']}")), ("WARC-Date", iso_date(r["date"])), ("WARC-Target-URI", _header_text(r["url"]))]
    if r["ip"] and r["ip"] != "0.0.0.0":
        fields.append(("WARC-IP-Address", r["ip"]))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["payload_sha1"])).decode()))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["refers"])), ("WARC-Refers-To-Target-URI", _header_text(r["refers_url"] or ""))]
        block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n" if http else b""
    kind_of = "application/http;msgtype=response" if http else r["content_type"] or "application/octet-stream"
    return _warc([*fields, ("WARC-Block-Digest", _sha1_32(block)), ("Content-Type", kind_of)], block)


def convert(spark: SparkSession, arcs: str, out: str, min_revisit: int = 1000, file_bytes: int = 16 << 20) -> int:
    """Convert the ARC files of folder ``arcs`` into WARC files in ``out``; of equal
    payloads that with the largest page id (then file and place) is the response."""
    out = normal_uri(out)
    heads = read_arc(spark, arcs, with_block=False).where(f"payload_bytes >= {int(min_revisit)} AND NOT damaged")
    top = heads.groupBy("payload_sha1", "payload_bytes").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "file", "place", "url")).alias("x")).where("n > 1")
    top = top.select("payload_sha1", "payload_bytes", F.concat_ws("#", "x.file", F.col("x.place").cast("string")).alias("to"), F.col("x.url").alias("to_url"))
    top = stash(top, "repeated")
    rows = read_arc(spark, arcs).where("NOT damaged")
    if top.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(top), ["payload_sha1", "payload_bytes"], "left")
    else:  # found on rows without their blocks, which then are dealt by place
        places = skew_join(stash(heads.select("payload_sha1", "payload_bytes", "file", "place"), "heads"), top, ["payload_sha1", "payload_bytes"])
        rows = rows.join(places.select("file", "place", "to", "to_url"), ["file", "place"], "left")
    other = F.col("to") != F.concat_ws("#", "file", F.col("place").cast("string"))
    rows = rows.select("file", "place", "url", "ip", "date", "content_type", "payload_sha1", F.when(other, F.col("to")).alias("refers"), F.when(other, F.col("to_url")).alias("refers_url"), "block")

    def run(batches):
        yield from _rolled(batches, out, ".warc.gz", _warcinfo, lambda r, name, offset: warc_record(r), file_bytes)

    n = rows.mapInArrow(run, _WRITTEN).agg(F.sum("records")).first()[0] or 0
    if not n:
        put_file(f"{out}/part-empty.warc.gz", lambda s: s.write(_member(_warcinfo("part-empty.warc.gz"))))
    return n


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file."""
    for m in _members(data):
        at = 0
        while at < len(m):
            if m[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = m.find(b"\r\n\r\n", at)
            if end < 0 or not m.startswith(b"WARC/", at):
                return
            pairs = (x.partition(":") for x in m[at:end].decode("utf-8", "replace").split("\r\n")[1:])
            fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
            n = int(fields.get("content-length", "0"))
            yield fields, m[end + 4 : end + 4 + n]
            at = end + 4 + n


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The response, resource and revisit records of the WARC files of a folder:
    ``record_id, record_type, url, date, page_id, payload_bytes, payload_digest``
    (hex) and ``refers_to_id``. Of a revisit size and digest are the full payload's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "url", "date", "page_id", "payload_bytes", "payload_digest", "refers_to_id"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for fields, block in parse_warc(b.column("content")[i].as_py()):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, body = payload_of(block)
                    pid = head.get("x-page-id", "")
                    if kind == "revisit":
                        size, digest = int(head.get("content-length") or 0), base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    else:
                        size, digest = len(body), hashlib.sha1(body).hexdigest()
                    rows.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), int(pid) if re.fullmatch(r"-?\d{1,19}", pid) else None, size, digest, fields.get("warc-refers-to")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "content").mapInArrow(run, "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string")
