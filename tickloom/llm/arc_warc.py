"""Legacy ARC archives, their conversion to WARC, and reading both.

An ARC archive begins with a version block; a record is a header line (five fields in version 1, ten in version 2), as many bytes
as the line declares, and a line feed. The converter takes identifiers from place and header (UUID version 5), widens the
archive date to a WARC date, tells the type (HTTP answers become `response`, the version block `warcinfo`, anything else
`resource`) and computes payload and block digests. A payload that an earlier key already has becomes a `revisit`, which
keeps the HTTP head only.

Archives are single rows of bounded size while they are made, and Spark's text writer stores each as one gzip file in the
shared folder, under its own commit protocol; readers take whole archive files, one at a time, and yield their records.
Which records revisit is found from digests alone; payloads are never shuffled, only compressed archives beside the list of
their revisits.

Defined cases: a null payload is empty; equal payloads of any length, none included, count as copies; of copies the
smallest key is the response, of repeated keys the first in the archives, and rows without a key come last; a null URL is
written as `unknown:`; line breaks and spaces of a URL are percent-encoded; an empty table gives no archive and no rows;
other columns are ignored. A line where a header should stand but can't be read is skipped up to the next one that can; a
record that is shorter than declared is kept and marked truncated.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import delete, discard, fresh_path, saved

ARCHIVE_BYTES = 4 << 20
V1 = b"URL IP-address Archive-date Content-type Archive-length"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Fields after the URL, which may hold spaces in old archives and is read as the rest.
FIELDS = {1: 4, 2: 9}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
KEY = b"X-Record-Key"
HTTP_LENGTH = re.compile(rb"^Content-Length:[ \t]*([0-9]+)", re.I | re.M)
HTTP_KEY = re.compile(rb"^X-Record-Key:[ \t]*(-?[0-9]+)", re.I | re.M)
RECORD_TYPE = ("archive string, ordinal int, key long, url string, warc_date string, record_id string, warc_type string, refers_to long, "
               "payload_digest string, payload_bytes long, truncated boolean, payload binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(stamp: str) -> str:
    """An archive date of 8, 12 or 14 digits as a WARC date; one that isn't is the beginning of 1970."""
    digits = stamp if re.fullmatch(r"[0-9]{8}([0-9]{4}([0-9]{2})?)?", stamp) else "19700101"
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def version_block(name: str, version: int) -> bytes:
    body = b"%d 0 tickloom\n" % version + (V1 if version == 1 else V2) + b"\n"
    line = f"filedesc://{name} 0.0.0.0 20000101000000 text/plain" + ("" if version == 1 else f" 200 - - 0 {name}") + f" {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, key: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n" % len(payload)
    block = head + (b"" if key is None else KEY + b": %d\r\n" % key) + b"\r\n" + payload
    place = re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:")
    mid = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{place} 0.0.0.0 20000101000000 text/html{mid} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an archive, version block first, each by its declared length."""
    at, version, ordinal = 0, 1, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line, start = data[at:end].rstrip(b"\r"), at
        after = FIELDS[version]
        if line.startswith(b"filedesc://"):  # the version stands behind its own header line
            version = 2 if data[end + 1:end + 2] == b"2" else 1
            after = FIELDS[version]
        parts = line.rsplit(b" ", after)
        if len(parts) != after + 1 or not parts[-1].isdigit() or not re.fullmatch(rb"[0-9]{8,14}", parts[2]):
            at = end + 1
            continue
        size = int(parts[-1])
        block = data[end + 1:end + 1 + size]
        yield {"ordinal": ordinal, "offset": start, "version": version, "url": parts[0], "ip": parts[1], "date": parts[2].decode(), "mime": parts[3],
               "block": block, "truncated": len(block) < size}
        ordinal += 1
        at = end + 1 + size + 1


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """HTTP head, with its blank line, and payload; None if the block is no HTTP answer."""
    if not block.startswith(b"HTTP/"):
        return None
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[:cut + 4], block[cut + 4:])


def named(file: str, data: bytes) -> Iterator[tuple[str, dict]]:
    """Records of an archive with the name that its version block gives it, or else its file's; a rerun writes other files of the same names."""
    name = file
    for record in parse_arc(data):
        if record["url"].startswith(b"filedesc://") and len(record["url"]) > 11:
            name = record["url"][11:].decode("utf-8", "replace")
        yield name, record


def _key(head: bytes) -> int | None:
    m = HTTP_KEY.search(head)
    return int(m[1]) if m else None


def warc_record(archive: str, record: dict, refers_to: tuple[int | None, str] | None = None) -> bytes:
    """The WARC record of an ARC record; refers_to: key and record id of the response that has this payload."""
    http = split_http(record["block"])
    kind = "warcinfo" if record["url"].startswith(b"filedesc://") else "resource" if http is None else "revisit" if refers_to else "response"
    payload = record["block"] if http is None else http[1]
    block = http[0] if kind == "revisit" else record["block"]
    mime = b"application/http; msgtype=response" if http else b"application/warc-fields" if kind == "warcinfo" else record["mime"]
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <{record_id(archive, record)}>".encode(),
             f"WARC-Date: {warc_date(record['date'])}".encode(), b"Content-Type: " + mime]
    if kind == "warcinfo":
        lines.append(b"WARC-Filename: " + archive.encode())
    else:
        lines += [b"WARC-Target-URI: " + record["url"], b"WARC-IP-Address: " + record["ip"], f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}".encode()]
    if kind == "revisit":
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to[1]}>".encode()]
        lines += [] if refers_to[0] is None else [b"X-Refers-To-Key: %d" % refers_to[0]]
    if record["truncated"]:
        lines.append(b"WARC-Truncated: length")
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}".encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(archive: str, record: dict) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, archive + ' ' + str(record['offset']) + ' ' + record['url'].decode('utf-8', 'replace'))}"


def parse_warc(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields, by lower-case name, and block of every record, by its declared length."""
    at = data.find(b"WARC/")
    while at >= 0:
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0:
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[at:cut].split(b"\r\n")[1:])}
        size = int(fields.get(b"content-length", b"0"))
        yield fields, data[cut + 4:cut + 4 + size]
        at = data.find(b"WARC/", cut + 4 + size)


def unzipped(data: bytes) -> bytes:
    """The bytes of a file of gzip members, or data itself."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out) + data


def _store(blobs: DataFrame, path: str, separator: str) -> None:
    """Each row's data as a gzip file of its own; Spark's writer ends it with the separator."""
    text = blobs.select(F.col("data").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("lineSep", separator).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def write_arc(records: DataFrame, path: str, key: str, url: str, payload: str) -> None:
    """The rows as ARC archives of about ARCHIVE_BYTES; every other archive is of version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, parts, size, task = 0, [], 0, TaskContext.get().partitionId()

        def blob() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["data"])

        for batch in batches:
            for k, u, h in zip(*(c for c in batch.columns)):
                version, name = 1 + count % 2, f"tickloom-{task:06d}-{count:06d}.arc"
                if not parts:
                    parts = [version_block(name, version)]
                    size = len(parts[0])
                parts.append(arc_record(version, name, size, k.as_py(), u.as_py(), h.as_py()))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield blob()
                    count, parts, size = count + 1, [], 0
        if parts:
            yield blob()

    rows = records.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(payload).cast("string"))
    _store(rows.mapInArrow(run, "data binary"), path, "\n")


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20, weigh=lambda r: 200) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arc_digests(spark: SparkSession, path: str) -> DataFrame:
    """(archive, ordinal, key, record_id, digest, size) of every HTTP answer in the archives, without payloads."""
    schema = pa.schema([("archive", pa.string()), ("ordinal", pa.int32()), ("key", pa.int64()), ("record_id", pa.string()), ("digest", pa.string()), ("size", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for own, r in named(name, unzipped(content.as_py())):
                    if http := split_http(r["block"]):
                        yield name, r["ordinal"], _key(http[0]), record_id(own, r), sha1_base32(http[1]), len(http[1])

    return _files(spark, path).mapInArrow(lambda b: _batches(rows(b), schema), "archive string, ordinal int, key long, record_id string, digest string, size long")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Writes a WARC archive for every ARC archive. Equal payloads of at least least_bytes bytes become revisits of one."""
    found = saved(arc_digests(spark, arc_path), "digests")
    first = F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "archive", "ordinal", "record_id")).alias("first")
    copies = saved(found.where(F.col("size") >= least_bytes).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "copies")
    again = found.drop("key", "record_id", "size").join(copies, "digest").where("archive <> first.archive OR ordinal <> first.ordinal")
    listed = again.groupBy("archive").agg(F.collect_list(F.struct("ordinal", "first.key", "first.record_id")).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, revisits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                of = {r["ordinal"]: (r["key"], r["record_id"]) for r in revisits.as_py() or []}
                blob = b"".join(warc_record(own, r, of.get(r["ordinal"])) for own, r in named(name, unzipped(content.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([blob[:-4]], pa.binary())], names=["data"])

    joined = _files(spark, arc_path).join(listed, "archive", "left").select("archive", "content", "again")
    _store(joined.mapInArrow(run, "data binary"), warc_path, "\r\n\r\n")
    for t in (found, copies):
        discard(t)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every response, revisit and resource of the archives. Digest and length of what carries its payload are taken from it."""
    schema = pa.schema([("archive", pa.string()), ("ordinal", pa.int32()), ("key", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()),
                        ("record_id", pa.string()), ("warc_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("truncated", pa.bool_()), ("payload", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, (f, block) in enumerate(parse_warc(unzipped(content.as_py()))):
                    kind = f[b"warc-type"].decode()
                    if kind == "warcinfo":
                        continue
                    http = split_http(block)
                    head, payload = http or (b"", block)
                    if kind == "revisit":
                        m = HTTP_LENGTH.search(head)
                        digest, size = f[b"warc-payload-digest"].decode().removeprefix("sha1:"), int(m[1]) if m else None
                    else:
                        digest, size = sha1_base32(payload), len(payload)
                    to = f.get(b"x-refers-to-key")
                    yield (name, k, _key(head), f[b"warc-target-uri"].decode("utf-8", "replace"), f[b"warc-date"].decode(), f[b"warc-record-id"].decode(),
                           kind, int(to) if to else None, digest, size, b"warc-truncated" in f, payload if payloads and kind != "revisit" else None)

    return _files(spark, path).mapInArrow(lambda b: _batches(rows(b), schema, weigh=lambda r: 200 + len(r[-1] or b"")), RECORD_TYPE)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Pages through legacy archives and their conversion: the records of the WARC archives, without payloads."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, key, url, payload)
    convert(spark, arc, warc)
    delete(spark, arc)
    return read_warc(spark, warc, payloads=False)
