"""WARC archives: pages go out as response and revisit records, cut into segments, and are put together again.

Writing. Each record's block is an HTTP response in chunked transfer coding; a block longer than `segment_bytes` goes
out as a first segment and continuation records. Executors write through Spark's text writer (any Hadoop file system,
atomic task commit): the line separator is the CRLF CRLF that ends a WARC record. Files are gzip streams of at most
`records_per_file` records, so one file is bounded by records_per_file * segment_bytes.

Reading. Continuation records meet by origin identifier, are ordered by segment number, the total length is verified
and the chunked framing is decoded. Records in one segment need no shuffle.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_path

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 32 * 1024, 8 * 1024, 2000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Records that hold no page, or only a later segment of one.
OTHER_TYPES = ("continuation", "warcinfo", "request", "metadata", "resource", "conversion")
OUT = pa.schema([("record", pa.binary())])
PART = pa.schema([("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())])
BACK = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("valid", pa.bool_())])
PART_SQL = "origin string, segment long, total long, head string, block binary"
BACK_SQL = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary, valid boolean"


def record_plan(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """pages as page_id, url, payload, sha1, and refers_to (its page_id) and refers_uri where an equal payload of at least min_bytes has a larger page_id.

    A null html is an empty payload. A null page_id never is the one referred to, unless all ids of a group are null:
    then each of them is a response. The way back to the payloads goes by page_id, so hot payloads meet in no task.
    """
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = body.withColumns({"sha": F.unhex(F.sha2("payload", 256)), "bytes": F.octet_length("payload")})
    large = keyed.where(F.col("bytes") >= min_bytes).select("page_id", "url", "sha", "bytes")
    first = large.groupBy("sha", "bytes").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "bytes", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_uri"))
    again = large.join(first, ["sha", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = again.select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to", "refers_uri").distinct()
    joined = keyed.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha") == F.col("again_sha")), "left")
    return joined.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), "refers_to", "refers_uri")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(block: bytes) -> bytes | None:
    """The payload of an HTTP block in chunked coding; None if the framing is broken."""
    at, parts = block.find(b"\r\n\r\n") + 4, []
    if at < 4:
        return None
    while True:
        end = block.find(b"\r\n", at)
        try:
            n = int(block[at:end].split(b";")[0], 16) if end > 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n + 2 > len(block) or block[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        if n == 0:
            return b"".join(parts)
        parts.append(block[end + 2 : end + 2 + n])
        at = end + 4 + n


def head_of(fields: list[tuple[str, str]], length: int) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(length))]) + "\r\n").encode()


def target_uri(url: str | None) -> str:
    return quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")


def records_of(page_id, url, payload: bytes, sha1: str, refers_to, segment_bytes: int, chunk_bytes: int, refers_uri: str | None = None):
    """The WARC records of one page, without the CRLF CRLF at their ends."""
    ident = f"<urn:uuid:{uuid.uuid4()}>"
    own = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Record-ID", ident), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", target_uri(url)),
        ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Page-ID", own), ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        yield head_of([("WARC-Type", "revisit"), *fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", target_uri(refers_uri)), ("WARC-Refers-To-Date", "2000-01-01T00:00:00Z"), ("X-Refers-To-Page-ID", str(refers_to))], 0)
        return
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield head_of([("WARC-Type", "response"), *fields, ("Content-Type", "application/http;msgtype=response")], len(block)) + block
        return
    cuts = range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        if number == 1:
            head = [("WARC-Type", "response"), *fields, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", "1")]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(number))]
            if number == len(cuts):
                head.append(("WARC-Segment-Total-Length", str(len(block))))
        yield head_of(head, len(part)) + part


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write pages (page_id, url, html) as gzip WARC files under path. Rows that repeat are written as often as they come."""

    def write(batches):
        for b in batches:
            out, held = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in records_of(*row[:-1], segment_bytes, chunk_bytes, row[-1]):
                    out.append(r)
                    held += len(r)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=OUT)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=OUT)

    arrow_map(record_plan(pages, min_bytes), write, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parsed(data: bytes):
    """(head fields, block) of each record of one archive file; block is None where the head tells no length or the file ends before it does."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":  # one member or many; what follows the last one is no archive
            z = zlib.decompressobj(31)
            try:
                parts.append(z.decompress(data))
            except zlib.error:
                break
            data = z.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                yield {}, None
            return
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        n = fields.get("Content-Length", "")
        if not n.isdigit():  # no way to the next record
            yield fields, None
            return
        stop = end + 4 + int(n)
        yield fields, data[end + 4 : stop] if stop <= len(data) else None
        at = stop + 4


def number_in(fields: dict, name: str) -> int | None:
    try:
        return int(fields[name]) if fields.get(name) else None
    except ValueError:
        return None


def decoded(fields: dict, block: bytes | None):
    """A row of BACK from a record's first head and its whole block."""
    import hashlib

    number = lambda k: number_in(fields, k)
    told = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if fields.get("WARC-Type") == "revisit":
        return number("X-Page-ID"), "revisit", number("X-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), number("X-Payload-Length"), told, None, True
    payload = None if block is None else dechunked(block)
    if payload is None:
        return number("X-Page-ID"), "response", None, fields.get("WARC-Target-URI"), None, None, None, False
    digest = hashlib.sha1(payload).hexdigest()
    return number("X-Page-ID"), "response", None, fields.get("WARC-Target-URI"), len(payload), digest, payload, digest == told


def rows_out(rows, schema: pa.Schema, of, most: int = 8 << 20):
    """Batches of about `most` bytes."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += of(r)
        if n > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: page_id, record_type, refers_to, target_uri, payload_bytes, payload_digest, payload, valid.

    payload_bytes and payload_digest are computed from the payload read, for a revisit those its head tells of the full
    payload. A record whose segments are not 1 to n, whose total length is wrong, or whose framing is broken comes back
    with a null payload and valid false; so does a continuation without its origin, with null page_id, and what is left of
    an archive that is cut off or holds no WARC heads. Records of other types (warcinfo, request, ...) give no row. Files
    are read twice: for records in one segment, which then need no shuffle, and for segments.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def whole(batches):
        for b in batches:
            for data in b.column(0):
                found = (decoded(f, block) for f, block in parsed(data.as_py()) if f.get("WARC-Type") not in OTHER_TYPES and number_in(f, "WARC-Segment-Number") is None)
                yield from rows_out(found, BACK, lambda r: 200 + len(r[6] or b""))

    def pieces(batches):
        import json

        for b in batches:
            for data in b.column(0):
                found = (
                    (f.get("WARC-Segment-Origin-ID") or f.get("WARC-Record-ID"), number_in(f, "WARC-Segment-Number"), number_in(f, "WARC-Segment-Total-Length"), None if f.get("WARC-Type") == "continuation" else json.dumps(f), block)
                    for f, block in parsed(data.as_py())
                    if number_in(f, "WARC-Segment-Number") is not None
                )
                yield from rows_out(found, PART, lambda r: 300 + len(r[4] or b""))

    def join(batches):
        import json

        for b in batches:
            found = []
            for head, total, parts in zip(*(b.column(k).to_pylist() for k in ("head", "total", "parts")), strict=True):
                block = b"".join(p["block"] or b"" for p in parts)
                good = head is not None and [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and total == len(block)
                found.append(decoded(json.loads(head) if head else {"WARC-Type": "response"}, block if good else None))
            yield from rows_out(found, BACK, lambda r: 200 + len(r[6] or b""))

    segments = arrow_map(files, pieces, PART_SQL).groupBy("origin").agg(F.max("head").alias("head"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    return arrow_map(files, whole, BACK_SQL).unionByName(arrow_map(segments, join, BACK_SQL))


def warc_round_trip(pages: DataFrame, min_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The rows of read_warc() of the archives that write_warc() makes of pages, in the shared folder: one for each row.

    Null html is an empty payload, null ids and urls are written as such (the url as about:blank). Of pages of equal
    payloads of min_bytes or more the one of the largest page_id is the response; rows that repeat it are responses too.
    Very long payloads go out in segments. An empty table gives no rows; columns other than page_id, url and html are
    not read.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes, segment_bytes)
    return read_warc(pages.sparkSession, path)
