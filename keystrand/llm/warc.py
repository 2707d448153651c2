"""WARC archives: deduplicating writer, and a reader that reassembles segmented records.

Writer.  Every page is a record with an HTTP block whose body is in chunked transfer framing.  Blocks longer than
``segment_bytes`` become a first segment and ``continuation`` records (origin id, segment number, total length on the last).
Of pages with equal payloads the one with the largest id is the response; the others are revisits without a body.
Each record is a gzip member of its own.  A payload may be that of any share of all pages: see :func:`_placed`.

Reader.  Tasks stream the archives of the manifest.  Whole records are decoded on the spot; segments are grouped by origin
id, put in order, checked for gaps and against the total length, joined, and then decoded.

Edge cases: null html is an empty payload; repeated rows of the response's page are all responses, each with a record id of
its own (their ids differ in the URN's r-component, which does not count for equality); a null page id is only a response
if all pages of its payload have null ids, and refers_to is then null; very long pages are as many segments as they need;
of ties (the largest page id in several rows) all are responses; an empty table writes no archive; other columns, whatever
their names, are not read; bad lengths, gaps and digests raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import arrow, delete, plain, scratch, table
from .archives import Rolling, filesystem

SEGMENT_BYTES = 64 << 10
CHUNK = 8 << 10
ARCHIVE_BYTES = 32 << 20
HOT = 4096  # payloads that a 4096th of all pages share
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """Body of chunked transfer framing (chunk extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


def page_urn(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def _page_id(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").partition("?+")[0].rpartition(":")[2]
    return None if tail in ("", "none") else int(tail)


def page_records(page_id, url, payload: bytes | None, size: int, digest: str, head, unique: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page; without a payload that is a revisit of ``head``."""
    own = f"<{page_urn(page_id)}?+w={unique}>"
    common = {"WARC-Record-ID": own, "WARC-Target-URI": url and url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if payload is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        yield record("revisit", common | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{page_urn(head)}>"}, block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", common, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for n, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        last = {"WARC-Segment-Total-Length": len(block)} if n == len(cuts) else {}
        if n == 1:
            yield record("response", common | {"WARC-Segment-Number": 1}, part)
        else:
            yield record("continuation", {"WARC-Record-ID": f"<{page_urn(page_id)}?+w={unique}-{n}>", "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n} | last, part)


def _placed(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, size, digest, head) of every page; html is null for revisits, head is null for lone payloads.

    Pages meet their payload's head by digest.  Digests that hold a 4096th of all pages or more, of which there are at most
    so many, are broadcast: their pages know their head before the shuffle, leave their bodies behind and are dealt by id.
    """
    rows = plain(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    shared, _ = table(rows.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    large = F.col("n") * HOT >= F.lit(pages.count())
    hot = shared.where(large).select("digest", F.struct("head").alias("_hot"))
    cold = shared.where(~large).select(F.col("digest").alias("_key"), F.struct("head").alias("_cold"))
    spread = F.concat_ws("/", "digest", F.xxhash64("page_id", "url", F.spark_partition_id()))
    body = F.when(F.col("_hot").isNull() | F.col("page_id").eqNullSafe(F.col("_hot.head")), F.col("html"))
    early = rows.join(F.broadcast(hot), "digest", "left").select("page_id", "url", body.alias("html"), F.octet_length("html").alias("size"), "digest", "_hot", F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(spread).alias("_key"))
    found = early.join(cold.hint("merge"), "_key", "left").withColumn("_head", F.coalesce("_hot", "_cold"))
    revisit = F.col("_head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_head.head"))
    return found.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "digest", F.col("_head.head").alias("head"))


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of pages (page_id, url, html); the manifest (uri, bytes, records), itself kept in the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, task, n = Rolling(folder, ".warc.gz", archive_bytes), TaskContext.get().partitionId(), 0
        for batch in batches:
            for page_id, url, html, size, digest, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                for r in page_records(page_id, url, None if html is None else html.encode(), size, base32(bytes.fromhex(digest)), head, f"{task}-{n}", segment_bytes):
                    out.add(r)
                if out.full:
                    out.close()
        out.close()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out.files, strict=True) if out.files else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["uri", "bytes", "records"])

    to = f"{folder.rstrip('/')}/_manifest"
    arrow(_placed(pages), run, "uri string, bytes long, records long").write.parquet(to)
    return pages.sparkSession.read.parquet(to)


def stream_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip-per-record archive."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as source:
        held = b""
        z, plain_ = zlib.decompressobj(31), []
        while True:
            if not held:
                held = source.read(1 << 20)
                if not held:
                    break
            plain_.append(z.decompress(held))
            held = z.unused_data
            if z.eof:
                yield _record(b"".join(plain_))
                z, plain_ = zlib.decompressobj(31), []
        if plain_ and any(plain_):
            raise ValueError(f"{uri} ends within a record")


def _record(whole: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return headers, rest[:size]


def decode(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS from a whole record's headers and block."""
    http, _, body = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    page, url = _page_id(headers["warc-record-id"]), headers.get("warc-target-uri")
    if kind == "revisit":
        return page, url, kind, _page_id(headers["warc-refers-to"]), int(fields["content-length"]), digest, None
    payload = unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    if base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"payload digest of {headers['warc-record-id']} is wrong")
    return page, url, kind, None, len(payload), digest, payload


_KINDS = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
_PART = "origin string, number int, total long, headers string, block binary"


def _rows(rows: list[tuple], parts: list[tuple]) -> pa.RecordBatch:
    """Whole records and segments side by side; a row has one or the other."""
    n, m = len(rows), len(parts)
    left = [[r[i] for r in rows] + [None] * m for i in range(7)]
    right = [[None] * n + [p[i] for p in parts] for i in range(5)]
    kinds = (*_KINDS, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
    return pa.record_batch([pa.array(x, k) for x, k in zip([*left, *right], kinds, strict=True)], [c.split()[0] for c in f"{RECORDS}, {_PART}".split(", ")])


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Rows of RECORDS of all pages in the archives of the folder's manifest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, parts, size = [], [], 0
                for headers, block in stream_records(uri):
                    if headers["warc-type"] == "continuation" or "warc-segment-number" in headers:
                        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                        text = "\r\n".join(f"{k}: {v}" for k, v in headers.items()) if headers["warc-segment-number"] == "1" else None
                        total = headers.get("warc-segment-total-length")
                        parts.append((origin, int(headers["warc-segment-number"]), total and int(total), text, block))
                    else:
                        r = decode(headers, block)
                        rows.append(r if with_payload else (*r[:-1], None))
                    size += len(block)
                    if size > 4 << 20:
                        yield _rows(rows, parts)
                        rows, parts, size = [], [], 0
                yield _rows(rows, parts)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segments in batch.column(0).to_pylist():
                if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                    raise ValueError("segments are missing or repeated")
                block = b"".join(s["block"] for s in segments)
                if segments[-1]["total"] != len(block):
                    raise ValueError("segments don't add up to the total length")
                headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in segments[0]["headers"].split("\r\n"))
                r = decode(headers, block)
                yield pa.record_batch([pa.array([v], k) for v, k in zip(r if with_payload else (*r[:-1], None), _KINDS, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])

    manifest = spark.read.parquet(f"{folder.rstrip('/')}/_manifest").select("uri")
    files = manifest.count()
    read, _ = table(arrow(manifest.repartition(max(1, min(files, 4096))), scan, f"{RECORDS}, {_PART}"), "records")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    segments = read.where("origin is not null").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "total", "headers", "block"))).alias("s")).select("s")
    return read.where("origin is null").select(*names).unionByName(arrow(segments, join, RECORDS))


def archive_pages(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the pages and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archives(pages, folder, segment_bytes)
    out = read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    delete(spark, folder)
    return out
