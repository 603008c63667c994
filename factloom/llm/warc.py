"""WARC archives: a writer of one gzip member per record, and a reader that splits the files.

Reading tasks get byte ranges.  Each looks for the gzip magic in its range, takes a place for a member
only if what it decodes begins with a record's header, and owns the records that start inside; a record
is read to its end, also beyond the range.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.common import configure, read, scratch, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 18


def with_first_copies(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Rows (id, url, html) with _bytes, _digest and _first: the smallest id of an equal payload of at least
    ``least_bytes``, where that is another one's.  A null id revisits if any equal payload has an id."""
    sized = pages.withColumns({"_bytes": F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"), "_digest": F.sha2(F.coalesce("html", F.lit("")), 256)})
    groups = sized.where(F.col("_bytes") >= least_bytes).groupBy("_digest").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = sized.join(written(groups, "payloads"), "_digest", "left")
    return out.withColumn("_first", F.when(~F.col("id").eqNullSafe(F.col("_first")), F.col("_first")))


def page_urn(page_id, digest: str) -> str:
    """Name of the response with this id and payload, by which revisits find it."""
    return f"urn:page:{page_id}:{digest[:16]}"


def record(page_id, url: str | None, html: str | None, digest: str, first, name: str, date: str) -> bytes:
    payload = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = page_urn(page_id, digest) if first is None and page_id is not None else f"urn:record:{name}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=%-._~"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is None:
        block += payload
    else:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{page_urn(first, digest)}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row to ``folder`` (a URI that executors reach); returns (file, bytes, records).

    The payload is the html in UTF-8 (null: empty).  Of equal payloads of at least 100 bytes the smallest
    id is a response and the others revisit it; shorter ones are all responses.  Ids are whole numbers; rows without
    id are written without one, and revisit if an equal payload has an id; rows that repeat id and payload are
    responses of one name.  Every task writes one file under another name and moves it in place when it is whole,
    so a task that runs again replaces its file.
    """
    spark = pages.sparkSession
    configure(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = with_first_copies(rows).select("id", "url", "html", "_digest", "_first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        where, top = fs.FileSystem.from_uri(folder)
        where.create_dir(top, recursive=True)
        part = f"part-{context.partitionId():06d}"
        path, open_path = f"{top}/{part}.warc.gz", f"{top}/_open-{part}-{context.taskAttemptId()}"
        size = n = 0
        out = None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(5))):
                out = out or where.open_output_stream(open_path)
                page_id, url, html, digest, first = (v.as_py() for v in row)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, html, digest, first, f"{part}-{n}", date)) + pack.flush()
                out.write(data)
                size += len(data)
                n += 1
        if out:
            out.close()
            where.move(open_path, path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{part}.warc.gz"]), pa.array([size]), pa.array([n])], names=["file", "bytes", "records"])

    return written(rows.mapInArrow(write, "file string, bytes long, records long"), "archives")


def members(file, begin: int, end: int, size: int) -> Iterator[bytes]:
    """Contents of the record members that start in [begin, end) of an open file of ``size`` bytes."""
    file.seek(begin)
    data = file.read(min(end + len(MAGIC) - 1, size) - begin)
    at = 0
    while (at := data.find(MAGIC, at)) >= 0 and begin + at < end:
        unpack = zlib.decompressobj(31)
        try:
            head = data[at : at + 4096]
            if len(head) < 4096:
                file.seek(begin + at)
                head = file.read(4096)
            is_record = unpack.decompress(head, len(VERSION)).startswith(VERSION)
        except zlib.error:
            is_record = False
        if not is_record:
            at += 1
            continue
        unpack, parts, next_at = zlib.decompressobj(31), [], at
        while not unpack.eof:
            raw = data[next_at : next_at + STEP]
            if not raw:
                file.seek(begin + next_at)
                raw = file.read(STEP)
                if not raw:
                    raise ValueError(f"a record at {begin + at} ends too soon")
            parts.append(unpack.decompress(raw))
            next_at += len(raw)
        at = next_at - len(unpack.unused_data)
        yield b"".join(parts)


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers of a record, the HTTP head and the payload of its block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode().lower()] = value.strip().decode()
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def read_archives(files: DataFrame, split: int = 1 << 24) -> DataFrame:
    """Records of the archives in ``files`` (file, bytes), read by ranges of ``split`` bytes.

    (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload): digest and size are
    those of the full payload, which a revisit names and does not hold.  Every record gives a row: repeated ones as
    often as they were written, those without id with a null page_id.
    """
    configure(files.sparkSession)
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("begin"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
                where, path = fs.FileSystem.from_uri(name)
                with where.open_input_file(path) as file:
                    for content in members(file, begin, min(begin + split, size), size):
                        headers, http, payload = parse(content)
                        kind = headers["warc-type"]
                        first = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]+>", headers.get("warc-refers-to", ""))
                        told = re.search(rb"(?i)^content-length: *(\d+)", http, re.M)
                        rows.append({
                            "page_id": int(headers["page-id"]) if "page-id" in headers else None, "url": headers.get("warc-target-uri"), "record_type": kind,
                            "refers_to": int(first[1]) if first else None, "payload_bytes": len(payload) if kind == "response" else int(told[1]),
                            "payload_digest": headers["warc-payload-digest"].removeprefix("sha256:"), "payload": payload if kind == "response" else None,
                        })
                        held += len(payload)
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return ranges.repartition(int(n), "file", "begin").mapInArrow(scan, kinds)


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back."""
    pages = read(spark, sf_dir, "pages")
    return read_archives(write_archives(pages, scratch(spark, "warc")))
