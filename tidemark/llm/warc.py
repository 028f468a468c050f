"""WARC: archives written in the shared folder and read back sequentially.

Each record is a gzip member of its own. The reader streams a file in blocks through incremental zlib decompression,
takes a new decompressor at each member's end, frames the block by Content-Length and verifies the digests; its memory
is bounded by one record. Payloads of ``LEAST`` bytes or more that occur again are written once, as the response of the
largest page id; the others are revisit records that refer to it and keep the payload's digest and length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, shared_path

LEAST = 1000
BLOCK = 1 << 16
#: An archive is closed at this size.
ARCHIVE = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _header_safe(url: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record(kind: str, number: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{number}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header_safe(url)}",
        f"WARC-Payload-Digest: {_base32(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join([*head, "", ""]).encode()) + squeeze.compress(block + b"\r\n\r\n") + squeeze.flush()


def members(stream, block: int = BLOCK):
    """The uncompressed bytes of one gzip member after the other; a member cut short raises ``ValueError``."""
    data = b""
    while data or (data := stream.read(block)):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not data and not (data := stream.read(block)):
                raise ValueError("the archive ends within a gzip member")
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> dict:
    """The record's type, ids, payload length, digest and payload; wrong framing or digests raise ``ValueError``."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not sep or not version.startswith("WARC/") or "content-length" not in fields:
        raise ValueError("not a WARC record")
    size = int(fields["content-length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the block isn't as long as Content-Length says")
    if _base32(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
        raise ValueError("the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response" and (len(payload) != length or _base32(hashlib.sha1(payload).digest()) != fields["warc-payload-digest"]):
        raise ValueError("the payload's length or digest is wrong")
    number = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
    return {
        "record_type": fields["warc-type"], "page_id": number(fields["warc-record-id"]), "refers_to": number(fields.get("warc-refers-to")), "url": fields["warc-target-uri"],
        "payload_bytes": length, "payload_digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), "payload": payload if fields["warc-type"] == "response" else None,
    }


def decide(pages: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, url, html, kind, refers_to): payloads meet by SHA-256 with partial sums; a hot payload's rows may be split in the join."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    return rows.join(first, "sha", "left").select("id", "url", "html", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder``; (path, records, bytes) of the archives, made when it is run.

    A task that runs again writes other archives; those that count are the ones returned. Null html is an empty
    payload. Rows that share the largest id of a payload are all responses; rows with a null id are numbered "".
    """

    def scan(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, count, size, done = None, "", 0, 0, []
        for b in batches:
            for i, url, html, kind, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(path), 0, 0
                member = record(kind, "" if i is None else str(i), url, html, None if to is None else str(to))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return decide(pages, id_col, text_col, least).mapInArrow(scan, "path string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in column ``path``, read sequentially, one archive a task at a time."""

    def scan(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        kinds |= {"payload": pa.binary()} if payloads else {}

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path) as stream:
                    for m in members(stream):
                        r = parse(m)
                        rows.append(r | {k: int(r[k]) if r[k] else None for k in ("page_id", "refers_to")})
                        size += len(m) if payloads else 500
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    return archives.select("path").mapInArrow(scan, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = LEAST, payloads: bool = False) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back, one row per record.

    The list of archives is itself written to the shared folder, so reading never writes again. An empty table
    has no record.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file:///") else folder
    listed = shared_path(spark, "warc-list")
    write_archives(pages, folder, id_col, text_col, least).write.parquet(listed)
    archives = spark.read.schema("path string, records long, bytes long").parquet(listed)
    n = max(1, archives.count())
    return read_archives(archives.repartition(min(n, 10_000)), folder, payloads)
