"""Web archives: one gzip member per record, written and read sequentially.

The writer turns rows into response records, or into revisit records that name the
response with the same payload. The reader inflates member after member with zlib,
cuts the block by its content length, and verifies block and payload digests.

Defined results: a null payload is empty; a null id or address is written as an empty
field and read back as null; an address is written as it is given, but for line breaks,
which come back as %0D and %0A; repeated rows become records of their own, and of equal
payloads every row that carries the largest id is a response; a table without rows
gives no archive. Damaged records raise.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagekit.llm.common import table, text_of
from passagekit.llm.files import create, new_name, open_stream, task_each
from passagekit.plans.registry import query
from passagekit.scale import shared_dir, stage

#: Records with payloads of at least so many bytes may become revisits.
MIN_REVISIT_BYTES = 0

#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 256 << 20

READ_BYTES = 1 << 18

# Fixed values of the archive format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(record_id: str | None) -> str:
    return "" if record_id is None else f"<urn:record:{quote(record_id, safe='')}>"


def _from_uri(value: str) -> str | None:
    return unquote(value[len("<urn:record:"):-1]) if value else None


def record_bytes(record_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member holding one record."""
    head = HTTP % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _uri(record_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    header = b"\r\n".join([VERSION, *(f"{name}: {value}".encode() for name, value in fields)])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(header + b"\r\n\r\n" + block + END) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    begun = False
    while True:
        data = rest or stream.read(READ_BYTES)
        rest = b""
        if not data:
            if begun:
                raise ValueError("the archive ends inside a member")
            return
        begun = True
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            rest = inflate.unused_data
            inflate, parts, begun = zlib.decompressobj(31), [], False


def parse_record(member: bytes) -> dict:
    """Fields of one record; raises if its frame or a digest is wrong."""
    header, _, after = member.partition(b"\r\n\r\n")
    lines = header.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines[1:])
    length = int(fields["Content-Length"])
    block, end = after[:length], after[length:]
    if len(block) != length or end != END:
        raise ValueError("the record does not fill its frame")
    if fields["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
        raise ValueError("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    full = int(next(h for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:")).split(b":")[1])
    if kind == "response" and (len(payload) != full or sha1_base32(payload) != digest):
        raise ValueError("wrong payload digest")
    return {
        "record_id": _from_uri(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"] or None,
        "record_type": kind,
        "payload_digest": digest,
        "payload_bytes": full,
        "refers_to": _from_uri(fields.get("WARC-Refers-To", "")),
        "payload": payload if kind == "response" else None,
    }


def with_first_copies(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` with ``_original``: for a copy, the largest id that has its payload.

    Only payloads that occur more than once are joined back; a payload that a third
    of the rows share is a hot join key, whose partition Spark splits.
    """
    data = text_of(payload_col).cast("binary")
    digest = F.when(F.octet_length(data) >= min_bytes, F.sha2(data, 256))
    keyed = pages.withColumn("_digest", digest)
    several = (
        keyed.where(F.col("_digest").isNotNull()).groupBy("_digest")
        .agg(F.max(id_col).alias("_largest"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_largest").isNotNull()).select("_digest", "_largest")
    )
    joined = keyed.join(several, "_digest", "left")
    copy = ~F.col(id_col).eqNullSafe(F.col("_largest")) & F.col("_largest").isNotNull()
    return joined.withColumn("_original", F.when(copy, F.col("_largest"))).drop("_digest", "_largest")


def write_archives(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, label: str = "warc",
    min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write ``pages`` as archives below the shared folder: (path, records)."""
    folder = shared_dir(pages.sparkSession, label)
    rows = with_first_copies(
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload")),
        "id", "payload", min_bytes,
    ).select(
        F.col("id").cast("string"), "url", text_of("payload").cast("binary").alias("payload"),
        F.col("_original").cast("string").alias("original"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        size = count = 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for record in zip(*(batch.column(i).to_pylist() for i in range(4))):
                identity, url, payload, original = record
                if out is None:
                    path, size, count = new_name(folder, ".warc.gz"), 0, 0
                    out = create(path)
                data = record_bytes(identity, url, payload, original, original is not None)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["path", "records"]
        )

    # Stored, so that reading again never writes again.
    return stage(rows.mapInArrow(run, "path string, records long"), f"{label}-list")


def read_archives(listed: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives in ``listed`` (path, records), verified.

    One archive is read by one task, from its start, with bounded memory.
    """
    arrow = pa.schema([
        ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, count = [], 0, 0
                with open_stream(path) as stream:
                    for member in members(stream):
                        rows.append(parse_record(member))
                        count, size = count + 1, size + len(member)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                if count != expected:
                    raise ValueError(f"{path}: {count} records, {expected} were written")
                yield pa.RecordBatch.from_pylist(rows, arrow)

    spread = task_each(listed.select("path", "records"))
    return spread.mapInArrow(run, RECORD)


_NUMBER = "CAST('0x' || substr(digest, {0}, 5) AS BIGINT)"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({0} >> {1}) & 31 AS INTEGER) + 1, 1)"
_BASE32 = " || ".join(_LETTER.format(_NUMBER.format(5 * k + 1), shift) for k in range(8) for shift in (15, 10, 5, 0))

SQL = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS original FROM hashed)
SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM largest
"""


@query("op7_warc", SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say, read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = read_archives(write_archives(pages, "page_id", "url", "html"))
    return records.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
