"""WARC archives with revisit resolution (operator 10).

``plan_records`` shuffles only headers (row, id, digest, length) by payload
digest: of equal payloads of at least ``min_bytes`` bytes the one with the
smallest id is the response, all others become revisit records that are joined
to it.  ``write_archive`` gives every record fresh headers and deals the records
out to as many files as hold about FILE_BYTES of payload each.  Every record is
a gzip member of its own, so a reader can start at any record.

The files are written by Spark's text writer, into any file system Spark can
write to.  The writer ends each row with a separator, which is made part of the
format: without compression a record's block ends in CRLF CRLF; a gzip member
ends in the most significant byte of its length, which is 0 for records below
16 MB, so this byte is the separator (a larger record is followed by an empty
member, which ends in 0).

``read_archive`` unpacks and parses a file piece by piece by Content-Length (a
payload may contain anything, record separators included), and holds one record
at a time.  It reads archives of any origin: every record comes out with its
type, headers that are missing are null, and where a file breaks off or is damaged
one row of type ``broken`` stands for the rest of it.  ``resolve`` joins
revisit records back to the responses they refer to, by record id or, where
that is missing, by target URI and date.

Payloads count as equal when their SHA-256 and length are equal; the headers
carry the customary base32 SHA-1.

Defined results: a null payload is written as an empty one; a null URL as
``about:blank``; control characters of a URL are percent-encoded so that they
cannot break a header; rows with a null id never win over rows with one, and of
repeated rows the first of the input is the response.  A record may be as large
as a row can be; record ids differ between any two archives.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, table, with_row_ids
from .textnp import trim

#: Payload bytes that a file of an archive holds on average, and records at most.
FILE_BYTES, FILE_RECORDS = 32 << 20, 16_384
#: Partitions that an archive is dealt out to at most; beyond, each writes several files.
TASKS = 16_384
#: Bytes that are unpacked at a time.
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
READ_SCHEMA = "record_id string, record_type string, target_uri string, date string, source_id long, payload_bytes long, payload_digest string, refers_to_record string, refers_to_uri string, refers_to_date string, intact boolean"


def base32_of_hex(sha1: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal string, 20 bits at a time."""
    parts = [F.translate(F.lpad(F.conv(F.substring(sha1, 1 + 5 * k, 5), 16, 32), 4, "0"), _HEX32, _BASE32) for k in range(8)]
    return F.concat(*parts)


def record_id(source: Column, archive: str) -> Column:
    """A urn:uuid made from the hash of the archive's own id and the row's; the same when a lost part is written again."""
    h = F.md5(F.concat(F.lit(f"record {archive} "), source.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if k > 1 else []) + [F.substring(h, k, n)]], F.lit(">"))


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html, _row): its digest, type and,
    for revisits, the row, id and URL of the response."""
    payload = F.coalesce("html", F.lit(""))
    headers = pages.select("_row", "page_id", "url", F.octet_length(payload).alias("bytes"), F.sha1(payload.cast("binary")).alias("sha1"), F.sha2(payload.cast("binary"), 256).alias("key"))
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("_row").alias("c"), F.col("url").alias("d"))
    first = headers.where(F.col("bytes") >= min_bytes).groupBy("key", "bytes").agg(F.min(order).alias("first"))
    revisit = F.coalesce(F.col("first.c") != F.col("_row"), F.lit(False))
    return headers.join(first, ["key", "bytes"], "left").select(
        "_row", "bytes", base32_of_hex(F.col("sha1")).alias("digest"), revisit.alias("revisit"), *[F.when(revisit, F.col(f"first.{f}")).alias(n) for f, n in (("c", "to_row"), ("d", "to_url"))]
    )


def _uri(url: Column) -> Column:
    clean = F.coalesce(url, F.lit("about:blank"))
    for c in range(0x21):
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}")) if c in (0x09, 0x0A, 0x0D, 0x20) else clean
    return F.regexp_replace(clean, r"[\x00-\x1F\x7F]", "")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\r\n{name}: "), value)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, which is 0."""
    for b in batches:
        out, held = [], 0
        for record in b.column(0):
            data = record.as_py()
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(data) + packer.flush()
            if member[-1]:
                member += zlib.compressobj(6, zlib.DEFLATED, 31).flush()
            out.append(member[:-1])
            held += len(member)
            if held > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
        trim()


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None, compression: str = "gzip", archive: str | None = None) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to the folder ``path``.

    ``date``: the records' WARC-Date (now, if not given); ``archive``: the id that record ids are made from (a new one).
    """
    if compression not in ("gzip", "none"):
        raise ValueError("compression is gzip or none")
    archive, date = archive or uuid.uuid4().hex, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = with_row_ids(pages.select("page_id", "url", "html"))
    planned = materialize(plan_records(pages, min_bytes), "records")
    sizes = planned.agg(F.sum(F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    total, files = sizes["n"] or 0, -(-((sizes["n"] or 0) + 1) // FILE_BYTES)
    in_file = FILE_RECORDS if files <= TASKS else max(1, min(FILE_RECORDS, sizes["rows"] * FILE_BYTES // total))
    files = min(files, TASKS)
    payload = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        _line("WARC-Record-ID", record_id(F.col("_row"), archive)), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", _uri(F.col("url"))),
        F.coalesce(_line("WARC-Source-ID", F.col("page_id").cast("string")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), _line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    revisit = F.concat(
        head, _line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", record_id(F.col("to_row"), archive)), _line("WARC-Refers-To-Target-URI", _uri(F.col("to_url"))),
        _line("WARC-Refers-To-Date", F.lit(date)), _line("Content-Length", F.lit("0")), F.lit(END),
    )
    response = F.concat(head, _line("Content-Length", (F.col("bytes") + F.octet_length(http)).cast("string")), F.lit(END), http, payload)
    records = pages.repartition(files, "_row").join(planned.hint("merge"), "_row").select(F.when(F.col("revisit"), revisit).otherwise(response).alias("value"))
    separator = END
    if compression == "gzip":
        packed = records.select(F.concat("value", F.lit(END)).cast("binary").alias("record")).mapInArrow(_members, "member binary")
        records, separator = packed.select(F.col("member").cast("string").alias("value")), "\0"
    records.write.option("lineSep", separator).option("maxRecordsPerFile", in_file).text(path)


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The content of an archive file, gzip (any number of members) or plain, in pieces."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), CHUNK):
            yield bytes(view[at : at + CHUNK])
        return
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.unconsumed_tail
            if not piece:
                if at >= len(data):
                    raise ValueError("the archive file ends inside a gzip member")
                piece, at = view[at : at + (CHUNK >> 4)], at + (CHUNK >> 4)
            yield member.decompress(piece, CHUNK)
        at = min(at, len(data)) - len(member.unused_data)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and blocks of an archive file, gzip or plain."""
    pieces, held = _unpacked(data), bytearray()

    def wanted(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    done = 0
    while wanted(7):
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no record starts at byte {done}")
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not wanted(looked + 1):
                raise ValueError(f"the headers at byte {done} do not end")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit() and len(length) < 16):
            raise ValueError(f"the record at byte {done} has no length")
        size = end + 4 + int(length)
        if not wanted(size):
            raise ValueError(f"the record at byte {done} is cut off")
        yield headers, bytes(held[end + 4 : size])
        wanted(size + 4)
        while held[size : size + 2] == b"\r\n":  # two line ends by the standard; some writers leave more or none
            size += 2
            wanted(size + 2)
        done += size
        del held[:size]


def payload(headers: dict[str, str], block: bytes) -> memoryview:
    """What a record carries: of an HTTP message what follows its header (nothing, if that does not end), else the block."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return memoryview(block)
    end = block.find(b"\r\n\r\n")
    return memoryview(block)[end + 4 if end >= 0 else len(block) :]


def has_digest(body: memoryview, digest: str | None) -> bool | None:
    """Whether a payload has a digest ``algorithm:value`` in base32 or hexadecimal; null for other algorithms and without one."""
    algorithm, _, value = (digest or "").partition(":")
    if algorithm.lower() not in ("md5", "sha1", "sha256", "sha512") or not value:
        return None
    own = hashlib.new(algorithm.lower(), body).digest()
    return value.upper().rstrip("=") in (b32encode(own).decode().rstrip("="), own.hex().upper())


def _row(h: dict[str, str], block: bytes) -> tuple:
    digest, source = h.get("warc-payload-digest"), h.get("warc-source-id", "")
    source_id = int(source) if source.lstrip("-").isdigit() and source.isascii() and len(source) < 19 else None
    size = intact = None
    if h.get("warc-type") in ("response", "resource"):
        body = payload(h, block)
        size, intact = len(body), has_digest(body, digest)
    of = lambda n: h.get(n)
    return (of("warc-record-id"), of("warc-type"), of("warc-target-uri"), of("warc-date"), source_id, size, digest and digest.removeprefix("sha1:"), of("warc-refers-to"), of("warc-refers-to-target-uri"), of("warc-refers-to-date"), intact)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in READ_SCHEMA.split(", ")]
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    for b in batches:
        for content in b.column(0):
            rows = []
            try:
                for h, block in records_of(content.as_py()):
                    rows.append(_row(h, block))
                    if len(rows) >= 1024:
                        yield flush(rows)
                        rows = []
            except (ValueError, zlib.error):  # the rest of this file cannot be read
                rows.append((None, "broken", *[None] * 8, False))
            if rows:
                yield flush(rows)
            trim()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archive in ``path``; ``intact``: the payload has the digest its header names."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, READ_SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with payload_bytes, intact and refers_to (a source id) of revisits taken from the response they refer to.

    A revisit names it by record id or, without one, by target URI and date (of several such responses the one with the smallest id
    counts); ``refers_to_record`` is then filled in.  A revisit whose response is not there, or that names none, keeps nulls.  Records of
    other types stay as they are.
    """
    others = records.where("record_type IS NULL OR record_type <> 'revisit'")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "intact")
    responses = records.where("record_type IN ('response', 'resource') AND record_id IS NOT NULL")
    found = F.struct("record_id", F.col("source_id").alias("refers_to"), "payload_bytes", "intact", F.col("payload_digest").alias("_digest"))
    by_id = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min(found).alias("_t"))
    by_place = responses.where("target_uri IS NOT NULL AND date IS NOT NULL").groupBy(F.col("target_uri").alias("refers_to_uri"), F.col("date").alias("refers_to_date")).agg(F.min(found).alias("_t"))
    joined = revisits.where("refers_to_record IS NOT NULL").join(by_id, "refers_to_record", "left").unionByName(revisits.where("refers_to_record IS NULL").join(by_place, ["refers_to_uri", "refers_to_date"], "left"))
    same = F.coalesce(F.col("_t._digest") == F.col("payload_digest"), F.lit(True))
    joined = joined.select(
        *[c for c in revisits.columns if c != "refers_to_record"], F.coalesce("refers_to_record", "_t.record_id").alias("refers_to_record"),
        F.col("_t.refers_to").alias("refers_to"), F.col("_t.payload_bytes").alias("payload_bytes"), (F.col("_t.intact") & same).alias("intact"),
    )
    return others.withColumn("refers_to", F.lit(None).cast("long")).unionByName(joined)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return resolve(read_archive(spark, path)).select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


QUERIES = {"op10_warc": op10_warc}
ORACLE = {
    "op10_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h,
         min(page_id) OVER (PARTITION BY body) AS first_id
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
       true AS intact
FROM d
"""
}
