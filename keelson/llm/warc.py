"""WARC archives: write captures, read them back, assemble transactions.

A capture becomes three records: the HTTP request, the response (or a revisit, which has the
headers of its response but no payload) and a metadata record. Request and metadata name the
response in ``WARC-Concurrent-To``. Of captures with equal payloads of at least ``min_revisit`` bytes the one
with the smallest id is the response, the others revisit it.

The payload's digest decides: one pre-aggregated row per digest and task is shuffled, and the smallest id per
digest is joined back on rows without payloads. A WARC record ends in CR LF CR LF, and a record of UTF-8 text
is text, so Spark's text writer with that line separator writes the archives, gzipped, into any file
system Spark knows. Files hold about ``file_bytes`` of payload each, so reading a file as a whole is bounded;
Spark deals the files out to tasks. Assembly joins the three kinds of records by the identifiers read
back; every capture has its own UUID, so no key is hot.

Defined results: a null html is an empty payload; a null id counts as larger than every other, and its page id
is read back as null; rows that share the smallest id of a payload are all responses; a null url is read
back as null; control characters in a url are percent-encoded in the archive. An empty table makes no
archives and gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import parts
from keelson.session import materialize, scratch_path

END = "\r\n\r\n"
VERSION = "WARC/1.1"
VERSIONS = (VERSION, "WARC/1.0")
#: Archives are inflated in pieces of at most so many bytes.
PIECE = 1 << 20
FILE_BYTES = 16 << 20
MIN_REVISIT = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, record_type string, concurrent_to array<string>, page_id long, url string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary, info string"
)


def _decided(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload digest, bare upper-case base32 of the SHA-1."""
    for batch in iterator:
        html = batch.column("_w_html")
        digests = [
            base64.b32encode(hashlib.sha1(h.as_buffer() if h.is_valid else b"").digest()).decode() for h in html
        ]
        names = [n for n in batch.schema.names if n != "_w_html"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], html, pa.array(digests, pa.string())], names=[*names, "_w_html", "_w_digest"]
        )


def warc_records(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit: int = MIN_REVISIT,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Three records (``value``) per row of ``pages``, dealt out to files."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("_w_id"),
        F.col(url).cast("string").alias("_w_url"),
        F.coalesce(F.col(html), F.lit("")).alias("_w_html"),
    )
    hashed = rows.mapInArrow(_decided, "_w_id long, _w_url string, _w_html string, _w_digest string")
    files = parts(rows, "_w_html", file_bytes)
    # The identifiers are drawn before the table is written, so a task that runs again has those of the first time.
    drawn = F.unhex(F.translate(F.expr("uuid()"), "-", ""))
    hashed = materialize(hashed.withColumns({"_w_bytes": F.octet_length("_w_html").cast("long"), "_w_uuid": drawn}), "warc_pages")
    first = hashed.where(F.col("_w_bytes") >= min_revisit).groupBy("_w_digest").agg(F.min("_w_id").alias("_w_first"), F.count(F.lit(1)).alias("_w_n"))
    first = materialize(first.where("_w_n > 1").drop("_w_n"), "warc_first")  # both sides of the join are then plain scans
    rows = hashed.join(first, "_w_digest", "left")
    revisit = F.col("_w_first").isNotNull() & ~F.col("_w_id").eqNullSafe(F.col("_w_first"))
    rows = rows.withColumn("_w_revisit", F.coalesce(revisit, F.lit(False))).repartition(files, "_w_uuid")
    rows = rows.withColumn("_w_uuid", F.regexp_replace(F.lower(F.hex("_w_uuid")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
    id_line = F.when(F.col("_w_id").isNotNull(), F.concat(F.lit("\r\nWARC-Page-ID: "), F.col("_w_id").cast("string"))).otherwise("")
    safe = F.regexp_replace(F.col("_w_url"), r"[\x00-\x1F\x7F]", "%20")
    target = F.when(F.col("_w_url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), safe)).otherwise("")
    name = lambda kind: F.concat(F.lit("<urn:uuid:"), F.col("_w_uuid"), F.lit(f":{kind}>"))
    main = F.concat(F.lit("<urn:uuid:"), F.col("_w_uuid"), F.lit(">"))

    def record(kind, identity, headers, block) -> F.Column:
        return F.concat(
            F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), identity, target, headers,
            F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
        )

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("_w_bytes").cast("string"),
        F.lit(END),
    )
    concurrent = F.concat(F.lit("\r\nWARC-Concurrent-To: "), main)
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_w_digest"))
    refers = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To-Page: "), F.col("_w_first").cast("string"))
    http_type = "\r\nContent-Type: application/http; msgtype="
    response = F.when(
        F.col("_w_revisit"),
        record(F.lit("revisit"), main, F.concat(id_line, digest, refers, F.lit(http_type + "response")), http),
    ).otherwise(
        record(
            F.lit("response"), main, F.concat(id_line, digest, F.lit(http_type + "response")),
            F.concat(http, F.col("_w_html")),
        )
    )
    request = record(
        F.lit("request"), name("request"), F.concat(concurrent, F.lit(http_type + "request")),
        F.concat(F.lit("GET "), F.coalesce(safe, F.lit("/")), F.lit(" HTTP/1.1" + END)),
    )
    metadata = record(
        F.lit("metadata"), name("metadata"), F.concat(concurrent, F.lit("\r\nContent-Type: application/warc-fields")),
        F.concat(F.lit("page-bytes: "), F.col("_w_bytes").cast("string"), F.lit("\r\n")),
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_warc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit: int = MIN_REVISIT,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write three records per row of ``pages`` into gzipped WARC files under ``path``."""
    records = warc_records(pages, page_id, url, html, min_revisit, file_bytes)
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def _inflated(content: memoryview) -> Iterator[bytes]:
    """The text of an archive in bounded pieces: all gzip members one after the other, or the plain file."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield from (bytes(content[a : a + PIECE]) for a in range(0, len(content), PIECE))
        return
    at = 0
    while at < len(content):
        member, given = zlib.decompressobj(wbits=31), b""
        while not member.eof:
            if not given:
                given, at = bytes(content[at : at + PIECE]), min(at + PIECE, len(content))
                if not given:
                    raise ValueError("a gzip member ends early")
            yield member.decompress(given, PIECE)
            given = member.unconsumed_tail
        at -= len(member.unused_data)
        while at < len(content) and not content[at]:  # padding
            at += 1


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Fields (lower-case name to its values, in order) and block of each record."""
    held, done = bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (head := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if head < 0:
            if held.strip():
                raise ValueError(f"not a WARC record at byte {done}: {bytes(held[:40])!r}")
            return
        lines = held[:head].decode("utf-8", "replace").split("\r\n")
        if lines[0] not in VERSIONS:
            raise ValueError(f"not a WARC record at byte {done}: {lines[0][:40]!r}")
        field: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            field.setdefault(name.strip().lower(), []).append(value.strip())
        end = head + 4 + int(field["content-length"][0])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {done} does not end where its length says")
        yield field, bytes(held[head + 4 : end])
        del held[: end + 4]
        done += end + 4


def _row(field: dict[str, list[str]], block: bytes) -> tuple:
    first = lambda name: field.get(name, [None])[0]
    number = lambda x: None if x is None else int(x)
    kind, digest, size, payload, info = field["warc-type"][0], None, None, None, None
    if kind in ("response", "revisit", "resource", "conversion"):
        payload, stated = block, None
        if (first("content-type") or "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", top)
            stated = int(found[1]) if found else None
        given = (first("warc-payload-digest") or "").partition(":")
        digest = given[2] or None
        if kind == "revisit":
            size, payload = stated, None
        else:
            size = len(payload)
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if given[0] == "sha1" and digest != own:
                raise ValueError(f"the payload of {first('warc-record-id')} does not match its digest")
            digest = digest or own
    else:
        info = block.decode("utf-8", "replace")
    page, refers = number(first("warc-page-id")), number(first("warc-refers-to-page"))
    concurrent = field.get("warc-concurrent-to", [])
    return first("warc-record-id"), kind, concurrent, page, first("warc-target-uri"), digest, size, refers, payload, info


def _parse(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
         ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
         ("refers_to", pa.int64()), ("payload", pa.binary()), ("info", pa.string())]
    )
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    for files in iterator:
        for content in files.column("content"):
            rows, held = [], 0
            for field, block in _records(_inflated(memoryview(content.as_buffer()))):
                rows.append(_row(field, block))
                held += len(block) + 500
                if held > (4 << 20):
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path`` (``*.gz``, of one or many gzip members, and ``*.warc``), lengths and given SHA-1 digests verified.

    A header that repeats keeps all its values; a response whose HTTP head states no length has that of its payload, a revisit null; a
    payload without a stated digest gets its SHA-1.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{*.gz,*.warc}").load(path)
    return files.select("content").mapInArrow(_parse, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``page_id``, ``url``, ``response``, ``request``, ``metadata``, and ``others``.

    ``request`` and ``metadata`` are those with the smallest identifier, null if there are none; further ones that name the
    capture (a record can name several) are in ``others``.
    """
    main = records.where(F.col("record_type").isin("response", "revisit")).select(
        "record_id", "page_id", "url",
        F.struct("record_type", "payload_digest", "payload_bytes", "refers_to", "payload").alias("response"),
    )
    beside = records.where(F.col("record_type").isin("request", "metadata"))
    named = beside.select(F.explode("concurrent_to").alias("_w_to"), "record_type", F.struct("record_id", "info").alias("_w_r"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, F.col("_w_r")))).alias(kind)
    grouped = named.groupBy("_w_to").agg(of("request"), of("metadata"))
    first = lambda kind: F.get(kind, F.lit(0)).alias(kind)
    rest = F.concat(F.slice("request", 2, F.greatest(F.size("request"), F.lit(1))), F.slice("metadata", 2, F.greatest(F.size("metadata"), F.lit(1))))
    beside = grouped.select("_w_to", first("request"), first("metadata"), rest.alias("others"))
    return main.join(beside, F.col("record_id") == F.col("_w_to"), "left").drop("_w_to")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = captures(read_warc(spark, path))
    info = F.regexp_extract("metadata.info", r"page-bytes: (\d+)", 1).cast("long")
    return found.select(
        "page_id",
        "response.payload_bytes",
        "response.payload_digest",
        "response.record_type",
        "response.refers_to",
        F.col("request.record_id").isNotNull().alias("has_request"),
        (info == F.col("response.payload_bytes")).alias("metadata_agrees"),
    )


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to,
       TRUE AS has_request, TRUE AS metadata_agrees
FROM f
"""
