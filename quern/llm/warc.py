"""WARC archives with revisit resolution.

Only headers are shuffled by digest: one row per record with its payload's digests and length, aggregated before and after the shuffle,
gives each payload that comes more than once its original (smallest page_id). The records that change by it are joined back by their own
page_id, which no large group of copies shares, and every record becomes a response or a revisit with fresh headers. Spark's text
writer writes the archives, as a WARC record ends in a fixed separator; reading back takes every record by its Content-Length, so
a payload may hold anything, even WARC records. Revisit records are joined to their originals to get length and digest.

A response's block is an HTTP header and the payload; a revisit's is the HTTP header alone, and its WARC headers name the original's record,
URI and date. Record ids are made from page_id and digest, which are the same whenever a task runs again; rows that share a page_id, or
have none, get random ones, and revisits of such an original don't name its record. An archive is one gzip stream: Spark's writer has no
member for each record, and no warcinfo. It has at most ``FILE_BYTES`` of payload on average, and at most ``MOST_BYTES`` if all of its
records were as large as the largest.

Equal payloads are equal in SHA-1, SHA-256 and length.

Defined cases: null html: empty payload; null url: an empty URI; control characters and spaces in a url: percent-encoded;
rows with null page_id: each its own response, referred to by none; rows that repeat the smallest page_id of a payload:
all responses; empty table: empty archive and result; extra columns: ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, maybe_broadcast, stored

END = "\r\n\r\n"
#: The alphabet of base 32 (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes of an archive, on average.
FILE_BYTES = 16 << 20
MOST_BYTES = 1 << 30
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32(hexed: Column) -> Column:
    """Base 32 of 40 hexadecimal digits: ten digits at a time are eight of base 32, written in its alphabet."""
    groups = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolved(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html, n, digest) with refers_to: the original's page_id where the record is a revisit, else null; refers_url: its url;
    own and refers_own: whether page_id, or refers_to, is a key of one row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "sha2": F.sha2("html", 256), "n": F.octet_length("html").cast("long")})
    headers = stored(rows.where("page_id is not null").select("page_id", "url", "sha1", "sha2", "n"), "warc-headers")
    payload = ["sha1", "sha2", "n"]
    first = headers.where(F.col("n") >= least).groupBy(*payload).agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
    first = stored(first.where("copies > 1").select(*payload, F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")), "warc-originals")
    # Few payloads, of any number of copies: broadcast while they are few, else joined by digest, where Spark splits large ones.
    again = headers.join(maybe_broadcast(first), payload).where("page_id > original").select("page_id", "sha1", "original", "original_url").distinct()
    twice = headers.groupBy("page_id").agg(F.count("*").alias("rows")).where("rows > 1").select("page_id")
    twice = stored(twice, "warc-twice")
    again = again.join(maybe_broadcast(twice.select(F.col("page_id").alias("original"), F.lit(True).alias("shared"))), "original", "left")
    notes = stored(again.select(F.col("page_id").alias("__id"), F.col("sha1").alias("__sha1"), "original", "original_url", "shared"), "warc-notes")
    out = rows.join(maybe_broadcast(notes), (F.col("page_id") == F.col("__id")) & (F.col("sha1") == F.col("__sha1")), "left")
    out = out.join(maybe_broadcast(twice.select(F.col("page_id").alias("__twice"))), F.col("page_id") == F.col("__twice"), "left")
    own = F.col("page_id").isNotNull() & F.col("__twice").isNull()
    return out.select("page_id", "url", "html", "n", base32(F.col("sha1")).alias("digest"), F.col("original").alias("refers_to"), F.col("original_url").alias("refers_url"), own.alias("own"), F.col("shared").isNull().alias("refers_own"))


def records(rows: DataFrame) -> Column:
    """A WARC record of each row of resolved(), without the separator that ends it."""
    uri = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", "%0A"), " ", "%20")

    def name(page: Column) -> Column:
        x = F.md5(F.concat_ws(" ", F.lit("page"), page.cast("string"), F.col("digest")))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(x, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    given = lambda test, *xs: F.when(test, F.concat(*xs)).otherwise(F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(F.col("own"), name(F.col("page_id"))).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        given(F.col("page_id").isNotNull(), line("X-Page", F.col("page_id").cast("string"))),
        given(revisit & F.col("refers_own"), line("WARC-Refers-To", name(F.col("refers_to")))),
        given(
            revisit,
            line("WARC-Refers-To-Target-URI", uri(F.col("refers_url"))),
            line("WARC-Refers-To-Date", F.lit(DATE)),
            line("X-Refers-To-Page", F.col("refers_to").cast("string")),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(revisit, F.lit(0)).otherwise(F.col("n")) + len(HTTP)).cast("string")),
        F.lit("\r\n" + HTTP),
    )
    return F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of all pages, later copies of a payload of at least ``least`` bytes as revisits."""
    sizes = pages.agg(F.avg(F.octet_length("html")).alias("mean"), F.max(F.octet_length("html")).alias("most")).first()
    rows = resolved(pages, least)
    (
        rows.select(records(rows).alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, min(50_000, int(FILE_BYTES / (sizes.mean or 1)), MOST_BYTES // (sizes.most or 1))))
        .text(path)
    )


def unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of the content of a plain or gzipped archive, which may have a member for each record."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d, at = zlib.decompressobj(31), 0
        while not d.eof and at < len(data):
            yield d.decompress(data[at : at + step])
            at += step
        if not d.eof:
            raise ValueError("the archive is cut off")
        data = d.unused_data + data[at:]


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record; holds one record and one piece at a time."""
    pieces, held, ended = iter(pieces), bytearray(), False

    def more() -> None:
        nonlocal ended
        got = next(pieces, None)
        if got is None:
            ended = True
        else:
            held.extend(got)

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and not ended:
            more()
        if end < 0:
            if held.strip():
                raise ValueError("a record is cut off")
            return
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        while len(held) < stop + len(END) and not ended:
            more()
        if len(held) < stop:
            raise ValueError("a record is cut off")
        yield head, bytes(held[end + 4 : stop])
        del held[: stop + len(END)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, digest, refers_to, payload) of all records in the archives under path."""
    schema = "page_id long, url string, record_type string, digest string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    number = lambda x: None if x is None else int(x)

    def body(block: bytes) -> bytes:
        """What follows the HTTP header; a block without one is the payload itself."""
        return block[block.index(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows = []
                for h, payload in parsed(unzipped(raw.as_py())):
                    http = h.get("content-type", "").startswith("application/http")
                    rows.append((number(h.get("x-page")), h["warc-target-uri"], h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), number(h.get("x-refers-to-page")), body(payload) if http else payload))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), revisits with their original's length and digest.

    A response's digest is computed from the payload that was read; a header that says otherwise is an error.
    """
    measured = F.octet_length("payload").cast("long")
    digest = base32(F.sha1("payload"))
    checked = F.when(digest == F.col("digest"), digest).otherwise(F.raise_error(F.lit("payload digest differs from the header")))
    heads = records.select("page_id", "record_type", "refers_to", measured.alias("n"), F.when(F.col("record_type") == "response", checked).otherwise(F.col("digest")).alias("digest"))
    heads = stored(heads, "warc-heads")
    responses = heads.where("record_type = 'response'")
    revisits = heads.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("digest").alias("told"))
    originals = responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("told")).agg(F.first("n").alias("payload_bytes"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        responses.withColumnsRenamed({"n": "payload_bytes", "digest": "payload_digest"})
        .select(cols)
        .unionByName(revisits.join(originals, ["refers_to", "told"], "left").withColumnRenamed("told", "payload_digest").select(cols))
    )


def round_trip(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and returns page_records()."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, least)
    return page_records(read(spark, path))


#: round_trip(), in DuckDB.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > original THEN original END AS refers_to
FROM h
"""
