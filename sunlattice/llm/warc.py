"""Revisit resolution for WARC archives.

Headers (id, address, payload digest, length), never payloads, are shuffled by digest; the smallest page id of a digest
becomes the response and the others are joined to it as revisits. Payloads move once, keyed by page id and digest, so
a digest with a third of all rows deals out only headers, and the join on the digest is one that Spark can split.
Archives go through Spark's own text writer (a record is one value, the record end is the line separator), so they
land in any store that Spark can write to, with task commit and retry. They are read as they were written: the text
source gives what stands between record ends, a task puts the stream together again and parses a record at a time, so it
holds one record and one Arrow batch, however large an archive is.
"""

from __future__ import annotations

import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.scratch import cut, new_path

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one archive at most, which bounds the work of a reader's task.
RECORDS_PER_FILE = 10_000
#: Rows of a batch that a reader returns.
BATCH_ROWS = 4_096


def base32_of_hex(digest: Column) -> Column:
    """Base32 (RFC 4648) of a 40-digit hexadecimal SHA-1: five bytes at a time are eight base-32 digits."""
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">"),
    )


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row a page: page_id, url, digest (hex), payload_bytes, record_type, payload (responses), original_id,
    original_url (revisits).

    Of pages with equal payloads of at least `min_bytes` bytes, that with the smallest page_id (and then url) is the
    response; rows that repeat its page_id are responses too. Null html is an empty payload, a null page_id comes after
    all others, and an empty table gives an empty one. Other columns are dropped.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select(
        "page_id",
        "url",
        F.sha1(body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        body.alias("payload"),
    )
    long_enough = F.col("payload_bytes") >= min_bytes
    heads = full.where(long_enough).drop("payload")
    first = (
        heads.groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("f"))
        .select("digest", F.col("f.page_id").alias("original_id"), F.col("f.url").alias("original_url"))
    )
    none = {"original_id": F.lit(None).cast(dict(pages.dtypes)["page_id"]), "original_url": F.lit(None).cast("string")}
    own = first.select(F.col("digest").alias("d"), F.col("original_id").alias("o"))
    originals = full.join(own, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("o")), "left_semi")
    again = heads.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("original_id")))
    columns = ["page_id", "url", "digest", "payload_bytes", "payload", "record_type", "original_id", "original_url"]
    responses = originals.where(long_enough).withColumns({"record_type": F.lit("response"), **none})
    short = full.where(~long_enough).withColumns({"record_type": F.lit("response"), **none})
    revisits = again.withColumns({"record_type": F.lit("revisit"), "payload": F.lit("")})
    found = responses.select(columns).unionByName(revisits.select(columns))
    return found.unionByName(short.select(columns)) if min_bytes > 0 else found


def write_archives(resolved: DataFrame, path: str, date: str | None = None) -> None:
    """Write `resolve`d pages as gzip-compressed WARC/1.1 files below `path`, each record with fresh headers."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    target = F.coalesce(F.col("url"), F.lit("urn:unknown"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.col("payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(target)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest"))),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.when(
            revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("original_id"), F.col("digest")))
        ),
        F.when(
            revisit,
            F.concat(
                F.lit("WARC-Refers-To-Target-URI: "),
                _one_line(F.coalesce(F.col("original_url"), F.lit("urn:unknown"))),
            ),
        ),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)
    (
        resolved.select(record.alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its content does")
        yield headers, block


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to_id", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


class _Stream(io.RawIOBase):
    """The bytes of archives from what stood between their record ends; a file's last end may be one too many."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.chunks = (chunk for batch in batches for value in batch.column(0) for chunk in (value.as_buffer(), END.encode()))
        self.left = memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not len(self.left):
            chunk = next(self.chunks, None)
            if chunk is None:
                return 0
            self.left = memoryview(chunk).cast("B")
        n = min(len(target), len(self.left))
        target[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for headers, block in parse_records(io.BufferedReader(_Stream(batches), 1 << 20)):
        payload = block.partition(END.encode())[2]
        revisit = headers["warc-type"] == "revisit"
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        said = headers["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and digest != said:
            raise ValueError(f"the payload of {headers['warc-record-id']} is not the one that was written")
        page = headers.get("x-page-id")
        own = (headers["warc-type"], headers["warc-record-id"], headers.get("warc-refers-to"))
        rows.append((int(page) if page else None, *own, None if revisit else len(payload), said))
        if len(rows) == BATCH_ROWS:
            yield _as_batch(rows)
            rows = []
    yield _as_batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives below `path`; payloads are checked against their digests, not returned.

    A compressed archive is never split, so a task reads whole archives, one after the other.
    """
    parts = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    return parts.select(F.col("value").cast("binary")).mapInArrow(
        _parse,
        "page_id long, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string",
    )


def follow_revisits(records: DataFrame) -> DataFrame:
    """Give revisit records the payload length of their response, and the response's page id as refers_to."""
    originals = (
        records.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"))
    )
    plain = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    revisits = (
        records.where("record_type = 'revisit'")
        .join(originals, "refers_to_id")
        .withColumn("payload_bytes", F.col("_bytes"))
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(columns).unionByName(revisits.select(columns))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(resolve(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return follow_revisits(cut(read_archives(spark, path)))


OP5_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS d FROM p),
b AS (
  SELECT page_id, n, d,
         string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 1 + 10 * (k // 8), 10))::BIGINT
                           >> (35 - 5 * (k % 8))) & 31)::INTEGER, 1), '' ORDER BY k) AS digest
  FROM h, range(32) AS r(k) GROUP BY page_id, n, d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
