"""WARC archives with revisit records.

The payload digests are shuffled as headers, without the payloads: of the records with one digest the one with the largest
page id is the response, the others revisit it. Records are then written with fresh headers, and reading joins revisits
back to their responses.

A record is a header block, an empty line, the block and two line ends. Spark's text writer puts a separator after each
row, so a row is header and block, and the separator is the two line ends: the written files are WARC/1.1 (compressed as a
whole), committed task by task, on any file system that Spark writes.

Rows: a null html is an empty payload; a null url is an empty target; a null page_id is the smallest of all. Rows with equal
page_id and payload are records of their own: one is the response and the others revisit it. Extra columns are ignored; an
empty table gives an empty archive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.llm.common import shared_folder, written

LEAST_BYTES = 0
#: Bytes of payload that a file aims at.
FILE_BYTES = 24_000_000
END = "\r\n\r\n"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, whose 160 bits are 8 groups of 20: five hex digits, four of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), DIGITS, BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, payload_bytes) with html empty for null."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))


def resolved(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """headers() with refers_to: the response's page_id for a revisit, null for a response.

    Only digests and ids are shuffled to find the responses, and aggregated before. Where the response's own row is
    repeated, all but one of its rows revisit it.
    """
    head = headers(pages)
    of = head.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("ids"))
    several = written(of.where("n > 1").select("digest", "first", (F.col("n") > F.col("ids")).alias("repeats")), "several")
    # a broadcast only where Spark finds the table of repeated digests small
    joined = head.join(several.withColumn("shared", F.lit(True)), "digest", "left")
    if several.where("repeats").limit(1).count():
        # rows of a page that repeat: any one of them is the response
        own = Window.partitionBy("digest", "page_id").orderBy("url")
        joined = joined.withColumn("again", F.when(F.coalesce("repeats", F.lit(False)), F.row_number().over(own)).otherwise(1))
    else:
        joined = joined.withColumn("again", F.lit(1))
    first = (F.col("shared").isNull()) | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("again") == 1))
    return joined.select("page_id", "url", "html", "digest", "payload_bytes", F.when(~first, F.col("first")).alias("refers_to"), (~first).alias("revisits"))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(found: DataFrame, date: str) -> DataFrame:
    """One row (value) for each record: header block, empty line and block. A revisit has no block."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(F.col("revisits"), F.lit("")).otherwise(F.col("html"))
    value = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisits"), F.concat(line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return found.select(value.alias("value"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files of about file_bytes payload each to folder."""
    found = resolved(pages, least_bytes)
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    spread = found.repartition(files, F.xxhash64("page_id", "url"))  # no key of a hot host or digest
    records(spread, date).write.option("lineSep", END).option("compression", "gzip").text(folder)


FIELD = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an uncompressed archive: header fields and block."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        if data[at : at + 10] != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.decode(): v.decode("utf-8", "replace") for k, v in FIELD.findall(data[at : head + 2])}
        start = head + 4
        end = start + int(fields["Content-Length"])
        yield fields, data[start:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end with its length")
        at = end + 4


def _parsed(with_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import hashlib
        from base64 import b32encode

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())][: 7 if with_block else 6])
        number = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for f, block in parse(gzip.decompress(data.as_py())):
                    digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                    if kind == "response" and b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"{f['WARC-Record-ID']} doesn't match its digest")
                    row = [number(f["WARC-Record-ID"]), f["WARC-Target-URI"], len(block) if kind == "response" else None, digest, kind, number(f["WARC-Refers-To"]) if kind == "revisit" else None]
                    rows.append([*row, block.decode("utf-8") if kind == "response" else None] if with_block else row)
                    held += len(block) if with_block else 100
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archives(spark: SparkSession, folder: str, with_html: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) and, if asked for, html of every record; a revisit gets its response's size and payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    columns = "page_id long, url string, payload_bytes long, digest string, record_type string, refers_to long" + (", html string" if with_html else "")
    got = files.mapInArrow(_parsed(with_html), columns)
    if not with_html:
        got = written(got, "headers")
    more = ["html"] if with_html else []
    asked = got.where("record_type = 'revisit'").select("refers_to", "digest").distinct()
    first = got.where("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), F.col("payload_bytes").alias("full"), *[F.col(c).alias(f"full_{c}") for c in more])
    first = first.join(asked, F.col("of").eqNullSafe(F.col("refers_to")) & (F.col("of_digest") == F.col("digest")), "left_semi")
    met = got.join(first, (F.col("record_type") == "revisit") & F.col("refers_to").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    return met.select("page_id", "url", F.coalesce("payload_bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", *[F.coalesce(c, f"full_{c}").alias(c) for c in more])


def op6_warc(pages: DataFrame) -> DataFrame:
    folder = f"{shared_folder(pages.sparkSession)}/warc"
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder).drop("url")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, cast(octet_length(encode(html)) AS bigint) AS payload_bytes, sha1(html) AS d FROM p),
b AS (SELECT page_id, payload_bytes, d, list_transform(generate_series(0, 31), lambda i: cast(('0x' || substr(d, 1 + (i // 4) * 5, 5)) AS bigint) // cast(pow(32, 3 - i % 4) AS bigint) % 32) AS q FROM h),
g AS (SELECT page_id, payload_bytes, array_to_string(list_transform(q, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(x AS int) + 1, 1)), '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS k FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN first END AS refers_to
FROM m
"""
