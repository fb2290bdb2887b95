"""Content-addressed WARC archive.

Two tables make the archive: ``payloads`` holds each distinct payload once,
under its SHA-256 (verified together with length and SHA-1 when read back), and
``headers`` holds every record's exact header bytes with the address of its
payload. ``read_records`` joins the two back into the original records.

Of the records with equal payloads of at least ``min_bytes`` bytes, the one with
the largest page_id is the response; the others are revisits that refer to it.

Defined cases: null html is an empty payload; equal page_ids of one payload are
all responses (a record does not revisit itself); a null page_id is a record
without a number: it never is the referred one unless all copies are so, and it
is then a response; an empty table gives an empty archive; other columns are
ignored. Native expressions only.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import ensure_checkpoint_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Bare base32 of a hex digest whose length is a multiple of 5 hex digits
    (SHA-1: 40): each 5 hex digits are four letters."""
    letters = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def _records(pages: DataFrame, min_bytes: int) -> DataFrame:
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), body.alias("body"))
    rows = rows.select("page_id", "url", "body", F.octet_length("body").cast("long").alias("n_bytes"),
                       F.sha2("body", 256).alias("address"), F.sha1("body").alias("sha1_hex"))
    # narrow rows only: the newest record of each payload (partial aggregation collapses a large group of copies)
    newest = rows.groupBy("address").agg(F.max("page_id").alias("newest"))
    heads = rows.select("page_id", "url", "n_bytes", "address", base32_of_hex(F.col("sha1_hex")).alias("digest"))
    heads = heads.join(newest, "address")
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("newest")) & F.col("newest").isNotNull()
    return heads.withColumn("revisit", revisit)


def _header() -> Column:
    """Exact WARC/1.1 header block of a record; the date is fixed, so equal
    input gives equal archives."""
    crlf = "\r\n"
    num = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uri = F.coalesce(F.col("url"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + crlf), F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(crlf + "WARC-Record-ID: <urn:page:"), num, F.lit(">" + crlf + "WARC-Date: 1970-01-01T00:00:00Z" + crlf),
        F.lit("WARC-Target-URI: "), F.regexp_replace(uri, r"[\r\n]", " "),
        F.lit(crlf + "WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(
            F.lit(crlf + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit(crlf + "WARC-Refers-To: <urn:page:"), F.col("newest").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(crlf + "Content-Type: text/html" + crlf + "Content-Length: "),
        F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n_bytes")).cast("string"), F.lit(crlf + crlf))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the two tables of the archive under ``path``."""
    heads = _records(pages, min_bytes)
    heads.select("page_id", "address", _header().alias("header")).write.mode("overwrite").parquet(f"{path}/headers")
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    bodies = pages.select(body.alias("body")).select(F.sha2("body", 256).alias("address"), "body")
    # any copy of a payload will do: first() keeps one per task before the shuffle
    bodies.groupBy("address").agg(F.first("body").alias("payload")) \
        .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: page_id, record_type, refers_to (page number as
    text), payload (of revisits too, through the address), payload_digest as the
    header states it, and ``verified``: address, SHA-1 and length all agree."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "address", "payload", (F.sha2("payload", 256) == F.col("address")).alias("_sound"),
        base32_of_hex(F.sha1("payload")).alias("_sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    rows = headers.join(payloads, "address")
    rows = rows.select(
        "page_id", "header", "payload", "payload_bytes", field("WARC-Type").alias("record_type"),
        F.regexp_extract("header", r"WARC-Refers-To: <urn:page:([^>]*)>", 1).alias("_ref"),
        F.regexp_extract("header", r"WARC-Payload-Digest: sha1:(\w*)", 1).alias("payload_digest"),
        field("Content-Length").cast("long").alias("_length"), "_sound", "_sha1")
    sized = F.col("_length") == F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    return rows.select("page_id", "record_type", F.when(F.col("_ref") != "", F.col("_ref").cast("long")).alias("refers_to"),
                       "header", "payload", "payload_bytes", "payload_digest",
                       (F.col("_sound") & (F.col("_sha1") == F.col("payload_digest")) & sized).alias("verified"))


def warc_bytes(records: DataFrame) -> DataFrame:
    """(page_id, record): the bytes of each WARC record."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(records: DataFrame, path: str) -> None:
    """Write .gz WARC files: the end of a record is the writer's line separator."""
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    records.select(F.concat("header", block).alias("value")) \
        .write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared checkpoint folder and read it back."""
    spark = pages.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark).rstrip("/"), "llm", f"warc-{uuid.uuid4().hex}")
    write_archive(pages, path, min_bytes)
    return read_records(spark, path)
