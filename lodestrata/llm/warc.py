"""WARC archives whose repeated payloads are revisit records.

Headers (id, URL, digest, length) are shuffled by payload digest: the first of each payload is found, and revisits are
joined with it; a payload that a third of all pages share costs its headers, no more. Bodies are read for responses
alone, dealt by id and digest, so they never meet by payload. One record is written per page: a response with the
payload, or a revisit that names its response. Files hold a bounded number of records, and records of LARGE bytes have
files of their own, so no file is larger than a reader takes. The text writer lays the bytes down exactly: a record's
value ends with its block, and the line separator is the blank line that ends a WARC record. Spark's writer commits per
task, so a lost executor leaves no half archive. Files are read as streams, a record at a time.

Edge cases: a null payload is empty (0 bytes, and empty payloads are equal like any others); a null URL leaves out
WARC-Target-URI; control characters and spaces in URLs are percent-encoded; a null id counts as larger than any id;
rows that repeat the smallest id of a payload are all responses; an empty table gives an archive without records.
Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import delete_path, saved, shared_dir, table

CRLF = "\r\n"
LARGE = 1 << 18
RECORD_END = CRLF + CRLF
ID_PREFIX = "urn:lodestrata:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(body: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, by built-in functions: 10 hex digits are 8 digits of base 32."""
    digest = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records_of(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """id, url, body, n_bytes, digest."""
    body = F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit(""))
    return pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        base32_sha1(body).alias("digest"),
    )


def resolve_revisits(pages: DataFrame, id_col: str, url_col: str, body_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """id, url, body, n_bytes, digest, first_id, first_url, is_revisit for each row; body is null for revisits."""
    records = records_of(pages, id_col, url_col, body_col)
    headers = saved(records.drop("body"), "headers")
    first = headers.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "url")).alias("first"))
    first = first.select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    judged = headers.where(F.col("n_bytes") >= min_revisit_bytes).join(first.hint("merge"), "digest").where(~F.col("id").eqNullSafe(F.col("first_id")))
    revisits = judged.select("id", "url", F.lit(None).cast("string").alias("body"), "n_bytes", "digest", "first_id", "first_url", F.lit(True).alias("is_revisit"))
    keys = first.select(F.col("first_id").alias("k_id"), F.col("digest").alias("k_digest"))
    small = records.where(F.col("n_bytes") < min_revisit_bytes)
    large = records.where(F.col("n_bytes") >= min_revisit_bytes).join(keys.hint("merge"), (F.col("digest") == F.col("k_digest")) & F.col("id").eqNullSafe(F.col("k_id")), "left_semi")
    responses = small.unionByName(large).select("id", "url", "body", "n_bytes", "digest", F.col("id").alias("first_id"), F.col("url").alias("first_url"), F.lit(False).alias("is_revisit"))
    return responses.unionByName(revisits)


def warc_records(resolved: DataFrame, date: str) -> DataFrame:
    """One column, value: a whole WARC record but for the blank line after it."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    uri = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("is_revisit")
    head = F.concat(F.lit(HTTP_HEAD), F.col("n_bytes").cast("string"), F.lit(RECORD_END))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("body")))
    length = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    return resolved.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", uri(F.col("id"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            line("WARC-Profile", F.when(revisit, PROFILE)),
            line("WARC-Refers-To", F.when(revisit, uri(F.col("first_id")))),
            line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_url"))),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", length.cast("string")),
            F.lit(CRLF),
            block,
        ).alias("value")
    )


def write_archive(resolved: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", records_per_file: int = 4096) -> None:
    """gzip-compressed WARC files of records_per_file records at most, and one of each record of LARGE bytes and more."""
    large = ~F.col("is_revisit") & (F.col("n_bytes") >= LARGE)
    for part, most in ((~large, records_per_file), (large, 1)):
        (warc_records(resolved.where(part), date).write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip")
         .option("maxRecordsPerFile", most).text(path))


def parse_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive, read as it is asked for."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {line[:40]!r} stands")
        headers = {}
        while (line := stream.readline().removesuffix(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record {headers.get('WARC-Record-ID')} isn't of the length it gives")
        yield headers, block


def _page(uri: str | None) -> int | None:
    tail = (uri or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def _described(headers: dict[str, str], block: bytes) -> tuple:
    """A revisit has its payload's length in the HTTP head and its digest in the record's; a response is measured itself."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "revisit":
        n_bytes = int(head.rpartition(b"Content-Length: ")[2])
    else:
        n_bytes, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != said:
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} isn't what its digest says")
    return _page(headers["WARC-Record-ID"]), n_bytes, said, kind, _page(headers.get("WARC-Refers-To"))


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for content in batch["content"]:
            with gzip.open(io.BytesIO(content)) as stream:
                rows = (_described(*r) for r in parse_archive(stream))
                while part := list(islice(rows, 4096)):
                    yield pd.DataFrame(part, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, from the archive's bytes alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(_read_files, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archive, reads it back, and keeps what was read, not the archive."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(resolve_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    found = saved(read_archive(spark, path), "records")
    delete_path(spark, path)
    return found


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
e AS (SELECT page_id, payload_bytes, translate(
  to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8) ||
  to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM e)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
