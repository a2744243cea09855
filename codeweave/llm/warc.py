"""Content-addressed WARC archive.

An archive is two tables in the shared folder: `payloads` (each distinct payload once, under its SHA-256) and
`headers` (the exact header bytes of every record). A record's bytes come back by joining the two on the digest
that its header names; every payload is hashed again when it is read, and a mismatch ends the job.

Defined results: a null payload is an empty one; a null URI leaves the Target-URI line out; control characters in a
URI are percent-encoded; repeated record ids each keep a record (those with the group's largest id are its
responses); empty tables give empty archives; other input columns are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import shared

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


@dataclass
class Archive:
    headers: str
    payloads: str


def _uri(c: Column) -> Column:
    for k in range(32):
        c = F.replace(c, F.lit(chr(k)), F.lit(f"%{k:02X}")) if k in (0, 9, 10, 13) else c
    return c


def write(records: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> Archive:
    """records (record_id long, uri string, payload binary) → the paths of a new archive.

    Of the records with equal payloads of min_revisit bytes or more the one with the largest id is the response and
    the others revisit it. Only digests and ids meet in the grouping besides one payload per task and digest, so a
    payload that a third of all records share costs no more than any other.
    """
    spark = records.sparkSession
    archive = Archive(shared.place(spark, "warc-headers"), shared.place(spark, "warc-payloads"))
    body = F.coalesce("payload", F.lit(b""))
    base = records.select("record_id", "uri", body.alias("payload"), F.sha2(body, 256).alias("sha256"))
    base.groupBy("sha256").agg(F.max("record_id").alias("head"), F.first("payload").alias("payload")).write.parquet(archive.payloads)
    heads = spark.read.parquet(archive.payloads).select("sha256", "head")
    named = records.select("record_id", "uri", F.octet_length(body).cast("long").alias("n"), F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256"))
    revisit = (F.col("n") >= min_revisit) & (F.col("record_id") != F.col("head"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END * 2))
    lines = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: <urn:page:"), F.col("record_id").cast("string"), F.lit(f">{END}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("uri")), F.lit(END)), F.lit("")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + END),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: <urn:page:"), F.col("head").cast("string"), F.lit(f">{END}"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(f"{END}X-Store-Digest: sha256:"), F.col("sha256"),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string"), F.lit(END * 2), http,
    )
    named.join(heads, "sha256").select("sha256", F.encode(lines, "UTF-8").alias("header")).write.parquet(archive.headers)
    return archive


def _field(name: str, value: str = "([^\r\n]*)") -> Column:
    """A named field of the WARC part of the header, null without it."""
    warc = F.substring_index(F.decode("header", "UTF-8"), END * 2, 1)
    found = F.regexp_extract(warc, f"(?:^|\n){name}: {value}", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record of an archive: the fields of its header, the full payload it stands for and its exact bytes."""
    payloads = spark.read.parquet(archive.payloads).select(F.col("sha256").alias("key"), "payload")
    headers = spark.read.parquet(archive.headers).select(
        "header",
        _field("X-Store-Digest", "sha256:([0-9a-f]{64})").alias("key"),
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("record_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field("WARC-Target-URI").alias("uri"),
        _field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})").alias("sha1"),
    )
    sound = (F.sha2("payload", 256) == F.col("key")) & (F.sha1("payload") == F.col("sha1"))
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not have its digest: "), F.coalesce("key", F.lit("none")))))
    return headers.join(payloads, "key", "left").select(
        "record_id", "record_type", "refers_to", "uri", F.col("sha1").alias("payload_digest"), payload.alias("payload"),
        F.concat("header", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")), F.lit((END * 2).encode())).alias("record"),
    )


def parse(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(header text, URI, block) of each record of a WARC file's bytes, gzip members included."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = data[at:end].decode("utf-8", "replace")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
        start, n = end + 4, int(fields["content-length"])
        yield head, fields.get("warc-target-uri", ""), data[start : start + n]
        at = start + n + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, header, uri, block) of the records of .warc or .warc.gz files, one file at a time in a task."""
    shared.ship(spark)
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("header", pa.string()), ("uri", pa.string()), ("block", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                for k, (head, uri, block) in enumerate(parse(data.as_py())):
                    yield pa.record_batch([[name], [k], [head], [uri], [block]], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(each, "file string, ordinal long, header string, uri string, block binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per row of pages, written to an archive and read back."""
    pages = shared.table(spark, sf_dir, "pages")
    archive = write(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload")))
    back = read(spark, archive)
    return back.select(
        F.col("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("payload_digest"),
        "record_type",
        "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
             max(page_id) OVER (PARTITION BY b) AS head, url FROM p),
r AS (SELECT *, (payload_bytes >= 1000 AND page_id <> head) AS again FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN head END AS refers_to,
       (CASE WHEN again THEN 0 ELSE payload_bytes END
        + strlen('WARC/1.1') + 2 + strlen('WARC-Type: ') + CASE WHEN again THEN 7 ELSE 8 END + 2
        + strlen('WARC-Record-ID: <urn:page:') + strlen(page_id::VARCHAR) + 3
        + CASE WHEN url IS NULL THEN 0 ELSE strlen('WARC-Target-URI: ') + strlen(url) + 2 END
        + strlen('WARC-Date: 1970-01-01T00:00:00Z') + 2
        + CASE WHEN again THEN strlen('WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest') + 2
                               + strlen('WARC-Refers-To: <urn:page:') + strlen(head::VARCHAR) + 3 ELSE 0 END
        + strlen('WARC-Payload-Digest: sha1:') + 40 + 2 + strlen('X-Store-Digest: sha256:') + 64 + 2
        + strlen('Content-Type: application/http; msgtype=response') + 2
        + strlen('Content-Length: ')
        + strlen((CASE WHEN again THEN 0 ELSE payload_bytes END + 77 + strlen(payload_bytes::VARCHAR))::VARCHAR) + 4
        + 77 + strlen(payload_bytes::VARCHAR) + 4)::BIGINT AS record_bytes
FROM r
"""
