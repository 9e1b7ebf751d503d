"""Content-addressed WARC archive.

The payload store keeps each distinct payload once, under its SHA-256; the header table keeps the exact header
bytes of every record. Records are put together again by a join of the two on the digest. Reading verifies every
stored payload against its key and fails on a mismatch.

Payloads are shuffled once, when they are stored, with map-side elimination of copies. All that decides the record
types moves digests only, so a payload that a third of the pages share costs one row per map task.

Cases: a null html is an empty payload; a null url leaves out the target line; CR and LF in a url are
percent-encoded; repeated rows of one page_id with equal payloads are all responses; empty tables give empty tables;
payloads of any length are stored whole; other columns are not read.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: Payloads below this length are never revisited.
MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"
#: Fixed value: the profile of a revisit record whose payload another record holds.
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def headers(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> DataFrame:
    """One row per page: payload_key, header (binary, exact bytes up to and with the blank line); date: of the capture, else now."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    digested = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "page_id", "url", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("payload_key")
    )
    owners = digested.where(F.col("n") >= min_revisit_bytes).groupBy("payload_key").agg(F.max("page_id").alias("owner"))
    joined = digested.join(owners, "payload_key", "left")
    revisit = F.coalesce(F.col("owner") != F.col("page_id"), F.lit(False))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(_line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", uri), F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Payload-Key", F.concat(F.lit("sha256:"), F.col("payload_key"))),
        F.when(revisit, _line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(revisit, _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(">")))).otherwise(""),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(CRLF),
    )
    return joined.select("payload_key", F.encode(text, "UTF-8").alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """Each distinct payload once: payload_key, payload."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("payload_key"), "payload")
    return rows.groupBy("payload_key").agg(F.first("payload").alias("payload"))


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Write headers/ and payloads/ under path (a new folder in the shared folder where it is None); return path."""
    path = path or scratch(pages.sparkSession, "warc")
    payloads(pages).write.option("compression", "zstd").parquet(f"{path}/payloads")
    headers(pages).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _verified(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema("payload_key string, payload binary").parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("stored payload does not match its digest "), F.col("payload_key"))).cast("binary")
    return stored.select("payload_key", F.when(F.sha2("payload", 256) == F.col("payload_key"), F.col("payload")).otherwise(wrong).alias("payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Parse the header bytes: page_id, url, record_type, payload_digest, refers_to, payload_key, header."""
    raw = spark.read.schema("payload_key string, header binary").parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name, inner=r"([^\r\n]*)": F.regexp_extract(text, rf"(?md)^{name}: {inner}\r$", 1)
    return raw.select(
        F.nullif(field("WARC-Record-ID", "<urn:page:(.*)>"), F.lit("")).cast("long").alias("page_id"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:(.*)").alias("payload_digest"),
        F.nullif(field("WARC-Refers-To", "<urn:page:(.*)>"), F.lit("")).cast("long").alias("refers_to"),
        field("Payload-Key", "sha256:(.*)").alias("payload_key"),
        "header",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: page_id, record_type, refers_to and the record's whole bytes (header, block, two CRLF)."""
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    found = read_headers(spark, path)
    whole = found.where("record_type = 'response'").join(_verified(spark, path), "payload_key").withColumn("record", F.concat("header", "payload", end))
    empty = found.where("record_type = 'revisit'").withColumn("record", F.concat("header", end))
    columns = ["page_id", "url", "record_type", "refers_to", "record"]
    return whole.select(columns).unionByName(empty.select(columns))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back, and report each record from what was read."""
    path = write_archive(table(spark, sf_dir, "pages"))
    facts = _verified(spark, path).select("payload_key", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    found = read_headers(spark, path).drop("payload_digest").join(facts, "payload_key")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest, h from p),
m as (select *, max(page_id) over (partition by h) as top from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from m
"""
