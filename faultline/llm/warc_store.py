"""Content-addressed WARC archive.

``write_archive`` turns pages into WARC/1.1 records and stores them in two tables: ``payloads``
holds the bytes of every different payload once, under its SHA-256 and length; ``records`` holds
the exact header block of every record with the address of its payload. Of records with equal
payloads of at least ``MINIMUM`` bytes, the one with the largest page id is a response and the
others are revisits that name it; smaller payloads are stored once too, but all their records are
responses. ``read_archive`` recomputes digests from the stored bytes, fails if one differs, parses
the headers and joins them with the payloads; ``record_bytes`` rebuilds whole records.

Only payloads that occur more than once are looked up when the keeper is chosen, so equal pages
are never gathered: counts per digest are added up before they are shuffled.

Defined results: a null page is an empty payload; a null page id has an empty name in the record
id and is read back as null; a null url leaves ``WARC-Target-URI`` out; control characters and
spaces in a url are percent-encoded; of rows that repeat a page id with the same payload, one is
the response; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import small_or_shuffled, table, written
from faultline.plans.staging import shared_folder

MINIMUM = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: Column) -> Column:
    """The url without bytes that would break a header line."""
    out = url
    for c in [*range(33), 127, 60, 62]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}")) if c in (9, 10, 13, 32, 60, 62) else out
    return F.regexp_replace(out, r"[\x00-\x1F\x7F]", "%00")


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", page: str = "html",
                  date: str = DATE, minimum: int = MINIMUM) -> str:
    """Write the tables ``payloads`` and ``records`` below ``folder``."""
    body = F.encode(F.coalesce(F.col(page), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"),
                        F.monotonically_increasing_id().alias("row")).select(
        "*", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("size"))
    last = F.max(F.struct("page_id", "row")).alias("last")
    copies = written(rows.groupBy("address", "size").agg(F.count(F.lit(1)).alias("n"), last).where("n > 1").select(
        F.col("address").alias("copied"), F.col("last.page_id").alias("keeper"), F.col("last.row").alias("keeper_row")), "copies")
    found = rows.join(small_or_shuffled(copies), F.col("address") == F.col("copied"), "left").withColumn(
        "first", F.col("copied").isNull() | (F.col("row") == F.col("keeper_row")))
    found.where("first").select("address", "size", "payload").write.parquet(f"{folder}/payloads")
    revisit = ~F.col("first") & (F.col("size") >= minimum)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _uri(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _name(F.col("keeper"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"))
    found.select(F.encode(header, "UTF-8").alias("header"), "address", "size").write.parquet(f"{folder}/records")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record: ``header``, parsed fields, and its full ``payload`` with recomputed size and digest.

    Bytes that do not fit their address, or a record without its payload, are an error.
    """
    stored = spark.read.schema("address string, size long, payload binary").parquet(f"{folder}/payloads")
    sound = (F.sha2("payload", 256) == F.col("address")) & (F.octet_length("payload") == F.col("size"))
    stored = stored.select(
        "address", F.when(sound, F.octet_length("payload").cast("long")).otherwise(
            F.raise_error(F.lit("a stored payload does not fit its digest"))).alias("payload_bytes"),
        F.sha1("payload").alias("sha1"), "payload")
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\n{name}: ([^\r\n]*)", 1)
    page = lambda name: F.nullif(F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1), F.lit(""))
    records = spark.read.schema("header binary, address string, size long").parquet(f"{folder}/records").select(
        "header", "address", field("WARC-Type").alias("record_type"), page("WARC-Record-ID").alias("page"),
        page("WARC-Refers-To").alias("refers_to"), F.nullif(field("WARC-Target-URI"), F.lit("")).alias("target_uri"),
        F.substring(field("WARC-Payload-Digest"), 6, 40).alias("payload_digest"))
    joined = records.join(stored, "address", "left")
    right = F.col("sha1").isNotNull() & (F.col("sha1") == F.col("payload_digest"))
    return joined.withColumn("payload_digest", F.when(right, F.col("sha1")).otherwise(
        F.raise_error(F.lit("a record's payload is missing or has another digest")))).drop("sha1")


def record_bytes(archive: DataFrame) -> DataFrame:
    """``page`` and the exact bytes of each record: header block, content, two line ends."""
    content = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return archive.select("page", F.concat("header", content, F.lit(b"\r\n\r\n")).alias("record"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    folder = write_archive(pages, f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}/warc")
    return read_archive(spark, folder).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY h) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY h) THEN max(page_id) OVER (PARTITION BY h) END AS refers_to
FROM p
"""
