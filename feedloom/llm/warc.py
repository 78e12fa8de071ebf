"""Content-addressed web archive: payload bytes once per strong digest, exact record headers apart.

``write_archive`` writes two tables below a shared folder: ``payloads``
(digest, payload) holds every distinct payload once, ``records`` holds the exact
header text of every WARC record. ``read_archive`` joins them again and
recomputes the digest of the stored bytes; ``record_bytes`` renders the original
record. The copies of one payload are recognised on (digest, id) rows alone, so
a payload shared by a third of all pages never gathers in one task.

Defined results: a null payload is empty; payloads under ``MIN_REVISIT`` bytes
are always ``response``; rows that tie for the smallest id of a payload are all
``response`` (its bytes are still stored once); a null id is larger than any
other; a null url leaves out its header; an empty table writes an empty
archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MIN_REVISIT = 100
CRLF = "\r\n"
CAPTURED = "1970-01-01T00:00:00Z"  # the table has no capture time


def _uuid(key: Column) -> Column:
    h = F.sha2(key.cast("binary"), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def record_id(page_id: Column) -> Column:
    """A record's id, derived from the page id alone, so that a revisit can name the response."""
    return F.concat(F.lit("<urn:uuid:"), _uuid(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")))),
                    F.lit(">"))


def _header() -> Column:
    """Header block of a record; ends before the empty line."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws(
        CRLF, F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(CAPTURED)), line("WARC-Target-URI", F.col("url")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("owner")))),
        F.when(revisit, line("X-Refers-To-Page", F.col("owner").cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.lit("Content-Type: text/html; charset=utf-8"), line("X-Payload-Length", F.col("n_bytes").cast("string")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))))


def _one_line(url: Column) -> Column:
    """A header value holds no line ends; they are percent-encoded."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _key(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit("null"))


def write_archive(pages: DataFrame, path: str, payload_col: str = "html") -> None:
    """Write the archive of ``pages(page_id, url, <payload>)`` below ``path``."""
    p = pages.select("page_id", _one_line(F.col("url").cast("string")).alias("url"),
                     F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit("").cast("binary")).alias("payload"))
    keyed = p.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # narrow: one row per page without its bytes; combined map-side, so copies meet as one row per task
    owners = keyed.groupBy("digest").agg(F.min("page_id").alias("owner"))
    # the owner's row brings the bytes; grouping reuses the join's partitioning (plain equality on both
    # keys, so null ids take a key of their own) and drops repeated rows
    own = owners.select("digest", _key(F.col("owner")).alias("key"))
    stored = (keyed.select("digest", _key(F.col("page_id")).alias("key"), "payload").join(own, ["digest", "key"])
              .groupBy("digest", "key").agg(F.first("payload").alias("payload")).select("digest", "payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    records = (keyed.select("page_id", "url", "digest", "n_bytes").join(owners, "digest")
               .withColumn("record_type", F.when((F.col("n_bytes") < MIN_REVISIT) | F.col("page_id").eqNullSafe(F.col("owner")),
                                                 "response").otherwise("revisit"))
               .select("page_id", "digest", _header().alias("header")))
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def field(name: str) -> Column:
    """A header's value, read from the stored header text."""
    value = F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records with their payload. ``payload_digest`` and ``payload_bytes`` come from the stored bytes;
    a payload that does not match its digest raises an error."""
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("found", F.sha2("payload", 256)).select(
        "digest", "payload",
        F.when(F.col("found") == F.col("digest"), F.col("found"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest")))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))
    records = spark.read.parquet(f"{path}/records").withColumn("key", field("WARC-Payload-Digest"))
    return (records.drop("digest").join(payloads, F.col("key") == F.concat(F.lit("sha256:"), F.col("digest")), "left")
            .withColumn("record_type", field("WARC-Type"))
            .withColumn("refers_to", field("X-Refers-To-Page"))
            .drop("key", "digest"))


def record_bytes(header: Column, record_type: Column, payload: Column) -> Column:
    """The original record: header block, empty line, content block (none for a revisit), two line ends."""
    end = F.lit(CRLF + CRLF).cast("binary")
    body = F.when(record_type == "revisit", F.lit("").cast("binary")).otherwise(payload)
    return F.concat(header.cast("binary"), end, body, end)
