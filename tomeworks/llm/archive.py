"""Content-addressed web archive.

An archive is two tables: *payloads* keeps the bytes of every distinct payload once, under their
SHA-256, and *headers* keeps the exact header block of every WARC record with the address of its
payload. ``records`` reconstructs the original record bytes by joining the two; ``read_back`` parses
them again and checks every payload against its digests.

Of records with equal payloads of at least ``least_bytes``, that with the largest key is a response,
the others are revisits of it, whose block is empty. Rows whose payload can't occur twice are told by
a bounded filter (see ``exact``) and written without a shuffle; the others meet by digest.

Edge cases: a null payload is the empty one, a null url an empty target. A null key is smaller than
any other and is written as the text null; of rows with equal keys and payloads one is the response. Empty tables give empty archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.llm.exact import possibly_repeated
from tomeworks.operators.sampling import join_counted
from tomeworks.operators.settle import settle

CRLF = "\r\n"


def base32(hex_digest: Column) -> Column:
    """Base 32 of a digest of 160 bits: ten hex digits are eight base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(key: Column) -> Column:
    """A stable name-based record id."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(key.cast("string"), F.lit("null"))))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def write(df: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z",
          least_bytes: int = 0) -> None:
    """Write one record per row of ``df`` to the archive at ``path``."""
    bytes_ = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), bytes_.alias("payload")).withColumn(
        "address", F.sha2("payload", 256)).withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    narrow = settle(rows.drop("payload").withColumn("row", F.monotonically_increasing_id()))
    shared = possibly_repeated(narrow, F.col("address"))
    narrow = settle(narrow.withColumn("shared", shared))
    groups = narrow.where("shared").groupBy("address").agg(
        F.max(F.struct("key", "row")).alias("last"), F.count("*").alias("n"))
    repeated = join_counted(narrow.where("shared"), groups, "address", "n", F.col("row"))
    # a group's records are alike but for those that revisit
    revisits = (F.col("size") >= least_bytes) & (F.col("row") != F.col("last.row"))
    decided = narrow.where("NOT shared").select("key", "url", "address", "sha1", "size", F.lit(False).alias("revisit"), F.lit(None).cast("bigint").alias("of")).unionByName(
        repeated.select("key", "url", "address", "sha1", "size", revisits.alias("revisit"), F.when(revisits, F.col("last.key")).cast("bigint").alias("of")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("key"))),
        F.concat(F.lit(f"WARC-Date: {date}")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("X-Row-Key: "), F.coalesce(F.col("key").cast("string"), F.lit("null"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("of")))),
        F.when(F.col("revisit"), F.concat(F.lit("X-Refers-To-Key: "), F.coalesce(F.col("of").cast("string"), F.lit("null")))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size")).cast("string")),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)), "UTF-8")
    decided.select("address", "revisit", header.alias("header")).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/headers")
    # each distinct payload once: straight through where it is the only one
    stored = rows.select("address", "payload").withColumn("shared", shared)
    once = stored.where("shared").select("address", "payload").dropDuplicates(["address"])
    stored.where("NOT shared").select("address", "payload").unionByName(once).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/payloads")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(address, revisit, record)`` with the original bytes of every record."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    full = headers.where("NOT revisit").join(payloads, "address").select("address", "revisit", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(headers.where("revisit").select("address", "revisit", F.concat("header", end).alias("record")))


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Parse the reconstructed records: ``key`` (as text), ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to`` of every record, bytes and digest those of the full payload.

    A payload that does not match its address, its header's digest or its length ends the job.
    """
    text = F.decode("record", "ISO-8859-1")  # one character per byte
    found = records(spark, path).withColumn("head", F.concat(F.substring_index(text, CRLF * 2, 1), F.lit(CRLF)))
    length = _field("Content-Length").cast("bigint")
    parsed = found.select(
        "address", "revisit", _field("X-Row-Key").alias("key"), _field("WARC-Type").alias("record_type"), length.alias("length"),
        _field("WARC-Payload-Digest").alias("declared"), _field("X-Refers-To-Key").alias("refers_to"),
        F.expr("substring(record, length(head) + 3, octet_length(record) - length(head) - 6)").alias("payload"))
    sound = ((F.col("address") == F.sha2("payload", 256)) & (F.col("length") == F.octet_length("payload"))
             & (F.col("declared") == F.concat(F.lit("sha1:"), base32(F.sha1("payload")))))
    responses = settle(parsed.where("NOT revisit").select(
        "address", "key", "record_type", F.when(sound, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("unsound payload of record "), "key"))).alias("payload_bytes"),
        F.substring("declared", 6, 32).alias("payload_digest")))
    revisits = parsed.where("revisit").select("address", "key", "record_type", "refers_to")
    # an address that has revisits has one response
    asked = revisits.groupBy("address").agg(F.count("*").alias("n"))
    targets = asked.join(responses.select("address", "payload_bytes", "payload_digest"), "address")
    columns = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("string")).select(columns).unionByName(
        join_counted(revisits, targets, "address", "n", F.col("key")).select(columns))
