import base64
import hashlib
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tomeworks.llm import archive
from tomeworks.operators.settle import shared_folder

ROWS = [(1, "http://a.example/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b.example/é\r\nX: y", None), (4, "", ""),
        (5, "http://c.example", "é" * 50_000 + "\r\n\r\n tail"), (7, "http://a.example", "<p>one</p>"), (6, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n")]


def folder(spark):
    return f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"


def test_round_trip_equals_brute_force(spark):
    path = folder(spark)
    archive.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    got = {int(r.key): r for r in archive.read_back(spark, path).collect()}
    last = {}
    for i, _, html in ROWS:
        last[html or ""] = max(i, last.get(html or "", i))
    for i, _, html in ROWS:
        raw, first = (html or "").encode(), last[html or ""]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", str(first)))
    assert spark.read.parquet(f"{path}/payloads").count() == len(last)
    records = [bytes(r.record) for r in archive.records(spark, path).collect()]
    assert len(records) == len(ROWS)
    for record in records:
        head, body = record.split(b"\r\n\r\n", 1)
        length = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and body[length:] == b"\r\n\r\n"


def test_small_payloads_may_all_be_responses(spark):
    path = folder(spark)
    archive.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path, least_bytes=11)
    assert {r.record_type for r in archive.read_back(spark, path).collect()} == {"response"}


def test_a_damaged_payload_ends_the_job(spark):
    path = folder(spark)
    archive.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    payloads = spark.read.parquet(f"{path}/payloads")
    bad = F.when(F.octet_length("payload") == 10, F.encode(F.lit("<p>two</p>"), "UTF-8")).otherwise(F.col("payload"))
    other = folder(spark)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    payloads.withColumn("payload", bad).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="unsound payload"):
        archive.read_back(spark, other).collect()


def test_ties_null_keys_and_empty_tables(spark):
    path = folder(spark)
    archive.write(spark.createDataFrame([(None, "u", "a"), (1, "u", "a"), (1, "v", "a"), (None, "u", "b")], "page_id long, url string, html string"), path)
    got = sorted((r.key, r.record_type, r.refers_to) for r in archive.read_back(spark, path).collect())
    assert [g[1] for g in got].count("response") == 2 and ("null", "response", None) in got and ("null", "revisit", "1") in got and ("1", "revisit", "1") in got
    path = folder(spark)
    archive.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert archive.read_back(spark, path).count() == 0


def test_null_ids_of_one_payload_through_the_query(spark, tmp_path):
    from tomeworks.llm.queries import QUERIES

    rows = [(None, "u", "a"), (None, "v", "a"), (None, "w", "a"), (4, "u", "b"), (None, "u", "b")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op5_warc_archive"](spark, str(tmp_path)).collect())
    assert got == Counter({(None, 1, "response", None): 1, (None, 1, "revisit", None): 2, (4, 1, "response", None): 1, (None, 1, "revisit", 4): 1})
