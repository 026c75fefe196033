import hashlib
import re

from pyspark.sql import functions as F

from tomeworks.llm import exact

TEXTS = [(5, "a  b", 1), (3, "a\t\nb", 2), (9, "a b", 3), (1, "x", 4), (None, "x", 5), (7, None, 6), (8, "", 7), (8, "", 7), (2, "y" * 100_000, 8), (4, " a b", 9)]


def _groups(rows):
    by = {}
    for i, t, _ in rows:
        by.setdefault(hashlib.sha256(re.sub(r"[ \t-\r]+", " ", t or "").encode()).hexdigest(), []).append(i)
    return by


def test_groups_equal_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, kept int")
    want = _groups(TEXTS)
    rows = exact.copy_groups(df).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        own = want[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == min(i for i in own if i is not None)
    assert sum(r.kept for r in rows) == len(want)
    stay = exact.drop_copies(df).collect()
    assert sorted(r.doc_id for r in stay) == [1, 2, 3, 4, 7] and len(stay[0]) == 3


def test_a_full_filter_only_costs_shuffling(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2000).cast("string").alias("text"))
    tiny = exact.possibly_repeated(df, F.col("text"), max_filter_bytes=8)
    assert df.where(tiny & (F.col("doc_id") >= 0)).count() >= 2000
    roomy = exact.possibly_repeated(df, F.col("text"))
    marked = df.where(roomy)
    assert marked.where("cast(text as int) < 1000").count() == 2000 and marked.count() < 2100


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact.copy_groups(empty).count() == 0 and exact.drop_copies(empty).count() == 0
