import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeworks.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    # One stratum holds most of the rows.
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("type"), F.md5(F.col("id").cast("string")).alias("ord"))


def test_rank_equals_row_number(rows):
    want = {r["id"]: r["n"] for r in rows.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("ord"))).collect()}
    got = {r["id"]: r["rank"] for r in S.rank_in_hash_order(rows, "ord", ["type"]).collect()}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 7, 1500, 9999])
def test_take_is_exact(rows, n):
    want = {r["id"] for r in rows.orderBy("ord").limit(n).collect()}
    assert {r["id"] for r in S.take_in_hash_order(rows, n, "ord").collect()} == want


def test_first_per_key_prunes_before_the_shuffle(rows):
    plan = S.first_per_key(rows, ["type"], [F.col("ord")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_split_and_ids(rows):
    done = S.attach_ids(S.stratified_split(rows, 0.12, "ord"), F.lit("x"), "ord").cache()
    counts = {(r["type"], r["split"]): r["count"] for r in done.groupBy("type", "split").count().collect()}
    assert counts[("hot", "holdout")] == 288 and counts[("cold", "holdout")] == 72
    assert done.select("id").distinct().count() == 3000 and done.agg(F.min("id"), F.max("id")).first()[:] == ("x-000001", "x-003000")


def test_small_stratum_keeps_one_holdout_row(spark):
    one = spark.createDataFrame([("a", "ff")], "type string, ord string")
    assert S.stratified_split(one, 0.12, "ord").first()["split"] == "holdout"


def test_join_counted_keeps_every_row(rows, spark):
    names = spark.createDataFrame([("hot", 1, 2400), ("cold", 2, 600)], "type string, v int, n long")
    for per_task in (100, 1000, 10_000):
        joined = S.join_counted(rows, names, "type", "n", F.col("id"), per_task)
        assert joined.count() == 3000 and joined.agg(F.sum("v")).first()[0] == 2400 + 1200


def test_review_quotas_by_largest_remainders(spark):
    counts = spark.createDataFrame([("a", 55), ("b", 33), ("c", 11), ("d", 1)], "type string, rows bigint")
    got = {r["type"]: r["quota"] for r in S.review_quotas(counts, ["type"], 0.1).collect()}
    assert got == {"a": 5, "b": 3, "c": 1, "d": 1}  # ten in all, one of the smallest
    got = {r["type"]: r["quota"] for r in S.review_quotas(counts, ["type"], 0.14).collect()}
    assert got == {"a": 8, "b": 4, "c": 1, "d": 1}
    assert {r["quota"] for r in S.review_quotas(counts.where("type = 'd'"), ["type"], 0.5).collect()} == {1}


def test_review_sample_sees_every_stratum(spark):
    rows = [(i, "a" if i % 10 else "b", None if i % 3 else "x", float(i % 10 and 1 or i)) for i in range(400)]
    df = S.with_order(spark.createDataFrame(rows, "id bigint, type string, subtype string, n double"), 1, "review", F.col("id"))
    picked = S.review_sample(df, "ord").collect()
    assert {(r["type"], r["subtype"]) for r in picked} == {(r[1], r[2]) for r in rows} and len(picked) == 40
    assert all(r["rank"] <= r["quota"] <= r["stratum_rows"] for r in picked)
    spread = S.review_sample(df, "ord", spread=F.col("n")).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in spread}["b"] > 30  # only b varies
    assert S.review_sample(df.limit(0), "ord").count() == 0
