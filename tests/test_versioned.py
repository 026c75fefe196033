import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tomeworks.sources.versioned import KeyedTable

SCHEMA = StructType().add("id", StringType()).add("n", LongType()).add("text", StringType())


def rows_of(df):
    return sorted((r["id"], r["n"], r["text"]) for r in df.collect())


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


@pytest.fixture
def table(spark, tmp_path):
    made = KeyedTable(spark, str(tmp_path / "t"), "id", SCHEMA)
    made.create(spark.createDataFrame([(f"k{i}", i, "old") for i in range(100)], SCHEMA), buckets=8)
    return made


def test_merges_equal_a_dictionary(spark, table):
    held = {f"k{i}": (f"k{i}", i, "old") for i in range(100)}
    for step in range(3):
        changes = [(f"k{i}", i, f"step {step}") for i in range(step * 30, step * 30 + 50, 7)]
        gone = [f"k{i}" for i in range(step, 100, 11)]
        version = table.merge(spark.createDataFrame(changes, SCHEMA), spark.createDataFrame([(g,) for g in gone], "id string"))
        held |= {c[0]: c for c in changes}
        held = {k: v for k, v in held.items() if k not in gone}
        assert version == step + 2 and rows_of(table.read()) == sorted(held.values())
    assert table.versions() == [1, 2, 3, 4] and table.read(1).count() == 100
    table.delete(table.read().select("id"))
    assert rows_of(table.read()) == []
    table.merge(spark.createDataFrame([("new", 1, None)], SCHEMA))
    assert rows_of(table.read()) == [("new", 1, None)]


def test_untouched_buckets_stay_as_they_are(spark, table):
    before = files(table.path)
    table.merge(spark.createDataFrame([("k1", 1, "new")], SCHEMA))
    after = files(table.path)
    assert all(after[f] == t for f, t in before.items())
    added = {f for f in set(after) - set(before) if "/data/" in f and "bucket=" in f}
    assert len({os.path.dirname(f) for f in added}) == 1


def test_readers_keep_their_version(spark, table):
    reader = table.read()
    table.merge(spark.createDataFrame([("k1", 1, "new")], SCHEMA))
    assert reader.where("text = 'new'").count() == 0 and table.read().where("text = 'new'").count() == 1


def test_a_failed_write_leaves_the_version_before(spark, table):
    before = rows_of(table.read())
    broken = spark.createDataFrame([("k1", 1, "x"), ("k2", 2, "y")], SCHEMA).withColumn(
        "text", F.when(F.col("id") == "k2", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        table.merge(broken)
    assert table.versions() == [1] and rows_of(table.read()) == before
    assert table.merge(spark.createDataFrame([("k2", 2, "y")], SCHEMA)) == 2


def test_expired_writes_go(spark, table):
    for i in range(3):
        table.merge(spark.createDataFrame([("k1", i, "new")], SCHEMA))
    want = rows_of(table.read())
    assert table.expire(2) == 1 and table.versions() == [3, 4]
    assert rows_of(table.read()) == want and table.read(3).count() == 100
    with pytest.raises(ValueError):
        table.read(1)
