from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeworks.operators import sketches as S


def test_no_frequent_value_is_missed_after_merging(spark):
    rng = np.random.default_rng(2)
    share = 0.02
    rows = [(int(w), i % 7, f"v{v}") for w in range(3) for i, v in enumerate(np.minimum(rng.zipf(1.3, 6000), 5000))]
    rows += [(0, 0, None)] * 50
    df = spark.createDataFrame(rows, "window int, part int, value string").repartition(16)
    parts = S.window_sketches(df.withColumn("both", F.struct("window", "part")), share, "both")
    merged = S.merged_sketches(parts, F.col("window.window"), share)
    got = {(r.window, r.value): (r.n, r.rows) for r in S.frequent_values(df, merged, share).collect()}
    counts = Counter((w, v) for w, _, v in rows if v is not None)
    assert got == {k: (n, 6000) for k, n in counts.items() if n >= share * 6000} and len(got) > 10
    assert S.candidates(merged, share).count() < 3 * 2 / share


def test_a_value_of_all_rows_and_ties_at_the_share(spark):
    df = spark.createDataFrame([(1, "a")] * 10 + [(2, "a"), (2, "b"), (2, "c"), (2, "d")], "window int, value string")
    got = sorted((r.window, r.value, r.n) for r in S.frequent_values(df, S.window_sketches(df, 0.25), 0.25).collect())
    assert got == [(1, "a", 10), (2, "a", 1), (2, "b", 1), (2, "c", 1), (2, "d", 1)]
    assert S.frequent_values(df.limit(0), S.window_sketches(df.limit(0), 0.25), 0.25).count() == 0
    for share in (0, 1.5, 1e-9):
        with pytest.raises(ValueError):
            S.counters_for(share)


def test_distinct_values_of_loads_without_a_rescan(spark):
    df = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("load"), (F.col("id") % 20_000).alias("x"), F.lit("one").alias("y"))
    df = df.unionByName(spark.range(9000).select(F.lit("new").alias("load"), (F.col("id") + 15_000).alias("x"), F.lit(None).cast("string").alias("y")))
    kept = S.load_sketches(df, F.col("load"), ["x", "y"])
    total = S.distinct_of_all(kept, ["x", "y"]).first()
    assert total.rows == 69_000 and abs(total.x - 24_000) <= 24_000 * 4 / 64 and total.y == 1
    pairs = spark.createDataFrame([("new", "0")], "load string, other string")
    r = S.compared_loads(kept, pairs, ["x", "y"]).first()
    assert abs(r.x_new - 4000) <= 24_000 * 4 / 64 and abs(r.x_shared - 5000) <= 24_000 * 4 / 64 and (r.y_new, r.y_shared) == (0, 0)


def test_the_empty_text_is_a_value(spark):
    df = spark.createDataFrame([(1, ""), (1, "a"), (1, None), (2, "")], "window int, value string")
    kept = S.load_sketches(df, F.col("window"), ["value"])
    assert S.distinct_of_all(kept, ["value"]).first().value == 2
    assert sorted((r.window, r.value, r.n) for r in S.frequent_values(df, S.window_sketches(df, 0.5), 0.5).collect()) == [(1, "", 1), (1, "a", 1), (2, "", 1)]


def test_few_values_are_exact_and_empty_tables(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("load"), (F.col("id") / 2).cast("int").alias("x"))
    kept = S.load_sketches(df, F.col("load"), ["x"])
    assert S.distinct_of_all(kept, ["x"]).first().x == 1500
    r = S.compared_loads(kept, spark.createDataFrame([(0, 1)], "load long, other long"), ["x"]).first()
    assert (r.x_new, r.x_shared) == (0, 1500)
    assert S.load_sketches(df.limit(0), F.col("load"), ["x"]).count() == 0
