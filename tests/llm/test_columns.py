"""Columns of the input keep their values whatever helper columns an operator has."""

import pytest
from pyspark.sql import functions as F

from tomeworks.llm import exact, extract, lm, neardup, packing
from tomeworks.llm.columns import sheltered

HELPERS = ["_row", "_maybe", "_sha", "_first", "_n", "_h1", "_same", "_class", "_host", "_path", "_levels", "_rest", "_bucket", "_rank", "node", "a.b", "_ROW2"]
LONG = " ".join(f"word{i}" for i in range(60))
TEXTS = [LONG, LONG + " more", "alone here", None, "alone here"]


def wide(spark, name="text", texts=TEXTS):
    rows = [(i, t, *[f"{h}:{i}" for h in HELPERS]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", f"{name} string", *[f"`{h}` string" for h in HELPERS]]))


def assert_kept(rows, n=len(TEXTS)):
    assert len(rows) == n
    for r in rows:
        assert [r[h] for h in HELPERS] == [f"{h}:{r['doc_id']}" for h in HELPERS]


def test_copies(spark):
    rows = exact.copy_groups(wide(spark)).collect()
    assert_kept(rows)
    assert {r.doc_id: r.keep_id for r in rows} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
    stay = exact.drop_copies(wide(spark))
    assert stay.columns == ["doc_id", "text", *HELPERS]
    assert_kept(stay.collect(), 4)


def test_near_copies(spark):
    rows = neardup.classes(wide(spark)).collect()
    assert_kept(rows)
    assert {r.doc_id: r.class_id for r in rows} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}
    stay = neardup.drop_near_copies(wide(spark))
    assert stay.columns == ["doc_id", "text", *HELPERS]
    assert_kept(stay.collect(), 3)


def test_main_text(spark):
    pages = wide(spark, "html", ["<article><p>Some words of an article here.</p></article>"] * 3 + [None, ""]).withColumn("url", F.lit("http://a.example/x"))
    rows = extract.main_text(pages).collect()
    assert_kept(rows)
    assert [r.n_chars for r in sorted(rows, key=lambda r: r.doc_id)] == [30, 30, 30, 0, 0]


def test_packing(spark):
    cut = wide(spark).drop("text").withColumn("length", (F.col("doc_id") * 200 + 100).cast("long"))
    rows = packing.pack(cut, 1024).collect()
    assert_kept(rows)
    assert sorted((r.length, r.offset >= 0) for r in rows)[0] == (100, True)


@pytest.mark.parametrize("most", [256 << 20, 512])
def test_scores(spark, most):
    model = lm.train(wide(spark), max_filter_bytes=most)
    assert_kept(lm.score(model, wide(spark)).collect())


def test_replaced_and_repeated_names(spark):
    df = spark.createDataFrame([(1, "x", "old", 2)], "doc_id long, text string, KEPT string, other int")
    made, (text, key), restore = sheltered(df, "text", "doc_id", replaced=("kept",))
    assert made.columns == ["column_0", "column_1", "column_3"] and (text, key) == ("column_1", "column_0")
    assert restore(made.withColumn("kept", F.lit(True))).columns == ["doc_id", "text", "other", "kept"]
