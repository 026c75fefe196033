import pytest
from pyspark.sql import functions as F

from tomeworks.operators import history as H
from tomeworks.operators import progress as P
from tomeworks.schemas import CHAT_MESSAGE, TASK_EVENT
from tomeworks.sources import files, tables


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.createDataFrame([("一", None), ("b", 2)], "s string, n int")
    files.write_jsonl(df, path)
    assert sorted(files.read_jsonl(spark, path, "s string, n int").collect()) == sorted(df.collect())
    text = "".join(r[0] for r in spark.read.text(path).collect())
    assert "一" in text and "null" not in text
    assert files.read_jsonl(spark, str(tmp_path / "none"), "s string").count() == 0


def test_broken_lines_are_kept(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"s": "a"}\n\n{broken\n', encoding="utf-8")
    got = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "s string", corrupt=True).collect()
    assert sorted((r["s"] or "", r["_corrupt_record"] or "") for r in got) == [("", "{broken"), ("a", "")]


def test_documents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "甲 1.md").write_text("# a\r\nb", encoding="utf-8")
    for name in ("b.pdf", "c.MD", "noext"):
        (tmp_path / "d" / name).write_text("x", encoding="utf-8")
    docs = files.scan_documents(spark, str(tmp_path / "d")).collect()
    assert [(r["file_title"], r["md_content"]) for r in docs] == [("甲 1", "# a\r\nb")]
    seen = {r["suffix"]: (r["accepted"], r["file_title"]) for r in files.scan_files(spark, str(tmp_path / "d")).collect()}
    assert seen == {".md": (True, "甲 1"), ".pdf": (True, "b"), ".MD": (False, "c"), "": (False, "noext")}


def test_chunk_scan_pushes_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", None, "z"), (2, " ", "n", "z")], "pk bigint, body string, name string, other string").write.parquet(path)
    fields = {"chunk_id": "pk", "content": "body", "item_name": "name"}
    df = tables.load_chunks(spark, path, fields, "pk > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(pk,0)" in plan and "other" not in plan
    assert [tuple(r) for r in df.orderBy("chunk_id").collect()] == [(1, "a", ""), (2, " ", "n")]


def test_chunk_load(spark, tmp_path):
    rows = [("f", 0, [1.0, 2.0], {1: 1.0}), ("f", 1, None, {1: 1.0}), ("f", 2, [1.0, 2.0], {}), ("f", 3, [1.0], {1: 1.0})]
    df = spark.createDataFrame(rows, "file_title string, pos int, dense_vector array<float>, sparse_vector map<int,float>")
    kept, rejects = tables.load_chunk_table(df, 2)
    assert kept.count() == 1 and {r["reason"] for r in rejects.collect()} == {"no dense vector", "no sparse vector", "wrong dimension"}
    path = str(tmp_path / "c")
    tables.append_chunks(kept, path)
    tables.append_chunks(kept, path)
    assert spark.read.parquet(path).select("chunk_id").distinct().count() == 1


def test_chunk_ids_differ_between_documents_of_one_title(spark):
    rows = [(1, "manual", 0, None), (2, "manual", 0, None), (3, "manual", 1, 77)]
    df = spark.createDataFrame(rows, "doc_id long, file_title string, pos int, chunk_id long").withColumns(
        {"dense_vector": F.array(F.lit(1.0)), "sparse_vector": F.create_map(F.lit(1), F.lit(1.0))})
    ids = [{r["doc_id"]: r["chunk_id"] for r in tables.load_chunk_table(df, 1)[0].collect()} for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0].values())) == 3 and ids[0][3] == 77


def test_item_names_fold_on_read(spark, tmp_path):
    path = str(tmp_path / "n")
    df = spark.createDataFrame([("f", "i")], "file_title string, item_name string")
    tables.append_item_names(df, path)
    tables.append_item_names(df, path)
    assert tables.read_item_names(spark, path).count() == 1


@pytest.fixture
def chat(spark):
    return spark.createDataFrame([(f"m{i}", "s", "user", f"t{i}", "", [], float(i)) for i in range(15)], CHAT_MESSAGE)


def test_recent_is_oldest_unless_asked(chat):
    assert {r["ts"] for r in H.recent_messages(chat).collect()} == set(map(float, range(10)))
    assert {r["ts"] for r in H.recent_messages(chat, 2, "newest").collect()} == {13.0, 14.0}


def test_upsert_and_delete(spark, chat):
    new = spark.createDataFrame([("m1", "s", "user", "new", "", [], 1.0), ("m99", "z", "user", "x", "", [], 2.0)], CHAT_MESSAGE)
    both = H.upsert_messages(chat, new)
    assert both.count() == 16 and both.where("text = 'new'").count() == 1
    kept, deleted = H.delete_session(both, spark.createDataFrame([("s",)], "session_id string"))
    assert kept.count() == 1 and deleted.first()["deleted"] == 15


def test_upsert_ties_have_one_winner(spark, chat):
    new = spark.createDataFrame([("m1", "s", "user", t, "", [], 1.0) for t in ("a", "b", "c")], CHAT_MESSAGE)
    found = {H.upsert_messages(chat, new.repartition(n)).where("message_id = 'm1'").first()["text"] for n in (1, 2, 3)}
    assert len(found) == 1


def test_a_restarted_node_keeps_its_place(spark):
    rows = [("t", n, "start", None, i) for i, n in enumerate(["a", "b", "a"])] + [
        ("t", "c", "start", None, 5), ("t", "c", "end", 2.0, 6), ("t", None, "status", None, 7), ("t", None, "status", None, 7)]
    df = spark.createDataFrame(rows, "task_id string, node string, phase string, seconds double, ts long").withColumn(
        "status", F.when(F.col("phase") == "status", F.when(F.rand(1) > 2, "x").otherwise("processing")))
    got = P.task_progress(df).first()
    assert (got["running"], got["done"], got["node_seconds"], got["status"]) == (["a", "b"], ["c"], {"c": 2.0}, "processing")


def test_progress(spark):
    events = [("t", n, p, s, d, f"2026-01-01 00:00:{i:02d}") for i, (n, p, s, d) in enumerate([
        ("a", "start", None, None), (None, "status", "processing", None), ("a", "end", None, 1.234), ("b", "start", None, None)])]
    events += [("done", None, "status", "completed", None, "2026-01-01 00:00:00")]
    df = spark.createDataFrame(events, "task_id string, node string, phase string, status string, seconds double, ts string")
    df = df.withColumn("ts", df["ts"].cast("timestamp")).select(*[c.split()[0] for c in TASK_EVENT.split(", ")])
    got = {r["task_id"]: r for r in P.task_progress(df).collect()}
    t = got["t"]
    assert (t["status"], t["running"], t["done"], t["seconds"]) == ("processing", ["b"], ["a"], 1.23)
    assert round(t["percent"], 4) == round(100 * 1.5 / 7, 4) and got["done"]["percent"] == 100.0
    pdf = spark.createDataFrame([("t",)], "task_id string")
    assert {r["task_id"]: r["percent"] for r in P.task_progress(df, pdf).collect()}["t"] == 100 * 1.5 / 8


def test_sheets_of_one_file_are_spread_over_all_cores(spark):
    from tests.conftest import SF_DIR
    from tomeworks.plans.document_queries import table_sentences

    found = table_sentences(spark, SF_DIR).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(found) >= spark.sparkContext.defaultParallelism
    assert max(r.n for r in found) * 4 <= sum(r.n for r in found)
