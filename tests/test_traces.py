import pytest
from pyspark.sql import functions as F

from tomeworks import schemas
from tomeworks.operators import traces as T
from tomeworks.sources import files, reports
from tomeworks.streaming import traces as ST

TRACE = {
    "ts": "2026-01-01T10:00:00+00:00", "task_id": "t", "provider": "base", "model_name": "m", "latency_ms": 10,
    "query_hash": "q", "answer_hash": "a", "answer_chars": 80, "prompt_chars": 100, "context_count": 1,
    "used_citations": ["1"], "is_refusal": False, "has_answer": None, "error": "",
}


def traces(spark, *changes):
    return spark.createDataFrame([{**TRACE, "task_id": f"t{i}", **c} for i, c in enumerate(changes)], schemas.TRACE)


CASES = [
    ({"context_count": 0, "used_citations": []}, ["no_context_answered"]),
    ({"used_citations": []}, ["missing_citation"]),
    ({"provider": "SFT", "is_refusal": True, "used_citations": []}, ["sft_over_refusal_candidate"]),
    ({"latency_ms": 12000, "prompt_chars": 9000, "answer_chars": 18}, ["high_latency", "long_prompt", "short_answer"]),
    ({"context_count": 0, "latency_ms": 8000, "prompt_chars": 8000, "answer_chars": 20},
     ["no_context_answered", "high_latency", "long_prompt", "short_answer"]),
    ({"answer_chars": 0}, ["empty_answer"]),
    ({"error": " timeout "}, ["model_error"]),
    ({"error": "  "}, []),
    ({"answer_chars": None, "context_count": None, "latency_ms": None}, ["empty_answer"]),
]


def test_rules(spark):
    got = traces(spark, *[c for c, _ in CASES]).withColumn("b", T.bad_types()).orderBy(F.length("task_id"), "task_id").collect()
    assert [r["b"] for r in got] == [w for _, w in CASES]


def test_order_and_advice(spark):
    bad = T.mine_bad_cases(traces(spark, CASES[3][0], CASES[0][0], CASES[1][0])).collect()
    assert [r["severity"] for r in bad] == [3, 2, 2] and bad[1]["latency_ms"] == 12000
    assert bad[1]["suggestion"].count("；") == 2 and bad[0]["trace_id"].startswith("sha256:")


def test_golden_keeps_latest(spark):
    miss = {"used_citations": []}
    bad = T.flag_bad_cases(traces(
        spark, {**miss, "ts": "2026-01-01"}, {**miss, "ts": "2026-01-02"},
        {**miss, "query_hash": "", "ts": "2026-01-03"}, {"answer_chars": 5, "query_hash": "low"},
        {**miss, "query_hash": "tie", "latency_ms": 5}, {**miss, "query_hash": "tie", "latency_ms": 9},
    ))
    got = {r["query_hash"]: r for r in T.golden_candidates(bad).collect()}
    assert set(got) == {"q", "tie"}
    latest = {r["trace_id"]: r for r in bad.collect()}
    assert latest[got["q"]["source_trace_id"]]["ts"] == "2026-01-02"
    assert latest[got["tie"]["source_trace_id"]]["latency_ms"] == 5  # the last one listed
    assert sorted(r["candidate_id"] for r in got.values()) == ["golden-candidate-000001", "golden-candidate-000002"]


def test_trace_build(spark):
    row = {
        "task_id": "t", "rewritten_query": "", "query": "这个如何使用", "answer": "按下开关 [1]", "prompt": "p" * 7, "is_stream": None,
        "contexts": [{"chunk_id": "c", "title": "t", "file_title": "f", "score": 0.5}], "intent_type": None,
        "provider": "base", "model_name": "m", "error": None, "latency_ms": 3,
    }
    answers = spark.createDataFrame([row], schemas.ANSWER)
    plain = T.build_traces(answers)
    t = plain.first()
    assert (t["intent_type"], t["used_citations"], t["context_count"], t["prompt_chars"]) == ("operation", ["1"], 1, 7)
    assert not {"query", "answer_preview", "context_sources"} & set(plain.columns)
    full = T.build_traces(answers, include_text=True, include_context=True, max_chars=3).first()
    assert full["query"] == "这个如何使用" and full["context_sources"][0]["rank"] == 1


def test_append_only_when_enabled(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = traces(spark, {}, {"is_refusal": True})
    files.append_traces(rows, path, enabled=False)
    assert files.read_traces(spark, path).count() == 0
    files.append_traces(rows, path)
    files.append_traces(rows, path)
    assert files.read_traces(spark, path).count() == 4


def test_report(spark):
    all_traces = traces(spark, *[c for c, _ in CASES])
    bad = T.flag_bad_cases(all_traces)
    text = reports.render_bad_case_report(all_traces, bad, T.golden_candidates(bad))
    assert "- traces: 9" in text and "| high_latency | 2 |" in text and "| 3 | 5 |" in text


@pytest.fixture
def stream(spark, tmp_path):
    source = str(tmp_path / "in")
    miss = {"used_citations": []}
    traces(spark, {**miss, "ts": "2026-01-01T10:00:00Z"}, {"latency_ms": 9000, "ts": "2026-01-01T10:20:00Z", "query_hash": "r"}).write.json(source)
    traces(spark, {**miss, "ts": "2026-01-01T11:30:00Z"}, {}).write.mode("append").json(source)
    return source


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_equals_batch(spark, stream, tmp_path):
    out, updates = str(tmp_path / "bad"), str(tmp_path / "latest")
    flagged = ST.bad_case_stream(ST.read_trace_stream(spark, stream, max_files=1))
    run(ST.append_stream(flagged, out, str(tmp_path / "c1")))
    batch = T.flag_bad_cases(files.read_traces(spark, stream))
    assert sorted(spark.read.parquet(out).select("trace_id").collect()) == sorted(batch.select("trace_id").collect())

    again = ST.bad_case_stream(ST.read_trace_stream(spark, stream, max_files=1))
    run(ST.write_latest(ST.latest_updates(again), updates, str(tmp_path / "c2")))
    streamed = ST.current_candidates(spark, updates)
    assert sorted(map(tuple, streamed.drop("question", "bad_types", "label_fields").collect())) == sorted(
        map(tuple, T.golden_candidates(batch).drop("question", "bad_types", "label_fields").collect()))


def test_windowed_counts(spark, stream, tmp_path):
    out = str(tmp_path / "counts")
    counts = ST.windowed_counts(ST.bad_case_stream(ST.read_trace_stream(spark, stream)))
    run(ST.append_stream(counts, out, str(tmp_path / "c3")))
    got = {(r["window_start"].hour, r["bad_type"]): r["cases"] for r in spark.read.parquet(out).collect()}
    assert got == {(10, "missing_citation"): 1, (10, "high_latency"): 1}  # the last hour is still open
