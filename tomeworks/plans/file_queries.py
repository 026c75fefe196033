"""Files written from a given table and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tomeworks.operators.settle import shared_folder
from tomeworks.plans import base as b
from tomeworks.plans.base import query
from tomeworks.sources import files as S
from tomeworks.sources import tables as T


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "SELECT doc_id, lang, text FROM documents", headline=False)
def jsonl_round_trip(spark, sf_dir):
    path = folder(spark)
    S.write_jsonl(b.documents(spark, sf_dir).select("doc_id", "lang", "text"), path)
    return S.read_jsonl(spark, path, "doc_id bigint, lang string, text string")


@query("stats_file", f"""WITH {b.CHUNKS}
SELECT count(*) FILTER (WHERE {b.sql_strip('content')} <> '') AS total_exported, count(*) FILTER (WHERE {b.sql_strip('content')} = '') AS empty_content_skipped
FROM chunks""", headline=False)
def stats_file(spark, sf_dir):
    path = folder(spark)
    S.write_stats(T.export_chunks(b.chunks(spark, sf_dir))[1], path)
    return S.read_jsonl(spark, path, "total_exported bigint, empty_content_skipped bigint")


@query("chunk_backup", f"""WITH {b.CHUNKS} SELECT file_title, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY file_title""", headline=False)
def chunk_backup(spark, sf_dir):
    path = folder(spark)
    S.write_chunks(b.chunks(spark, sf_dir), path)
    back = S.read_jsonl(spark, path, "file_title string, content string")
    return back.groupBy("file_title").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("trace_log", f"""WITH {b.TRACES} SELECT task_id, provider, latency_ms, prompt_chars FROM traces""", headline=False)
def trace_log(spark, sf_dir):
    """Traces appended in two batches; a third, with tracing off, leaves nothing."""
    path = folder(spark)
    traces = b.traces(spark, sf_dir)
    S.append_traces(traces.where("provider = 'sft'"), path)
    S.append_traces(traces.where("provider <> 'sft'"), path)
    S.append_traces(traces, path, enabled=False)
    return S.read_traces(spark, path).select("task_id", "provider", "latency_ms", "prompt_chars")


@query("item_name_log", "SELECT DISTINCT source AS file_title, lang AS item_name FROM documents", headline=False)
def item_name_log(spark, sf_dir):
    path = folder(spark)
    names = b.documents(spark, sf_dir).select(F.col("source").alias("file_title"), F.col("lang").alias("item_name"))
    T.append_item_names(names, path)
    T.append_item_names(names.distinct(), path)
    return T.read_item_names(spark, path)
