"""Trace building, bad-case mining, golden candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.operators import traces as op
from tomeworks.plans import base as b
from tomeworks.plans.base import query, quote

_ANSWERED = "(answer_chars > 0)"
_RULES = {
    "empty_answer": f"NOT {_ANSWERED} OR answer_chars <= 0",
    "model_error": f"{b.sql_strip('error')} <> ''",
    "no_context_answered": f"context_count <= 0 AND {_ANSWERED} AND NOT is_refusal",
    "missing_citation": f"context_count > 0 AND {_ANSWERED} AND NOT is_refusal AND used_citations = ''",
    "sft_over_refusal_candidate": "lower(provider) = 'sft' AND is_refusal AND context_count > 0",
    "high_latency": "latency_ms >= 8000",
    "long_prompt": "prompt_chars >= 8000",
    "short_answer": f"{_ANSWERED} AND NOT is_refusal AND answer_chars BETWEEN 1 AND 20",
}
_TYPES = "list_filter([" + ", ".join(
    f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _RULES.items()) + "], lambda x: x IS NOT NULL)"
_LEVEL = " ".join(f"WHEN '{n}' THEN {lvl}" for n, lvl, _ in K.BAD_TYPES)
_ADVICE = " ".join(f"WHEN '{n}' THEN {quote(text)}" for n, _, text in K.BAD_TYPES)

BAD = f"""flagged AS (SELECT *, {_TYPES} AS types FROM traces),
bad AS (
  SELECT {b.sql_hash("task_id || '|' || query_hash || '|' || answer_hash || '|' || ts")} AS trace_id,
         task_id, ts, provider, model_name, types,
         list_max(list_transform(types, lambda x: CASE x {_LEVEL} END)) AS severity,
         latency_ms, query_hash, answer_hash, answer_chars, prompt_chars, context_count,
         used_citations, is_refusal,
         array_to_string(list_transform(types, lambda x: CASE x {_ADVICE} END), '{K.ADVICE_SEPARATOR}') AS suggestion
  FROM flagged WHERE len(types) > 0)"""

_LATEST = """latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_hash
                                 ORDER BY ts DESC, severity, latency_ms, trace_id DESC) AS n
    FROM bad WHERE severity >= 2 AND query_hash <> '') WHERE n = 1)"""


@query("bad_case_mining", f"""WITH {b.TRACES}, {BAD}
SELECT trace_id, task_id, ts, provider, model_name, array_to_string(types, ',') AS bad_types, severity,
       latency_ms, query_hash, answer_hash, answer_chars, prompt_chars, context_count, used_citations,
       is_refusal, suggestion FROM bad ORDER BY severity DESC, latency_ms DESC, trace_id""")
def bad_case_mining(spark, sf_dir):
    bad = op.mine_bad_cases(b.traces(spark, sf_dir))
    return bad.withColumns({
        "bad_types": F.array_join("bad_types", ","),
        "used_citations": F.array_join("used_citations", ","),
    })


@query("golden_candidates", f"""WITH {b.TRACES}, {BAD}, {_LATEST}
SELECT 'golden-candidate-' || lpad(CAST(row_number() OVER (ORDER BY trace_id) AS VARCHAR), 6, '0') AS candidate_id,
       trace_id AS source_trace_id, query_hash, provider, model_name, array_to_string(types, ',') AS bad_types,
       severity, true AS needs_human_label, '{",".join(K.GOLDEN_LABEL_FIELDS)}' AS label_fields FROM latest""")
def golden_candidates(spark, sf_dir):
    found = op.golden_candidates(op.flag_bad_cases(b.traces(spark, sf_dir)))
    return found.withColumns({
        "bad_types": F.array_join("bad_types", ","), "label_fields": F.array_join("label_fields", ","),
    })


@query("bad_case_report", f"""WITH {b.TRACES}, {BAD}
SELECT 'type' AS kind, name, count(*) AS cases FROM (SELECT unnest(types) AS name FROM bad) GROUP BY name
UNION ALL SELECT 'severity', CAST(severity AS VARCHAR), count(*) FROM bad GROUP BY severity
UNION ALL SELECT 'provider', provider, count(*) FROM bad GROUP BY provider""")
def bad_case_report(spark, sf_dir):
    return op.bad_case_counts(op.flag_bad_cases(b.traces(spark, sf_dir)))


@query("top_bad_cases", f"""WITH {b.TRACES}, {BAD}
SELECT trace_id, severity, latency_ms, array_to_string(types, ',') AS bad_types, suggestion FROM bad
ORDER BY severity DESC, latency_ms DESC, trace_id LIMIT 10""")
def top_bad_cases(spark, sf_dir):
    top = op.top_bad_cases(op.flag_bad_cases(b.traces(spark, sf_dir)))
    return top.select("trace_id", "severity", "latency_ms",
                      F.array_join("bad_types", ",").alias("bad_types"), "suggestion")


def answers(spark, sf_dir):
    """Conversation turns as answered queries."""
    p = b.turn_pairs(spark, sf_dir)
    marks = F.when(F.col("turn") % 3 == 0, " [1] [C2] [10]").when(F.col("turn") % 3 == 1, " [2]").otherwise("")
    sft = F.length("question") % 2 == 0
    return p.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"),
        F.col("question").alias("query"),
        F.when(F.col("turn") == 2, F.concat(F.lit("again: "), "question")).otherwise("").alias("rewritten_query"),
        F.concat("reply", marks).alias("answer"),
        F.concat_ws(" ", "question", "question").alias("prompt"),
        F.lit(False).alias("is_stream"),
        F.transform("lines", lambda line, i: F.struct(
            i.cast("string").alias("chunk_id"), F.substring(line, 1, 10).alias("title"),
            F.lit("conv").alias("file_title"), (F.lit(1.0) / (i + 1)).alias("score"))).alias("contexts"),
        F.when(F.col("turn") == 4, " Operation ").when(F.col("turn") == 0, "other").otherwise(None)
        .cast("string").alias("intent_type"),
        F.when(sft, "sft").otherwise("base").alias("provider"),
        F.when(sft, "tuned").otherwise("plain").alias("model_name"),
        F.lit("").alias("error"),
        (F.length("reply") * 10).cast("bigint").alias("latency_ms"),
        F.col("conv_id").cast("string").alias("stamp"),
    )


_Q = "CASE WHEN turn = 2 THEN 'again: ' || question ELSE question END"
_A = "reply || CASE WHEN turn % 3 = 0 THEN ' [1] [C2] [10]' WHEN turn % 3 = 1 THEN ' [2]' ELSE '' END"
ANSWERS = f"answers AS (SELECT *, {_Q} AS q, {_A} AS a FROM pairs)"


@query("trace_build", f"""WITH {b.PAIRS}, {ANSWERS}
SELECT CAST(conv_id AS VARCHAR) AS ts, conv_id || '-' || turn AS task_id,
       CASE WHEN length(question) % 2 = 0 THEN 'sft' ELSE 'base' END AS provider,
       CASE WHEN length(question) % 2 = 0 THEN 'tuned' ELSE 'plain' END AS model_name,
       false AS is_stream, CAST(length(reply) * 10 AS BIGINT) AS latency_ms,
       {b.sql_hash('q')} AS query_hash, {b.sql_hash('a')} AS answer_hash,
       length(q) AS query_chars, length(a) AS answer_chars, length(question) * 2 + 1 AS prompt_chars,
       len(lines) AS context_count,
       CASE WHEN turn = 4 THEN 'operation' ELSE {b.sql_intent('q', b.DATA_INTENTS)} END AS intent_type,
       array_to_string({b.sql_set('a', '[[](?:C)?([0-9]+)[]]', 1)}, ',') AS used_citations,
       {b.sql_any('a', b.DATA_CUES)} AS is_refusal, {b.sql_strip('a')} <> '' AS has_answer, '' AS error,
       CASE WHEN length(q) <= 60 THEN q ELSE substr(q, 1, 60) || '...[truncated]' END AS query,
       CASE WHEN length(a) <= 60 THEN a ELSE substr(a, 1, 60) || '...[truncated]' END AS answer_preview,
       array_to_string(list_transform(lines, lambda x, i: i || ':' || (i - 1) || ':' || substr(x, 1, 10)), ';') AS sources
FROM answers""")
def trace_build(spark, sf_dir):
    built = op.build_traces(answers(spark, sf_dir), ts=F.col("stamp"), include_text=True, include_context=True,
                            max_chars=60, cues=b.DATA_CUES, intents=b.DATA_INTENTS)
    sources = F.array_join(F.transform("context_sources", lambda s: F.concat_ws(
        ":", s["rank"].cast("string"), s["chunk_id"], s["title"])), ";")
    return built.withColumns({
        "used_citations": F.array_join("used_citations", ","), "sources": sources,
    }).drop("context_sources")


@query("intent_classes", f"""WITH {b.PAIRS}
SELECT intent, count(*) AS queries FROM (
  SELECT {b.sql_intent('question', b.DATA_INTENTS)} AS intent FROM pairs) GROUP BY intent""")
def intent_classes(spark, sf_dir):
    from tomeworks.functions.intent import classify_intent

    p = b.turn_pairs(spark, sf_dir)
    intent = classify_intent(F.col("question"), b.DATA_INTENTS)
    return p.groupBy(intent.alias("intent")).agg(F.count("*").alias("queries"))
