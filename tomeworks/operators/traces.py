"""Answer traces, bad cases and golden-set candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions.intent import IntentWords, resolve_intent
from tomeworks.functions.rendering import context_sources
from tomeworks.functions.text import (
    citations_any, hash_text, is_refusal, nz, strip, text_or_empty, truncate,
)
from tomeworks.operators.sampling import attach_ids, first_per_key


@dataclass(frozen=True)
class TraceLimits:
    latency_ms: int = 8000
    prompt_chars: int = 8000
    short_answer: int = 20
    min_severity: int = 2


def build_traces(
    answers: DataFrame,
    ts: Column | None = None,
    include_text: bool = False,
    include_context: bool = False,
    max_chars: int = 500,
    cues: Sequence[str] = K.TRACE_REFUSAL_CUES,
    intents: IntentWords = K.INTENT_WORDS,
) -> DataFrame:
    """One redacted trace per answer row; texts and sources only on request."""
    limit = max(20, max_chars)
    query = F.coalesce(nz(F.col("rewritten_query")), nz(F.col("query")), F.lit(""))
    answer = text_or_empty(F.col("answer"))
    stamp = ts if ts is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    columns = [
        stamp.alias("ts"),
        text_or_empty(F.col("task_id")).alias("task_id"),
        F.col("provider"),
        F.col("model_name"),
        F.coalesce(F.col("is_stream"), F.lit(False)).alias("is_stream"),
        F.col("latency_ms"),
        hash_text(query).alias("query_hash"),
        hash_text(answer).alias("answer_hash"),
        F.length(query).cast("bigint").alias("query_chars"),
        F.length(answer).cast("bigint").alias("answer_chars"),
        F.length(text_or_empty(F.col("prompt"))).cast("bigint").alias("prompt_chars"),
        F.coalesce(F.array_size("contexts"), F.lit(0)).cast("bigint").alias("context_count"),
        resolve_intent(F.col("intent_type"), query, intents).alias("intent_type"),
        citations_any(answer).alias("used_citations"),
        is_refusal(answer, cues).alias("is_refusal"),
        (strip(answer) != "").alias("has_answer"),
        text_or_empty(F.col("error")).alias("error"),
    ]
    if include_text:
        columns += [truncate(query, limit).alias("query"), truncate(answer, limit).alias("answer_preview")]
    if include_context:
        columns.append(context_sources(F.col("contexts")).alias("context_sources"))
    return answers.select(*columns)


def trace_id() -> Column:
    parts = [text_or_empty(F.col(c).cast("string")) for c in ("task_id", "query_hash", "answer_hash", "ts")]
    return hash_text(F.concat_ws("|", *parts))


def bad_types(limits: TraceLimits = TraceLimits()) -> Column:
    """Names of all rules a trace breaks, in rule order."""
    contexts = F.coalesce(F.col("context_count"), F.lit(0))
    chars = F.coalesce(F.col("answer_chars"), F.lit(0))
    answered = F.coalesce(F.col("has_answer"), chars > 0)
    refused = F.coalesce(F.col("is_refusal"), F.lit(False))
    uncited = F.coalesce(F.array_size("used_citations"), F.lit(0)) == 0
    rules = {
        "empty_answer": ~answered | (chars <= 0),
        "model_error": strip(text_or_empty(F.col("error"))) != "",
        "no_context_answered": (contexts <= 0) & answered & ~refused,
        "missing_citation": (contexts > 0) & answered & ~refused & uncited,
        "sft_over_refusal_candidate": (F.lower(text_or_empty(F.col("provider"))) == "sft") & refused & (contexts > 0),
        "high_latency": F.coalesce(F.col("latency_ms"), F.lit(0)) >= limits.latency_ms,
        "long_prompt": F.coalesce(F.col("prompt_chars"), F.lit(0)) >= limits.prompt_chars,
        "short_answer": answered & ~refused & chars.between(1, limits.short_answer),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def severity(types: Column) -> Column:
    """The highest severity among the given types."""
    return F.greatest(
        F.lit(0), *[F.when(F.array_contains(types, name), level) for name, level, _ in K.BAD_TYPES]
    )


def suggestion(types: Column) -> Column:
    """Advice for the given types, in their order."""
    advice = F.create_map(*[F.lit(v) for name, _, text in K.BAD_TYPES for v in (name, text)])
    return F.array_join(F.transform(types, lambda t: advice[t]), K.ADVICE_SEPARATOR)


def _optional(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def flag_bad_cases(traces: DataFrame, limits: TraceLimits = TraceLimits()) -> DataFrame:
    """Bad-case records, unordered: narrow, stateless, the same on a stream."""
    texts = _optional(traces, ["query", "answer_preview"])
    flagged = traces.withColumn("bad_types", bad_types(limits)).where(F.size("bad_types") > 0)
    return flagged.select(
        trace_id().alias("trace_id"),
        *[text_or_empty(F.col(c)).alias(c) for c in ("task_id", "ts", "provider", "model_name")],
        "bad_types",
        severity(F.col("bad_types")).alias("severity"),
        F.coalesce(F.col("latency_ms"), F.lit(0)).cast("bigint").alias("latency_ms"),
        *[text_or_empty(F.col(c)).alias(c) for c in ("query_hash", "answer_hash")],
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
          for c in ("answer_chars", "prompt_chars", "context_count")],
        F.coalesce(F.col("used_citations"), F.array().cast("array<string>")).alias("used_citations"),
        F.coalesce(F.col("is_refusal"), F.lit(False)).alias("is_refusal"),
        suggestion(F.col("bad_types")).alias("suggestion"),
        *[nz(F.col(c)).alias(c) for c in texts],
    )


def mine_bad_cases(traces: DataFrame, limits: TraceLimits = TraceLimits()) -> DataFrame:
    """Bad cases, most severe and slowest first."""
    return flag_bad_cases(traces, limits).orderBy(
        F.desc("severity"), F.desc("latency_ms"), "trace_id"
    )


def latest_bad_cases(bad: DataFrame, min_severity: int = 2) -> DataFrame:
    """The latest severe bad case of each query; ties go to the one listed last."""
    eligible = bad.where((F.col("severity") >= min_severity) & (F.col("query_hash") != ""))
    order = [F.desc("ts"), F.asc("severity"), F.asc("latency_ms"), F.desc("trace_id")]
    return first_per_key(eligible, ["query_hash"], order).drop("_rank")


def number_candidates(latest: DataFrame) -> DataFrame:
    """Golden-set candidates numbered by trace id; labels are left to people."""
    numbered = attach_ids(latest, F.lit("golden-candidate"), "trace_id", name="candidate_id")
    return numbered.select(
        "candidate_id",
        F.col("trace_id").alias("source_trace_id"),
        "query_hash", "provider", "model_name", "bad_types", "severity",
        F.lit(True).alias("needs_human_label"),
        F.array(*[F.lit(f) for f in K.GOLDEN_LABEL_FIELDS]).alias("label_fields"),
        *[F.col(c).alias("question") for c in _optional(latest, ["query"])],
    )


def golden_candidates(bad: DataFrame, min_severity: int = 2) -> DataFrame:
    return number_candidates(latest_bad_cases(bad, min_severity))


def bad_case_counts(bad: DataFrame) -> DataFrame:
    """Counts by type, severity and provider as ``(kind, name, cases)``."""
    # One pass: every case becomes its severity, its provider and its types.
    facets = bad.select(
        F.explode(
            F.concat(
                F.transform("bad_types", lambda t: F.struct(F.lit("type").alias("kind"), t.alias("name"))),
                F.array(
                    F.struct(F.lit("severity").alias("kind"), F.col("severity").cast("string").alias("name")),
                    F.struct(F.lit("provider").alias("kind"), F.col("provider").alias("name")),
                ),
            )
        ).alias("f")
    )
    return facets.groupBy(F.col("f.kind").alias("kind"), F.col("f.name").alias("name")).agg(
        F.count("*").alias("cases")
    )


def top_bad_cases(bad: DataFrame, n: int = 10) -> DataFrame:
    return bad.orderBy(F.desc("severity"), F.desc("latency_ms"), "trace_id").limit(n)
