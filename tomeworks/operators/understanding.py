"""Query understanding on tables: parsed model output, item alignment, decisions, metrics.

These follow the written plan for the query side; thresholds are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.functions.intent import IntentWords, resolve_intent
from tomeworks import constants as K
from tomeworks.functions.text import nz, parse_model_json, text_or_empty
from tomeworks.operators.retrieval import rrf, search_both, search_dense
from tomeworks.operators.sampling import first_per_key

PARSED = "candidate_items array<string>, item_names array<string>, rewritten_query string, intent_type string"

STRATEGIES = {
    "operation": ("hybrid", "hyde"),
    "install_config": ("hybrid", "hyde"),
    "troubleshooting": ("hybrid", "hyde"),
    "parameter": ("hybrid",),
    "image_request": ("hybrid", "image_boost"),
    "comparison": ("multi_item_hybrid",),
    "after_sales": ("hybrid",),
    "general": ("hybrid", "hyde"),
}


def parse_query_understanding(df: DataFrame, words: IntentWords = K.INTENT_WORDS) -> DataFrame:
    """``candidate_items, rewritten_query, intent_type`` from ``query`` and raw ``output``; an
    unusable output leaves the query as it is, without candidates."""
    parsed = df.withColumn("_p", parse_model_json(F.col("output"), PARSED))
    rewritten = F.coalesce(nz(F.col("_p.rewritten_query")), text_or_empty(F.col("query")))
    items = F.coalesce("_p.candidate_items", "_p.item_names", F.array().cast("array<string>"))
    return parsed.withColumns({
        "candidate_items": F.array_distinct(F.filter(items, lambda i: text_or_empty(i) != "")),
        "rewritten_query": rewritten,
        "intent_type": resolve_intent(F.col("_p.intent_type"), rewritten, words),
    }).drop("_p", "output")


def align_items(candidates: DataFrame, item_names: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, item_name, score``: nearest known item names of each candidate vector."""
    names = item_names.select(F.col("item_id").alias("chunk_id"), "dense_vector")
    hits = search_dense(candidates, names, k)
    labels = item_names.select(F.col("item_id").alias("chunk_id"), "item_name")
    return hits.join(labels, "chunk_id").groupBy("query_id", "item_name").agg(F.max("score").alias("score"))


def decide_item(aligned: DataFrame, high: float = 0.75, mid: float = 0.45, gap: float = 0.08,
                max_options: int = 3) -> DataFrame:
    """``query_id, action, item_name, options``: confirm, clarify, or search without an item."""
    order = [F.desc("score"), F.asc("item_name")]
    top = first_per_key(aligned, ["query_id"], order, max(2, max_options), rank="n")
    best = top.groupBy("query_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("item_name"))).alias("first"),
        F.max(F.when(F.col("n") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("n") == 2, F.col("score"))).alias("s2"),
        F.array_sort(F.collect_list(F.when((F.col("n") <= max_options) & (F.col("score") >= mid),
                                           F.struct("n", "item_name")))).alias("near"),
    )
    clear = (F.col("s1") >= high) | ((F.col("s1") >= mid) & (F.col("s1") - F.coalesce("s2", F.lit(0.0)) >= gap))
    action = F.when(clear, "confirm").when(F.size("near") > 1, "clarify").when(
        F.size("near") == 1, "confirm").otherwise("no_filter")
    decided = best.withColumn("action", action)
    return decided.select(
        "query_id", "action",
        F.when(F.col("action") == "confirm", F.col("first")).alias("item_name"),
        F.when(F.col("action") == "clarify", F.transform("near", lambda r: r["item_name"]))
        .otherwise(F.array().cast("array<string>")).alias("options"),
    )


def retrieval_strategy(intent: Column) -> Column:
    table = F.create_map(*[
        c for name, steps in STRATEGIES.items() for c in (F.lit(name), F.array(*[F.lit(s) for s in steps]))
    ])
    return F.coalesce(F.try_element_at(table, intent), F.try_element_at(table, F.lit("general")))


def search_hybrid(queries: DataFrame, chunks: DataFrame, k: int = 4, depth: int = 20, k0: int = 60) -> DataFrame:
    """Dense and sparse rankings of one pass, fused by reciprocal rank."""
    return rrf([search_both(queries, chunks, depth)], k, k0)


def query_metrics(labelled: DataFrame, k: int = 5) -> DataFrame:
    """One row of rates over labelled queries; NULL where there is nothing to rate."""
    clarified = F.col("need_clarification")
    hit = F.arrays_overlap(F.slice("retrieved", 1, k), F.col("relevant"))
    wants_image = F.col("gold_intent") == "image_request"

    def rate(condition: Column, among: Column) -> Column:
        return F.avg(F.when(among, F.coalesce(condition, F.lit(False)).cast("double")))

    return labelled.agg(
        rate(F.col("intent") == F.col("gold_intent"), F.col("gold_intent").isNotNull()).alias("intent_accuracy"),
        rate(F.col("item") == F.col("gold_item"), F.col("gold_item").isNotNull()).alias("item_match_accuracy"),
        rate(F.col("gold_clarification"), clarified).alias("clarification_precision"),
        rate(hit, F.size("relevant") > 0).alias("retrieval_hit_rate"),
        rate(F.col("has_image_context"), wants_image).alias("image_request_hit_image_context"),
    )


def intent_rules(gap: float = 0.08, low: float = 0.45, shares: Sequence[float] = (0.3, 0.05, 0.2, 0.05, 0.05)) -> list[tuple[str, Column, float]]:
    """The five planned buckets with the share of traces above which each is reported.

    They read ``intent_type, item_score, score_gap, clarified, has_image_context, has_spec_context``.
    """
    intent = F.col("intent_type")
    rules = (
        ("intent_unknown_high_freq", intent == "general"),
        ("clarification_missing", (F.col("score_gap") < gap) & ~F.col("clarified")),
        ("item_alignment_low_confidence", F.col("item_score") < low),
        ("image_intent_no_image_context", (intent == "image_request") & ~F.col("has_image_context")),
        ("parameter_intent_no_spec_context", (intent == "parameter") & ~F.col("has_spec_context")),
    )
    return [(name, rule, share) for (name, rule), share in zip(rules, shares, strict=True)]


def intent_buckets(traces: DataFrame, window: Column, rates: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """``bucket, window, traces, flagged, rate`` for each rule whose share exceeds its threshold."""
    rules = F.array(*[
        F.struct(F.lit(name).alias("bucket"), F.coalesce(rule, F.lit(False)).alias("hit"), F.lit(limit).alias("limit"))
        for name, rule, limit in rates
    ])
    rows = traces.select(window.alias("window"), F.explode(rules).alias("r"))
    grouped = rows.groupBy("window", F.col("r.bucket").alias("bucket"), F.col("r.limit").alias("limit")).agg(
        F.count("*").alias("traces"), F.count_if("r.hit").alias("flagged")
    )
    return grouped.withColumn("rate", F.col("flagged") / F.col("traces")).where(F.col("rate") > F.col("limit")).drop("limit")
