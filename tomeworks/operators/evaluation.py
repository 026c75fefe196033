"""Scoring predictions against a holdout, before and after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions import rendering as R
from tomeworks.functions.text import (
    available_citations, citations_n, fill, is_refusal, is_subset, nz, parse_model_json, question_of,
    text_or_empty,
)

JUDGE = "faithful int, complete int"


def identified(holdout: DataFrame, pos: str = "pos") -> DataFrame:
    """Samples without an id get ``sample-000001`` by their one-based position ``pos``."""
    number = F.col(pos).cast("string")
    wide = F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0"))
    name = F.coalesce(nz(F.col("meta.id")), F.concat(F.lit("sample-"), wide))
    return holdout.withColumn("meta", F.col("meta").withField("id", name))


def constant_predictor(holdout: DataFrame, model: str = "base", text: str = K.CONSTANT_PREDICTION) -> DataFrame:
    """A model that always answers the same, to check that refusal metrics notice."""
    return holdout.select(F.col("meta.id").alias("id"), F.lit(model).alias("model"), F.lit(text).alias("prediction"))


def echo_predictor(holdout: DataFrame, model: str = "sft") -> DataFrame:
    """A model that returns the gold answer, to check the upper bound."""
    return holdout.select(F.col("meta.id").alias("id"), F.lit(model).alias("model"), gold_answer().alias("prediction"))


def gold_answer() -> Column:
    return text_or_empty(F.try_element_at("messages", F.lit(-1))["content"])


def judge_requests(rows: DataFrame, template: str) -> DataFrame:
    """Prompts for a judge model, only for rows it has to decide; ``{user}`` and ``{answer}``."""
    asked = rows.where(~F.col("should_refuse") & ~F.col("did_refuse"))
    return asked.select("id", "model", fill(template, user=F.col("user"), answer=F.col("prediction")).alias("prompt"))


def parse_judge(outputs: DataFrame) -> DataFrame:
    """``faithful, complete`` from the judge's raw ``output``; NULL where it is unusable."""
    parsed = outputs.withColumn("_j", parse_model_json(F.col("output"), JUDGE))
    return parsed.withColumns({"faithful": F.col("_j.faithful"), "complete": F.col("_j.complete")}).drop("_j", "output")


def bad_case() -> Column:
    should, did = F.col("should_refuse"), F.col("did_refuse")
    return (
        F.when(should & ~did, "missed_refusal")
        .when(~should & did, "false_refusal")
        .when(~F.col("citation_ok"), "citation_invalid")
        .when(F.col("faithful") == 0, "unfaithful")
        .when(F.col("complete") == 0, "incomplete")
    )


def score_rows(holdout: DataFrame, predictions: DataFrame, judged: DataFrame | None = None,
               cues: Sequence[str] = K.REFUSAL_CUES) -> DataFrame:
    """One row per holdout sample and model."""
    user = R.turn(F.col("messages"), 1)
    gold = holdout.select(
        F.col("meta.id").alias("id"), F.col("meta.type").alias("type"), F.col("meta.subtype").alias("subtype"),
        question_of(user).alias("question"), gold_answer().alias("gold"), available_citations(user).alias("_offered"),
        (text_or_empty(F.col("meta.type")) == "refuse").alias("should_refuse"),
    )
    told = predictions.select("id", "model", text_or_empty(F.col("prediction")).alias("prediction"))
    if judged is not None:
        told = told.join(judged.select("id", "model", "faithful", "complete"), ["id", "model"], "left")
    else:
        none = F.lit(None).cast("int")
        told = told.withColumns({"faithful": none, "complete": none})
    rows = gold.join(told, "id").withColumn("did_refuse", is_refusal(F.col("prediction"), cues))
    open_ = ~F.col("should_refuse") & ~F.col("did_refuse")
    used = citations_n(F.col("prediction"))
    rows = rows.withColumns({
        "citation_ok": F.when(open_, (F.size(used) > 0) & is_subset(used, F.col("_offered"))),
        "faithful": F.when(open_, F.col("faithful")),
        "complete": F.when(open_, F.col("complete")),
    })
    return rows.withColumn("bad_case", bad_case()).drop("_offered")


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def metrics(rows: DataFrame, subtypes: Sequence[str] = K.REFUSE_SUBTYPES) -> DataFrame:
    """``model, metric, value``: a partial aggregate of counters per model, then ratios.
    Subtype recalls and judge metrics are left out where there is nothing to count."""
    should, did = F.col("should_refuse"), F.col("did_refuse")
    counters = rows.groupBy("model").agg(
        F.count_if(should & did).alias("tp"), F.count_if(should & ~did).alias("fn"),
        F.count_if(~should & did).alias("fp"), F.count_if(~should & ~did).alias("tn"),
        F.count("citation_ok").alias("cited"), F.count_if("citation_ok").alias("cited_ok"),
        F.count("faithful").alias("judged_f"), F.sum("faithful").alias("f_ok"),
        F.count("complete").alias("judged_c"), F.sum("complete").alias("c_ok"),
        *[F.count_if(F.col("subtype") == s).alias(f"n_{s}") for s in subtypes],
        *[F.count_if((F.col("subtype") == s) & did).alias(f"r_{s}") for s in subtypes],
    )
    c = F.col
    precision, recall = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("tp") + c("fn"))
    values = {
        "refusal_precision": precision,
        "refusal_recall": recall,
        "refusal_f1": _ratio(2 * precision * recall, precision + recall),
        "false_refusal": _ratio(c("fp"), c("fp") + c("tn")),
        **{f"recall_{s}": F.when(c(f"n_{s}") > 0, _ratio(c(f"r_{s}"), c(f"n_{s}"))) for s in subtypes},
        "citation_validity": _ratio(c("cited_ok"), c("cited")),
        "faithfulness": F.when(c("judged_f") > 0, _ratio(c("f_ok"), c("judged_f"))),
        "completeness": F.when(c("judged_c") > 0, _ratio(c("c_ok"), c("judged_c"))),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values.items()])
    long = counters.select("model", F.explode(pairs).alias("m"))
    return long.select("model", "m.metric", "m.value").where(F.col("value").isNotNull())


def before_after(values: DataFrame, before: str = "base", after: str = "sft") -> DataFrame:
    """``metric, before, after, delta`` for metrics both models have."""
    a = values.where(F.col("model") == before).select("metric", F.col("value").alias("before"))
    b = values.where(F.col("model") == after).select("metric", F.col("value").alias("after"))
    return a.join(b, "metric").withColumn("delta", F.col("after") - F.col("before"))


def bad_case_counts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("bad_case").isNotNull()).groupBy("model", "bad_case").agg(F.count("*").alias("cases"))


def bad_cases(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("bad_case").isNotNull())


def check_schema(holdout: DataFrame) -> DataFrame:
    """One row: sample count, and whether every sample has the three turns in order."""
    return holdout.agg(
        F.count("*").alias("samples"), F.count_if(~R.roles_valid(F.col("messages"))).alias("invalid")
    ).withColumn("ok", (F.col("samples") > 0) & (F.col("invalid") == 0))


def promotion_gate(values: DataFrame, before: str = "base", after: str = "sft") -> DataFrame:
    """Whether the tuned model may go on: recall up, false refusals not up, citations not down."""
    delta = F.col("delta")
    rule = (
        F.when(F.col("metric") == "refusal_recall", delta > 0)
        .when(F.col("metric") == "false_refusal", delta <= 0)
        .when(F.col("metric") == "citation_validity", delta >= 0)
    )
    return before_after(values, before, after).withColumn("ok", rule).where(F.col("ok").isNotNull())
