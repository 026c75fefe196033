"""Rules over sample sets. Findings are rows; nothing raises inside a job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions import rendering as R
from tomeworks.functions.text import (
    available_citations, citations_c, citations_n, contains_any, fingerprint, is_refusal, is_subset,
    message_fingerprint, numbers_in, strip, text_or_empty,
)
from tomeworks.operators.sampling import join_counted
from tomeworks.operators.settle import settle

MAX_CHARS = 3000
MIN_CONTEXT = 20
ISSUE = "struct<level:string,code:string,detail:string>"


def _issue(rule: Column, level: str, code: str, detail: Column | None = None) -> Column:
    text = F.lit("") if detail is None else text_or_empty(detail.cast("string"))
    found = F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("detail"))
    return F.when(F.coalesce(rule, F.lit(False)), found)


def _issues(df: DataFrame, found: Sequence[Column], *keep: str) -> DataFrame:
    rows = df.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("i"))
    return rows.select(*keep, "i.level", "i.code", "i.detail")


def _joined(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def validate_samples(
    samples: DataFrame, max_chars: int = MAX_CHARS, cues: Sequence[str] = K.REFUSAL_CUES,
    conflict_cues: Sequence[str] = K.CONFLICT_CUES, strict: bool = False, min_context: int = MIN_CONTEXT,
) -> DataFrame:
    """Issues of stage-1 samples as ``id, split, level, code, detail``. One pass, no shuffle.

    ``strict`` adds three errors: several-chunk samples of fewer than two contexts, contexts that are blank
    or shorter than ``min_context`` characters, and blank answers.
    """
    kind, answer = F.col("type"), text_or_empty(F.col("answer"))
    contexts = F.coalesce("contexts", F.array().cast("array<struct<cid:string,source:string,text:string>>"))
    offered = F.transform(contexts, lambda c: text_or_empty(c["cid"]))
    used = citations_c(answer)
    answering = kind.isin("answerable", "multi_chunk")
    declining = kind.isin("unanswerable", "conflicting")
    refused = is_refusal(answer, cues)
    known = F.flatten(F.transform(contexts, lambda c: F.array_union(numbers_in(c["text"]), numbers_in(c["source"]))))
    extra = F.array_except(numbers_in(answer), F.array_union(known, numbers_in(F.col("question"))))
    length = R.rendered_length(F.col("question"), answer, contexts)
    found = [
        *[_issue(F.col(c).isNull(), "error", "missing_field", F.lit(c)) for c in ("id", "type", "question", "answer", "contexts")],
        _issue(kind.isNull() | ~kind.isin(*K.STAGE1_TYPES), "error", "invalid_type", kind),
        _issue(~is_subset(used, offered), "error", "citation_out_of_range", _joined(F.array_except(used, offered))),
        _issue(answering & (F.size(contexts) == 0), "error", "no_contexts"),
        _issue(answering & (F.size(used) == 0), "error", "no_citation"),
        _issue(answering & refused, "error", "should_not_refuse"),
        _issue(declining & ~refused, "error", "should_refuse"),
        _issue((kind == "conflicting") & ~contains_any(answer, conflict_cues), "error", "conflict_not_mentioned"),
        _issue((kind == "conflicting") & (F.size(used) < 2), "warn", "few_conflict_citations"),
        _issue((kind == "unanswerable") & (F.size(extra) > 0), "warn", "extra_numbers", _joined(extra)),
        _issue(length > max_chars, "warn", "too_long", length),
    ]
    if strict:
        short = F.filter(contexts, lambda c: F.length(strip(text_or_empty(c["text"]))) < min_context)
        found += [
            _issue((kind == "multi_chunk") & (F.size(contexts) < 2), "error", "few_contexts", F.size(contexts)),
            _issue(F.size(short) > 0, "error", "short_context", _joined(F.transform(short, lambda c: text_or_empty(c["cid"])))),
            _issue(strip(answer) == "", "error", "empty_answer"),
        ]
    return _issues(samples, found, "id", "split")


def validate_messages(
    samples: DataFrame, max_chars: int = MAX_CHARS, cues: Sequence[str] = K.REFUSAL_CUES,
    format_cues: Sequence[str] = K.FORMAT_CUES,
) -> DataFrame:
    """Issues of messages samples. Wrong roles hide all other findings of that sample."""
    kind = F.col("meta.type")
    user, answer = R.turn(F.col("messages"), 1), R.turn(F.col("messages"), 2)
    used, offered = citations_n(answer), available_citations(user)
    grounded = kind.isin(*K.GROUNDED_TYPES)
    refused = is_refusal(answer, cues)
    length = R.messages_length(F.col("messages"))
    ok = R.roles_valid(F.col("messages"))
    subtype = F.col("meta.subtype")
    found = [
        _issue(~ok, "error", "invalid_roles", F.array_join(R.roles(F.col("messages")), ",")),
        _issue(ok & (kind.isNull() | ~kind.isin(*K.STAGE2_TYPES)), "error", "invalid_type", kind),
        _issue(ok & ~(user.contains(K.CONTEXT_SECTION) & user.contains(K.QUESTION_SECTION)), "error", "missing_sections"),
        _issue(ok & (strip(answer) == ""), "error", "empty_answer"),
        _issue(ok & (F.coalesce(F.array_size("meta.battle_capabilities"), F.lit(0)) == 0), "error", "missing_capabilities"),
        _issue(ok & grounded & refused, "error", "should_not_refuse"),
        _issue(ok & grounded & (F.size(used) == 0), "error", "no_citation"),
        _issue(ok & grounded & ~is_subset(used, offered), "error", "citation_out_of_range",
               _joined(F.array_except(used, offered))),
        _issue(ok & (kind == "refuse") & ~refused, "error", "did_not_refuse"),
        _issue(ok & (kind == "refuse") & (subtype.isNull() | ~subtype.isin(*K.REFUSE_SUBTYPES)), "error",
               "invalid_subtype", subtype),
        _issue(ok & (kind == "format") & ~contains_any(answer, format_cues), "warn", "no_structure_cue"),
        _issue(ok & (length > max_chars), "warn", "too_long", length),
    ]
    named = samples.withColumn("id", F.coalesce("meta.id", F.lit("?")))
    return _issues(named, found, "id", "split")


def sample_fingerprint() -> Column:
    return fingerprint(F.col("question"), F.transform("contexts", lambda c: c["text"]))


def messages_fingerprint() -> Column:
    return message_fingerprint(R.turn(F.col("messages"), 1))


def duplicate_issues(samples: DataFrame, fp: Column, pos: str, id_: str = "id") -> DataFrame:
    """Second and later copies within and across splits, naming the first; train comes first.

    Texts are hashed in one pass over them. The first of each fingerprint is found by a partially
    aggregated minimum; copies join it back, those of a very frequent text in several tasks.
    """
    place = F.struct(
        F.when(F.col("split") == "train", 0).otherwise(1).alias("s"), F.col(pos).alias("p"), F.col(id_).alias("i"),
        F.col("split").alias("split"),
    )
    keyed = settle(samples.select(F.col(id_).alias("id"), "split", fp.alias("_fp"), place.alias("_at")))
    firsts = keyed.groupBy("_fp").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    copies = join_counted(keyed, firsts, "_fp", "_n", F.struct("id", "_at")).where(F.col("_at") != F.col("_first"))
    return copies.select(
        "id", "split", F.lit("error").alias("level"), F.lit("duplicate").alias("code"),
        F.concat_ws(":", "_first.split", F.col("_first.i").cast("string")).alias("detail"),
    )


def ratio_drift(samples: DataFrame, targets: Mapping[str, float], tolerance: float = 0.10) -> DataFrame:
    """``type, actual, target, drifted`` for every target type, also those without rows."""
    counts = samples.groupBy("type").agg(F.count("*").alias("rows"))
    wanted = samples.sparkSession.createDataFrame(list(targets.items()), "type string, target double")
    total = F.greatest(counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar(), F.lit(1))
    joined = wanted.join(counts, "type", "left").withColumn("actual", F.coalesce("rows", F.lit(0)) / total)
    return joined.select(
        "type", "actual", "target", (F.abs(F.col("actual") - F.col("target")) > tolerance).alias("drifted")
    )


def coverage(samples: DataFrame, types: Sequence[str] = K.STAGE2_TYPES,
             subtypes: Sequence[str] = K.REFUSE_SUBTYPES) -> DataFrame:
    """``kind, name`` of each type and refusal subtype without a sample."""
    domain = samples.sparkSession.createDataFrame(
        [("type", t) for t in types] + [("refuse subtype", s) for s in subtypes], "kind string, name string"
    )
    # Distinct pairs first: a handful of rows whatever the size of the sample set.
    seen = samples.select(F.col("meta.type").alias("t"), F.col("meta.subtype").alias("s")).distinct()
    names = seen.select(F.lit("type").alias("kind"), F.col("t").alias("name")).union(
        seen.where(F.col("t") == "refuse").select(F.lit("refuse subtype"), "s")
    )
    return domain.join(names, ["kind", "name"], "left_anti")


def verdict(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether the set passes."""
    return issues.agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings")
    ).withColumn("passed", F.col("errors") == 0)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("split", "level", "code").agg(F.count("*").alias("rows"))


def quality_gates(export_stats: DataFrame, samples: DataFrame, issues: DataFrame,
                  required: Sequence[str] = ("answerable", "multi_chunk", "unanswerable")) -> DataFrame:
    """``gate, value, ok`` before a sample set is handed on."""
    built = samples.agg(
        F.count("*").alias("built"), *[F.count_if(F.col("type") == t).alias(t) for t in required]
    )
    missing = sum((F.when(F.col(t) == 0, 1).otherwise(0) for t in required), F.lit(0))
    parts = [
        (export_stats, "exported", F.col("total_exported"), F.col("total_exported") > 0),
        (export_stats, "distinct_items", F.col("distinct_items"), F.col("distinct_items") >= 2),
        (built, "samples", F.col("built"), F.col("built") > 0),
        (built, "missing_types", missing, missing == 0),
        (verdict(issues), "errors", F.col("errors"), F.col("errors") == 0),
    ]
    rows = [df.select(F.lit(name).alias("gate"), v.cast("bigint").alias("value"), ok.alias("ok")) for df, name, v, ok in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def format_gates(samples: DataFrame) -> DataFrame:
    """``gate, value, ok``: rows of a messages set whose roles, type or capabilities are not as they must be."""
    wrong = {
        "roles": ~R.roles_valid(F.col("messages")),
        "type": text_or_empty(F.col("meta.type")) == "",
        "capabilities": F.coalesce(F.array_size("meta.battle_capabilities"), F.lit(0)) == 0,
    }
    counts = samples.agg(*[F.count_if(rule).alias(name) for name, rule in wrong.items()])
    return counts.unpivot([], list(wrong), "gate", "value").withColumn("ok", F.col("value") == 0)


def pretrain_check(samples: DataFrame) -> DataFrame:
    """``id, problem`` of rows a trainer would choke on: turns, role order, empty answer."""
    size = F.coalesce(F.array_size("messages"), F.lit(0))
    roles = F.array_join(R.roles(F.col("messages")), ",")
    empty = R.turn(F.col("messages"), 2) == ""
    found = F.array_compact(F.array(
        F.when(size != 3, "messages must have 3 turns"),
        F.when((size == 3) & ~R.roles_valid(F.col("messages")), F.concat(F.lit("invalid roles "), roles)),
        F.when((size == 3) & empty, "empty assistant content"),
    ))
    return samples.select(F.col("meta.id").alias("id"), F.explode(found).alias("problem"))
