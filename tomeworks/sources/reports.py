"""Markdown reports. Spark does the counting; only aggregates and a bounded number of detail
lines reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.operators import evaluation, traces
from tomeworks.operators.validation import verdict

MAX_LINES = 300
TOP_CASES = 10


def _table(header: list[str], rows: list[list]) -> list[str]:
    lines = ["| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
    return lines + ["| " + " | ".join(str(v) for v in row) + " |" for row in rows]


def _issue_lines(issues: DataFrame, level: str) -> list[str]:
    found = issues.where(F.col("level") == level).orderBy("split", "id", "code").limit(MAX_LINES).collect()
    return [f"- [{r['split']}] {r['id']} {r['code']} {r['detail']}".rstrip() for r in found]


def _validation(title: str, samples: DataFrame, issues: DataFrame, kind: str, extra: list[str]) -> str:
    splits = {r["split"]: r["n"] for r in samples.groupBy("split").agg(F.count("*").alias("n")).collect()}
    types = samples.groupBy(F.col(kind).alias("t")).agg(F.count("*").alias("n")).orderBy("t").collect()
    total = sum(splits.values())
    end = verdict(issues).first()
    lines = [
        f"# {title}", "",
        f"- train={splits.get('train', 0)} holdout={splits.get('holdout', 0)} total={total}",
        "- types: " + ", ".join(f"{r['t']}={r['n']}({r['n'] / max(1, total):.0%})" for r in types),
        *extra,
        f"- errors: {end['errors']}", f"- warnings: {end['warnings']}", "",
    ]
    for heading, level in (("Errors", "error"), ("Warnings", "warn")):
        details = _issue_lines(issues, level)
        if details:
            lines += [f"## {heading}", *details, ""]
    return "\n".join(lines)


def render_quality_report(samples: DataFrame, issues: DataFrame) -> str:
    return _validation("Sample validation", samples, issues, "type", [])


def render_messages_report(samples: DataFrame, issues: DataFrame) -> str:
    refused = samples.where(F.col("meta.type") == "refuse").groupBy(F.col("meta.subtype").alias("s"))
    counts = {r["s"]: r["n"] for r in refused.agg(F.count("*").alias("n")).where(F.col("s").isin(*K.REFUSE_SUBTYPES)).collect()}
    line = "- refuse subtypes: " + ", ".join(f"{s}={counts.get(s, 0)}" for s in sorted(K.REFUSE_SUBTYPES))
    return _validation("Messages validation", samples, issues, "meta.type", [line])


def render_evaluation_report(rows: DataFrame, before: str = "base", after: str = "sft") -> str:
    values = {r["metric"]: r for r in evaluation.before_after(evaluation.metrics(rows), before, after).collect()}
    samples = rows.where(F.col("model") == before).count()
    table = [
        [label, f"{values[m]['before']:.2f}", f"{values[m]['after']:.2f}", f"{values[m]['delta']:+.2f}"]
        for m, label in K.METRIC_LABELS if m in values
    ]
    counts = evaluation.bad_case_counts(rows).orderBy("model", "bad_case").collect()
    lines = ["# Evaluation before and after", "", f"- samples: {samples}", "", *_table(["metric", before, after, "Δ"], table)]
    for model in (before, after):
        own = [[r["bad_case"], r["cases"]] for r in counts if r["model"] == model]
        lines += ["", f"## Bad cases of {model}", "", *(_table(["bad case", "rows"], own) if own else ["none"])]
    return "\n".join(lines) + "\n"


def render_bad_case_report(all_traces: DataFrame, bad: DataFrame, candidates: DataFrame) -> str:
    counts = traces.bad_case_counts(bad).orderBy(F.desc("cases"), "name").collect()
    lines = [
        "# Bad cases", "", f"- traces: {all_traces.count()}", f"- bad cases: {bad.count()}",
        f"- golden candidates: {candidates.count()}",
    ]
    for heading, kind in (("By type", "type"), ("By severity", "severity"), ("By provider", "provider")):
        rows = [[r["name"], r["cases"]] for r in counts if r["kind"] == kind]
        if kind == "severity":
            rows.sort(key=lambda r: r[0], reverse=True)
        lines += ["", f"## {heading}", "", *_table([kind, "rows"], rows)]
    top = [
        [f"{r['trace_id'][:20]}...", ",".join(r["bad_types"]), r["severity"], r["suggestion"]]
        for r in traces.top_bad_cases(bad, TOP_CASES).collect()
    ]
    lines += ["", "## Most severe", "", *_table(["trace", "types", "severity", "advice"], top)]
    return "\n".join(lines) + "\n"
