import pytest
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks import schemas
from tomeworks.operators import evaluation as E
from tomeworks.operators import validation as V
from tomeworks.sources import reports

CTX = [{"cid": "C1", "source": "s", "text": "电压 220"}]
GOOD = {"id": "x", "type": "answerable", "question": "q", "answer": "是 [C1]", "contexts": CTX, "meta": None, "split": "train"}


def samples(spark, *changes):
    return spark.createDataFrame([{**GOOD, "id": f"s{i}", "question": f"q{i}", **c} for i, c in enumerate(changes)], schemas.SAMPLE)


@pytest.mark.parametrize("change, code", [
    ({"question": None}, "missing_field"),
    ({"type": "odd"}, "invalid_type"),
    ({"answer": "[C1] [C2]"}, "citation_out_of_range"),
    ({"contexts": [], "answer": ""}, "no_contexts"),
    ({"answer": "x"}, "no_citation"),
    ({"answer": "资料不足 [C1]"}, "should_not_refuse"),
    ({"type": "unanswerable", "answer": "好"}, "should_refuse"),
    ({"type": "conflicting", "answer": "无法回答 [C1]"}, "conflict_not_mentioned"),
    ({"type": "conflicting", "answer": "存在冲突 [C1]"}, "few_conflict_citations"),
    ({"type": "unanswerable", "answer": "无法回答 99"}, "extra_numbers"),
    ({"answer": "x" * 3000 + "[C1]"}, "too_long"),
])
def test_stage1_rules(spark, change, code):
    assert code in [r["code"] for r in V.validate_samples(samples(spark, change)).collect()]


@pytest.mark.parametrize("change, code, detail", [
    ({"type": "multi_chunk"}, "few_contexts", "1"),
    ({"contexts": [{"cid": "C1", "source": "s", "text": "  short  "}]}, "short_context", "C1"),
    ({"contexts": [{"cid": "C1", "source": "s", "text": None}]}, "short_context", "C1"),
    ({"answer": "\u3000\n"}, "empty_answer", ""),
])
def test_strict_rules(spark, change, code, detail):
    long = [{"cid": "C1", "source": "s", "text": "x" * 20}]
    rows = samples(spark, {"contexts": long, **change})
    assert (code, detail) in [(r["code"], r["detail"]) for r in V.validate_samples(rows, strict=True).collect()]
    assert code not in [r["code"] for r in V.validate_samples(rows).collect()]
    assert V.validate_samples(samples(spark, {"contexts": long, "answer": "220 [C1]"}), strict=True).count() == 0


def test_good_samples_pass(spark):
    good = samples(spark, {}, {"type": "unanswerable", "answer": "没有提供 220"}, {"type": "conflicting", "answer": "不一致 [C1] [C1]", "contexts": CTX})
    assert {r["code"] for r in V.validate_samples(good).collect()} == {"few_conflict_citations"}
    assert V.verdict(V.validate_samples(good)).first()["passed"]


def message(kind="faithful", subtype=None, user="【检索资料】\n[1] 来源：s\nt\n\n【问题】\nq", answer="是 [1]", roles=("system", "user", "assistant"), caps=("x",), id_="m"):
    texts = {"system": "S", "user": user, "assistant": answer}
    return {"messages": [{"role": r, "content": texts[r]} for r in roles],
            "meta": {"type": kind, "subtype": subtype, "id": id_, "battle_capabilities": list(caps)}, "split": "train"}


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.MESSAGES_SAMPLE)


@pytest.mark.parametrize("row, code", [
    (message(roles=("user", "assistant")), "invalid_roles"),
    (message(kind="odd"), "invalid_type"),
    (message(user="[1] x"), "missing_sections"),
    (message(answer=" "), "empty_answer"),
    (message(caps=()), "missing_capabilities"),
    (message(answer="无法回答 [1]"), "should_not_refuse"),
    (message(answer="x"), "no_citation"),
    (message(answer="[1] [2]"), "citation_out_of_range"),
    (message(kind="refuse", subtype="conflict", answer="是"), "did_not_refuse"),
    (message(kind="refuse", subtype="other", answer="资料不足"), "invalid_subtype"),
    (message(kind="format"), "no_structure_cue"),
    (message(answer="y" * 3000 + "[1]"), "too_long"),
])
def test_messages_rules(spark, row, code):
    codes = [r["code"] for r in V.validate_messages(table(spark, row)).collect()]
    assert code in codes
    if code == "invalid_roles":
        assert codes == [code]


def test_duplicates_name_the_first(spark):
    rows = [(i, "holdout" if i == 0 else "train", "same") for i in range(200)] + [(900, "train", "other")]
    df = spark.createDataFrame(rows, "id int, split string, text string")
    got = V.duplicate_issues(df, F.md5("text"), "id").collect()
    assert len(got) == 199 and {r["detail"] for r in got} == {"train:1"} and 0 in {r["id"] for r in got}


def test_drift_and_coverage(spark):
    drift = {r["type"]: r["drifted"] for r in V.ratio_drift(samples(spark, {}, {}), K.STAGE1_RATIOS).collect()}
    assert drift == {"answerable": True, "multi_chunk": True, "unanswerable": True, "conflicting": True}
    missing = {(r["kind"], r["name"]) for r in V.coverage(table(spark, message(), message(kind="refuse", subtype="conflict"))).collect()}
    assert ("type", "cite") in missing and ("refuse subtype", "conflict") not in missing and len(missing) == 5


def test_evaluation_directions(spark):
    holdout = table(spark, message(id_="a"), message(kind="refuse", subtype="weak_recall", answer="无法回答", id_="b"))
    told = E.constant_predictor(holdout).unionByName(E.echo_predictor(holdout))
    rows = E.score_rows(holdout, told)
    m = {(r["model"], r["metric"]): r["value"] for r in E.metrics(rows).collect()}
    assert m[("base", "refusal_recall")] == 0.0 and m[("sft", "refusal_recall")] == 1.0
    assert m[("sft", "false_refusal")] == 0.0 and m[("sft", "citation_validity")] == 1.0
    assert ("sft", "faithfulness") not in m and ("sft", "recall_conflict") not in m
    assert {r["bad_case"] for r in E.bad_cases(rows).collect()} == {"missed_refusal"}
    gate = {r["metric"]: r["ok"] for r in E.promotion_gate(E.metrics(rows)).collect()}
    assert all(gate.values()) and len(gate) == 3
    text = reports.render_evaluation_report(rows)
    assert "| 拒答 Recall | 0.00 | 1.00 | +1.00 |" in text and "| missed_refusal | 1 |" in text


def test_judge(spark):
    holdout = table(spark, message(id_="a"))
    out = spark.createDataFrame([("a", "sft", '```json\n{"faithful":0,"complete":1}\n```')], "id string, model string, output string")
    row = E.score_rows(holdout, E.echo_predictor(holdout), E.parse_judge(out)).first()
    assert (row["faithful"], row["complete"], row["bad_case"]) == (0, 1, "unfaithful")


def test_validation_reports(spark):
    s = samples(spark, {}, {"type": "odd"})
    assert "- errors: 1" in reports.render_quality_report(s, V.validate_samples(s))
    m = table(spark, message(kind="refuse", subtype="conflict", answer="资料不足"))
    assert "conflict=1" in reports.render_messages_report(m, V.validate_messages(m))


def test_prompt_part(spark):
    from tomeworks.functions.rendering import prompt_messages

    row = table(spark, message()).select(prompt_messages(F.col("messages")).alias("p")).first()
    assert [m["role"] for m in row["p"]] == ["system", "user"]


def test_pretrain_check(spark):
    bad = table(spark, message(roles=("user", "assistant")), message(roles=("user", "system", "assistant")), message(answer=""), message())
    assert sorted(r["problem"] for r in V.pretrain_check(bad).collect()) == [
        "empty assistant content", "invalid roles user,system,assistant", "messages must have 3 turns"]


def test_samples_without_id_are_scored(spark):
    rows = [{**message(id_=None), "pos": 1}, {**message(id_="own"), "pos": 2}]
    holdout = E.identified(spark.createDataFrame(rows, schemas.MESSAGES_SAMPLE + ", pos int"))
    scored = E.score_rows(holdout, E.echo_predictor(holdout))
    assert sorted(r["id"] for r in scored.collect()) == ["own", "sample-000001"]
