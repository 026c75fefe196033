import json

import pytest
from pyspark.sql import functions as F

from tomeworks.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>x", chat.ESCAPE, chat.ESCAPE + "1" + chat.ESCAPE + "0", "<" + chat.ESCAPE + "1s>", "<<s>", "<|im_end|", "",
         "<<SYS>>a<</SYS>>", "\n\n", "é😀" * 5, "[[INST]", "</s></s>", "x" * 50_000, "$0 \\Q \\E"]

RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": None}]}, "messages", [("system", "s"), ("user", "")]),
    ({"messages": [{"content": "a", "role": "user"}]}, "messages", [("user", "a")]),
    ({"messages": [{"text": "a", "role": "gpt"}]}, "rows", [("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"output": "o", "instruction": "i", "input": ""}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "completion": None}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "")]),
    ({"question": 7, "answer": "c"}, "question", [("user", "7"), ("assistant", "c")]),
    ({"unknown": {"deep": [1]}}, None, None), ({}, None, None), ([], None, None),
]


def test_layouts_are_told_by_their_paths(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(98, "no json"), (99, None)]
    df = spark.createDataFrame(rows, "id long, raw string").select("id", F.try_parse_json("raw").alias("record"), F.lit(1).alias("turns"))
    got = {r.id: r for r in chat.canonical(df, "record").collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout and (turns is None and got[i].turns is None or [tuple(t) for t in got[i].turns] == turns), i
    assert got[98].layout is None and got[99].turns is None


def test_round_trip_of_control_strings(spark):
    turns = [("user", NASTY[0])] + [(role, t) for t in NASTY for role in ("assistant", "us<s>er\n")]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None)], "id long, turns array<struct<role:string,text:string>>")
    made = chat.format_turns(df)
    first = made.where("id = 1").first()
    assert first.formatted.count(chat.OPEN) == first.formatted.count(chat.MIDDLE) == first.formatted.count(chat.CLOSE) == len(turns)
    assert "</s>" not in first.formatted and "[INST]" not in first.formatted
    at, learned = 0, ""
    for run in first.loss_runs:
        learned += first.formatted[at : at + run.chars] if run.learned else ""
        at += run.chars
    assert at == len(first.formatted)
    back = {r.id: r for r in chat.parse(made.drop("turns")).collect()}
    assert [tuple(t) for t in back[1].turns] == turns and list(back[1].loss_texts) == [t for r, t in turns if r == "assistant"]
    assert learned.replace(chat.ESCAPE + "1", "").replace(chat.ESCAPE + "0", chat.ESCAPE) == "".join(back[1].loss_texts)
    assert back[2].turns == [] and back[3].turns is None


def test_a_mask_that_does_not_fit_ends_the_job(spark):
    df = spark.createDataFrame([(1, [("assistant", "a")])], "id long, turns array<struct<role:string,text:string>>")
    made = chat.format_turns(df).withColumn("formatted", F.regexp_replace("formatted", "a<", "ab<"))
    with pytest.raises(Exception, match="mask does not fit"):
        chat.parse(made).collect()


def test_rows_ties_nulls_and_no_python(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, None, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.canonical(chat.from_rows(df), "record")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in made.collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], 2: [("", "x")], None: [("user", "n")]}
    assert chat.canonical(chat.from_rows(df.limit(0)), "record").count() == 0
    plan = chat.parse(chat.format_turns(made))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
