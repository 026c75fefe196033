import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions import intent as N
from tomeworks.functions import rendering as R
from tomeworks.functions import text as X


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def plain_change(text, pick):
    spots = [m for m in re.finditer(r"\d+(?:\.\d+)?", text) if len(m.group()) <= 6]
    if not spots:
        return None
    pool = [m for m in spots if len(m.group()) >= 2] or spots
    spot = pool[int(pick[:8], 16) % len(pool)]
    old = spot.group()
    v = float(old)
    grown = 2 * v if v < 10 else v + max(1, round(v / 2))
    new = f"{grown:.1f}" if "." in old else str(int(grown))
    return (text[:spot.start()] + new + text[spot.end():], old, new)


def test_perturb_equals_restatement(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", " ", "7", "12", "3.5", "0", "1234567", ".", "99", "5.25", "0.125", "12.15", "15.05"]) for _ in range(r.randint(0, 9))) for _ in range(300)]
    got = values(spark, texts, lambda t: X.perturb_number(t, F.md5(t)))
    for text, g in zip(texts, got):
        want = plain_change(text, hashlib.md5(text.encode()).hexdigest())
        assert (tuple(g) if g else None) == want, text


def test_strip_matches_python(spark):
    texts = ["".join(K.WHITESPACE) + "a b" + "　\n", "", "　", "x", None]
    assert values(spark, texts, X.strip) == [t.strip() if t is not None else None for t in texts]


def test_sentences(spark):
    texts = ["a。b!c", "a。", "", "no end", "  one\ntwo\nthree ", None]
    assert values(spark, texts, lambda t: X.first_sentences(t, 2)) == ["a。b!", "a。", "", "no end", "one\ntwo", ""]


def test_citations(spark):
    text = "[10] x [C2] [2]\n[3] y [C]"
    assert values(spark, [text], X.citations_any) == [["10", "2", "3"]]
    assert values(spark, [text], X.citations_c) == [["C2"]]
    assert values(spark, [text], X.citations_n) == [["10", "2", "3"]]
    assert values(spark, [text], X.available_citations) == [["10", "3"]]


def test_cleaning(spark):
    texts = ["a ![i](u) b", "see https://x.y/z　end", "a\n\n\n\nb", None]
    assert values(spark, texts, X.clean_content) == ["a  b", "see 　end", "a\n\nb", ""]


def test_lenient_json(spark):
    texts = ['```json\n{"a": 1}\n```', 'x {"a": 2} y', "{bad", "{bad}", "", None]
    got = values(spark, texts, lambda t: X.parse_model_json(t, "a int"))
    assert [g and g["a"] for g in got] == [1, 2, None, None, None, None]


def test_refusal_lists_differ(spark):
    texts = ["资料没有提供", "无法据此回答", None]
    assert values(spark, texts, X.is_refusal) == [True, True, False]
    assert values(spark, texts, lambda t: X.is_refusal(t, K.TRACE_REFUSAL_CUES)) == [False, True, False]


@pytest.mark.parametrize("query, upstream, want", [
    ("这个怎么用", None, "operation"), ("如何安装", "bad-value", "install_config"), ("设备报错了", None, "troubleshooting"),
    ("电压是多少", "general", "parameter"), ("有接线图吗", None, "image_request"), ("", None, "general"),
    ("两款区别", None, "comparison"), ("保修多久", None, "after_sales"), ("安装失败", None, "troubleshooting"),
    ("如何安装", " Operation ", "operation"),
])
def test_intents(spark, query, upstream, want):
    df = spark.createDataFrame([(query, upstream)], "q string, u string")
    assert df.select(N.resolve_intent(F.col("u"), F.col("q"))).first()[0] == want


def test_format_subtype(spark):
    texts = ["常见原因", "请按 1", "\n 2、x", "定义", None]
    assert values(spark, texts, X.format_subtype) == ["troubleshooting", "steps", "steps", "definition", "definition"]


def test_question_of(spark):
    assert values(spark, ["【检索资料】\nx\n\n【问题】\n q ", "none"], X.question_of) == ["q", ""]
    assert values(spark, ["问题：a", "问题:b", " c "], X.clean_question) == ["a", "b", "c"]


def test_sources(spark):
    rows = [("f", "t", "", "i"), ("f", "", "p", "i"), ("", "", "", "i"), (None, None, None, None), (" / ", "", "", "")]
    df = spark.createDataFrame(rows, "file_title string, title string, parent_title string, item_name string")
    assert [r[0] for r in df.select(R.source_stage1()).collect()] == ["f / t", "f / p", "未知来源", "未知来源", "未知来源"]
    assert [r[0] for r in df.select(R.source_stage2()).collect()] == ["f / t", "f / p", "i", "未知来源", "未知来源"]
    assert [r[0] for r in df.select(R.item_key()).collect()] == ["i", "i", "i", "UNKNOWN", " / "]


def test_fill_does_not_rescan_values(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(X.fill("{a}-{b}", a=F.col("a"), b=F.col("b"))).first()[0] == "{b}-x"


def test_one_place_equals_python(spark):
    numbers = [i / 100 for i in range(0, 40000, 5)] + [i / 1000 for i in range(0, 9999, 25)] + [99999.95, 1e5 + 0.25, 0.05, 0.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    wrong = [(r["x"], r["v"]) for r in df.select("x", X.one_place(F.col("x")).alias("v")).collect() if r["v"] != f"{r['x']:.1f}"]
    assert wrong == []


def test_clean_content_of_texts_with_and_without_markup(spark):
    pairs = [("  plain text\n\nhttx:// ![ ", "plain text\n\nhttx:// !["), ("a\n\n![x](y)\n\nb", "a\n\nb"), ("a\t \n\n\n\n b", "a\n\nb"),
             ("see https://x.y/z now", "see  now"), ("HTTP://x", "HTTP://x"), ("\u3000a\n \n", "a"), ("", ""), (None, "")]
    df = spark.createDataFrame(pairs, "text string, want string").select(X.clean_content(F.col("text")).alias("got"), "want")
    assert [r for r in df.collect() if r["got"] != r["want"]] == []
