"""Chunking against independent restatements on random documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.operators import documents as D
from tomeworks.operators import images as I
from tomeworks.operators.splitter import pieces_of, split_to_size
from tomeworks.operators.tables import linearize_text

DOC = "doc_id bigint, file_title string, md_content string"


def plain_sections(md, file_title):
    """A line-by-line reading of the section rules."""
    found, heads, fence = [{"head": None, "lines": []}], [], False
    for line in md.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.strip()[:3] in ("```", "~~~"):
            fence = not fence
        if not fence and re.fullmatch(r"\s*#{1,6}\s+.+", line):
            found.append({"head": line.strip(), "lines": []})
        else:
            found[-1]["lines"].append(line)
    out = []
    for s in found:
        body = "\n".join(s["lines"]).strip()
        if s["head"] is None:
            if body:
                out.append((file_title, file_title, body))
            continue
        level = len(re.match("#{1,6}", s["head"]).group())
        above = [h for h, lv in heads if lv < level]
        out.append((s["head"], above[-1] if above else s["head"], body))
        heads.append((s["head"], level))
    return out


def plain_merge(sections, limit):
    merged = []
    for title, parent, body in sections:
        if merged and merged[-1][1] == parent and len(merged[-1][2]) < limit:
            merged[-1] = (parent, parent, merged[-1][2].rstrip() + "\n\n" + body.lstrip())
        else:
            merged.append((title, parent, body))
    return merged


def random_docs(n, seed=1):
    r = random.Random(seed)
    pieces = ["# a", "## b b", "### c", "###### f", "####### g", "#h", "  ## i", "\t# j", "```", "~~~ x", "text", "", "　", "x\r", "# ", "#  ",
              "para " * 30, "|a|b|", "   ```py", "　# k", "\x1c## l\x1d m", "　~~~", "\x0b```"]
    return [(i, f"f{i % 3}", "\n".join(r.choice(pieces) for _ in range(r.randint(0, 25)))) for i in range(n)]


@pytest.fixture(scope="module")
def docs():
    return random_docs(400)


def test_sections_equal_restatement(spark, docs):
    got = {}
    for r in D.explode_sections(D.split_sections(spark.createDataFrame(docs, DOC))).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["title"], r["parent_title"], r["body"]))
    for i, title, md in docs:
        assert got.get(i, []) == plain_sections(md, title), md


def test_merge_equals_restatement(spark, docs):
    got = {}
    merged = D.merge_short(D.split_sections(spark.createDataFrame(docs, DOC)), 40)
    for r in D.explode_sections(merged).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["title"], r["parent_title"], r["body"]))
    for i, title, md in docs:
        assert got.get(i, []) == plain_merge(plain_sections(md, title), 40)


def brute_pack(text, limit, seps):
    """The recursive scheme stated the other way round: by characters when nothing else is left."""
    if not seps[0]:
        return [text[i:i + limit] for i in range(0, len(text), limit)]
    if seps[0] not in text:
        return brute_pack(text, limit, seps[1:])
    parts = [p for p in re.split(f"(?={re.escape(seps[0])})", text) if p] if len(seps[0]) == 1 else None
    if parts is None:
        cut = text.split(seps[0])
        parts = [p for p in [cut[0], *[seps[0] + c for c in cut[1:]]] if p]
    out, run = [], ""
    for p in parts:
        if len(p) >= limit:
            if run:
                out.append(run)
            run = ""
            out += brute_pack(p, limit, seps[1:])
        elif len(run) + len(p) > limit:
            out.append(run)
            run = p
        else:
            run += p
    return out + ([run] if run else [])


def test_splitter_equals_restatement():
    r = random.Random(3)
    for _ in range(500):
        text = "".join(r.choice(["a", "bb", " ", "\n", "\n\n", "。", "，", "?", ";", "word"]) for _ in range(r.randint(0, 80)))
        limit = r.randint(2, 30)
        want = [p.strip() for p in brute_pack(text, limit, K.SPLIT_SEPARATORS) if p.strip()]
        got = split_to_size(text, limit, K.SPLIT_SEPARATORS)
        assert got == want
        assert all(len(p) <= limit for p in got)
        assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text)


def test_splitter_column_equals_the_string_form(spark):
    r = random.Random(5)
    signs = ["a", "bb", " ", "\n", "\n\n", "。", "，", "?", ";", "!", "word", "日本", "😀", "\u3000", "\t", "x" * 40]
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randint(0, 90))), r.randint(2, 30)) for i in range(800)]
    rows += [(800, "", 5), (801, "word " * 60_000, 100), (802, "y" * 100_000, 7), (803, "a;b" * 5, 2), (804, " \n ", 3)]
    df = spark.createDataFrame(rows, "i int, text string, room int").repartition(4)
    got = {x["i"]: x["p"] for x in df.select("i", pieces_of(F.col("text"), F.col("room"), K.SPLIT_SEPARATORS).alias("p")).collect()}
    for i, text, limit in rows:
        assert got[i] == split_to_size(text, limit, K.SPLIT_SEPARATORS), (text[:200], limit)


def test_splitting_long_sections_stays_in_the_jvm(spark):
    df = D.split_long(spark.createDataFrame([], "doc_id bigint, file_title string, sections array<struct<title string, parent_title string, body string>>"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_long_sections_are_numbered_and_whole(spark):
    body = "这是一句话。" * 800
    rows = D.import_chunks(spark.createDataFrame([(1, "f", "# T\n" + body), (2, "g", "short")], DOC)).orderBy("doc_id", "pos").collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert [r["title"] for r in first] == [f"# T_{i + 1}" for i in range(len(first))] and len(first) > 1
    assert "".join(r["content"].split("\n\n", 1)[1] for r in first) == body
    assert all(r["parent_title"] == "# T" for r in first)
    assert [r["content"] for r in rows if r["doc_id"] == 2] == ["g\n\nshort"]


def test_long_title_is_cut_for_pieces_only(spark):
    title = "# " + "t" * 200
    rows = D.import_chunks(spark.createDataFrame([(1, "f", title + "\n" + "w " * 1500), (2, "f", title + "\nx")], DOC)).collect()
    assert {r["title"] for r in rows if r["doc_id"] == 2} == {title}
    assert all(r["title"].startswith(title[:80] + "_") for r in rows if r["doc_id"] == 1)


def test_import_is_map_only(spark, docs):
    plan = D.import_chunks(spark.createDataFrame(docs, DOC))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sizes_are_checked(spark, docs):
    df = spark.createDataFrame(docs[:1], DOC)
    for bad in ({"max_len": 0}, {"min_len": 0}, {"max_len": 10, "min_len": 20}):
        with pytest.raises(ValueError):
            D.import_chunks(df, **bad)


@pytest.mark.parametrize("text, want", [
    ("<table><tr><td></td><td>A</td><td>B</td></tr><tr><td>r</td><td>1</td><td>-</td></tr></table>", "- 【r】：A为1。"),
    ("<table><tr><td>k</td><td>v</td></tr></table>", "- 【k】：v。"),
    ("<table><tr><th>h</th><th>g</th></tr><tr><td>s</td><td>无</td></tr></table>", "- 【s】"),
    ("<table><tr><td rowspan=2>a</td><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table>", "- 【a】(对应a)：x为1，y为2。"),
    ("<table><tr><td colspan=3>t</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>", "- 【a】(对应t)：t为b，t为c。"),
    ("|n|s|\n|---|---|\n|a|1|\n", "- 【a】(对应n)：s为1。"),
])
def test_tables(text, want):
    assert linearize_text(text).strip() == want


def test_table_gate(spark):
    body = "|n|s|\n|---|---|\n|a|1|"
    df = D.split_sections(spark.createDataFrame([(1, "f", body)], DOC))
    same = D.explode_sections(D.linearize_tables(df)).first()["body"]
    changed = D.explode_sections(D.linearize_tables(df, gate="any")).first()["body"]
    assert same == body and "【a】" in changed


def test_image_names_are_compared_whole(spark):
    md = "# h\nbefore\n\n![x](img/11.png)\nafter\n![y](1.png)"
    d = spark.createDataFrame([(1, "f", md)], DOC)
    images = spark.createDataFrame([(1, "1.png", "S", "U"), (1, "2.png", "S", "U"), (1, "11.PDF", "S", "U")],
                                   "doc_id bigint, name string, summary string, url string")
    got = I.image_contexts(d, images).collect()
    assert [(r["name"], r["line"], r["head"], r["pre_text"], r["post_text"]) for r in got] == [
        ("1.png", 5, "# h", "before\n\nafter", "")]
    assert I.rewrite_images(d, images).first()["md_content"] == md.replace("![y](1.png)", "![S](U)")


def test_item_names(spark):
    chunks = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "doc_id bigint, file_title string, pos int")
    answers = spark.createDataFrame([(1, "X"), (2, "UNKNOWN")], "doc_id bigint, item_name string")
    got = {r["doc_id"]: r["item_name"] for r in D.resolve_item_names(chunks, answers).collect()}
    assert got == {1: "X", 2: "b", 3: "c"}


def test_chunk_ids_do_not_depend_on_partitioning(spark, docs):
    df = spark.createDataFrame(docs, DOC)
    ids = [sorted(r[0] for r in D.import_chunks(d).select("chunk_id").collect()) for d in (df, df.repartition(5, F.col("file_title")))]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0])


def test_very_long_documents(spark):
    """Long runs of blanks do not exhaust the regex stack, many sections stay quick."""
    blanks = " " * 200_000
    many = "\n".join(f"{'#' * (i % 6 + 1)} h{i}\nbody {i}\n```\n# no\n```" for i in range(4000))
    rows = spark.createDataFrame([(1, "f", f"{blanks}# a\n{blanks}x\n```\n" + "y\n" * 100_000), (2, "g", many)], DOC)
    got = {r["doc_id"]: r["n"] for r in D.explode_sections(D.split_sections(rows)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1, 2: 4000}
    assert D.import_chunks(rows).where("doc_id = 2").count() > 100


def test_chunk_backup(spark, docs, tmp_path):
    from tomeworks.sources.files import write_chunks

    chunks = D.import_chunks(spark.createDataFrame(docs[:50], DOC))
    write_chunks(chunks, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == chunks.count()
    assert not [p for p in (tmp_path / "c").iterdir() if p.is_dir()]
