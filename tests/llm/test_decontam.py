import random
import re

from tomeworks.llm import decontam


def words(text):
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def by_hand(text, bench, span=13):
    own, hit, items = words(text), set(), set()
    for item, t in bench:
        theirs = words(t)
        n = min(span, len(theirs))
        windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                items.add(str(item))
    return len(own), len(hit), sorted(items)


def corpus():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(40)]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench = [(i, " ".join(passage(n))) for i, n in enumerate([1, 2, 5, 12, 13, 14, 30, 60, 60])]
    bench += [(20, bench[7][1]), (21, bench[7][1] + " " + bench[8][1]), (22, "aa " * 40), (23, ""), (24, None), (6, bench[6][1])]
    docs = [None, "", "...", bench[6][1].upper(), "x " * 20 + bench[5][1] + " y", "aa " * 13, "aa " * 12, "aa " * 100]
    for _ in range(60):
        parts = passage(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            own = (rng.choice([b for b in bench if b[1]])[1]).split()
            a = rng.randrange(len(own))
            parts += own[a : a + rng.choice([11, 12, 13, 14, 25, 100])] + passage(rng.randrange(20))
        docs.append((" " if rng.random() < 0.5 else ", ").join(parts))
    docs.append(" ".join(passage(50_000)) + " " + bench[7][1])
    return list(enumerate(docs)), bench


def test_hits_equal_brute_force(spark):
    docs, bench = corpus()
    df = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id long, text string, spans string")
    table = spark.createDataFrame(bench, "item_id long, text string")
    for block_words in (2_000_000, 400):  # in one block, and in several
        got = {r.doc_id: r for r in decontam.contamination(df, table, block_words=block_words).collect()}
        assert len(got) == len(docs)
        for i, text in docs:
            r = got[i]
            assert (r.n_words, r.n_hit, list(r["items"])) == by_hand(text, bench), (i, block_words)
            covered = {w for s in r.spans for w in range(s.start, s.end)}
            assert len(covered) == r.n_hit


def test_rule_and_empty_tables(spark):
    docs, bench = corpus()
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    found = decontam.contamination(df, table)
    dirty = {r.doc_id for r in found.where(decontam.contaminated()).collect()}
    want = {i for i, t in docs for n, h, _ in [by_hand(t, bench)] if h and 20 * h >= n}
    assert dirty == want
    assert decontam.contamination(df.limit(0), table).count() == 0
    assert {(r.n_hit, len(r["items"])) for r in decontam.contamination(df, table.limit(0)).collect()} == {(0, 0)}


def test_items_without_id_are_searched_for(spark):
    text = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"before {text} after"), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (None, None), (4, "word3 word4")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontam.contamination(df, bench).collect()}
    assert got == {1: (30, ["4"]), 2: (0, [])}
