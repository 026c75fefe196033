import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tomeworks.llm import rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, k):
    """Every document scored for every query."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, math.inf if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, queries, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rank.search(d, q, **options).collect()), key=str)


def corpus(seed, n):
    """Texts of words whose frequencies fall like 1 / rank, with copies among them."""
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "日本", "x9"]
    p = 1 / np.arange(1, len(words) + 1)
    made = [" ".join(draw.choice(words, size=int(draw.integers(0, 60)), p=p / p.sum())) for _ in range(n)]
    return [(int(i), made[j % (n // 2)] if j % 3 == 0 else made[j]) for j, i in enumerate(draw.permutation(5 * n)[:n])]


@pytest.mark.parametrize("segment_postings", [40, 1 << 19])
def test_equals_scoring_every_document(spark, monkeypatch, segment_postings):
    monkeypatch.setattr(rank, "SEGMENT_POSTINGS", segment_postings)
    monkeypatch.setattr(rank, "RUN_BYTES", 500)
    docs = corpus(1, 400)
    queries = [(i, docs[7 * i][1]) for i in range(40)] + [(99, "w0 w0 W1, w299 unknown"), (98, "nothing here"), (97, "")]
    assert found(spark, docs, queries) == plain(docs, queries, 10)
    assert found(spark, docs, queries, k=3, block_bytes=900) == plain(docs, queries, 3)


def test_range_maxima_equal_plain_maxima():
    draw = np.random.default_rng(3)
    sizes = draw.integers(1, 9, size=200)
    at = np.concatenate([np.sort(draw.choice(12, size=s, replace=False)) for s in sizes])
    ids = draw.permutation(10_000)[:200].astype(np.int64)
    segment = rank.Segment(ids, draw.integers(8, 90, size=200), sizes, at, draw.integers(1, 6, size=len(at)), rank.Corpus(200, 9000, np.ones(12, dtype=np.int64)))
    for _ in range(500):
        t = int(draw.integers(12))
        a, b = np.sort(draw.integers(segment.starts[t], segment.starts[t + 1] + 1, size=2))
        got = int(segment.maxima(np.array([a]), np.array([b]))[0])
        assert got >> 32 == max(segment.impact[a:b], default=0)
        if a < b:
            assert segment.n - 1 - (got & 0xFFFFFFFF) == int(segment.key[a:b][segment.impact[a:b].argmax()]) - t * segment.n


def test_intervals_that_cannot_win_are_not_taken(monkeypatch):
    """Far fewer documents get an exact score than there are."""
    docs = corpus(5, 4000)
    block = rank.make_block([0], pa.array(["w250 w270 w290 w0"]))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in docs], type=pa.int64()), "text": [t for _, t in docs]})
    segment = next(rank._segments(iter([batch]), block.terms))
    parts = [np.frombuffer(segment[c][0].as_buffer(), dtype=k) for c, k in zip(("ids", "lengths", "sizes", "terms", "tfs"), (np.int64, np.int64, np.int32, np.int32, np.int32))]
    df = np.array(segment["df_counts"][0].as_py())
    n_docs, n_words = segment["docs"][0].as_py(), segment["words"][0].as_py()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df])
    made = rank.Segment(*parts, rank.Corpus(n_docs, n_words, weights))
    seen, maxima = [0], made.maxima
    monkeypatch.setattr(made, "maxima", lambda a, b: seen.__setitem__(0, seen[0] + len(a)) or maxima(a, b))
    none = np.zeros(0, dtype=np.int64)
    scores, ids = made.search(block.queries[0][1], weights[block.queries[0][1]], 10, none, none)
    assert [(i, s) for i, s in zip(ids.tolist(), scores.tolist())] == [(i, s) for _, _, i, s in sorted(plain(docs, [(0, "w250 w270 w290 w0")], 10), key=lambda r: r[1])]
    assert seen[0] < made.n / 3


def test_nulls_ties_copies_long_texts_and_empty_tables(spark):
    docs = [(5, "same words"), (3, "same words"), (None, "same words"), (3, "same words"), (8, None), (9, ""), (10, "!?"), (11, "same " * 100_000)]
    queries = [(1, "same"), (1, "same"), (None, "words"), (2, None), (3, "...")]
    got = found(spark, docs, queries)
    assert got == plain(docs, queries, 10)
    assert [r[2] for r in got if r[0] is None] == [3, 3, 5, None]
    assert found(spark, docs, []) == [] and found(spark, [], queries) == [] and found(spark, [(1, "?")], queries) == []
    extra = spark.createDataFrame([(1, "a b", 7, 0.5)], "doc_id long, text string, rank int, score double")
    asked = spark.createDataFrame([(4, "b", 1)], "item_id long, text string, query int")
    out = rank.search(extra, asked)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert [(r.item_id, r.rank, r.doc_id, r.score) for r in out.collect()] == plain([(1, "a b")], [(4, "b")], 10)
