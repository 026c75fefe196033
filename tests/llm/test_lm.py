import math
import re
from collections import Counter

import numpy as np
import pytest

from tomeworks.llm import lm
from tomeworks.llm import words as W


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def frame(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ["doc_id", "text", *more] if more else "doc_id long, text string")


TRAIN = ["the cat sat on the mat", "The dog sat\ton the Cat", None, "", "the the the the", "a" * 70_000, "naïve café café", "the cat sat on the mat"]


def test_base_score_and_counts_equal_brute_force(spark):
    train, asked = frame(spark, TRAIN), frame(spark, TRAIN + ["unseen words here", "the mat"])
    counts = Counter(t for text in TRAIN for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for head_words in (500_000, 0):  # with and without counts in the broadcast head
        rows = lm.score(lm.train(train, head_words=head_words), asked).collect()
        assert len(rows) == 10
        for r in rows:
            own = tokens((TRAIN + ["unseen words here", "the mat"])[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), abs=1e-9)
            assert r.score < 0


def test_score_equals_the_formula_on_quantised_counts(spark):
    model = lm.train(frame(spark, TRAIN), mu=5.0, bits_per_entry=64)
    got = {r.doc_id: r.score for r in lm.score(model, frame(spark, ["the cat sat on a hat"])).collect()}
    uni, bi, context = Counter(), Counter(), Counter()
    for text in TRAIN:
        own = tokens(text)
        uni.update(own)
        bi.update(zip(["start", *own], own))
        context.update(["start", *own])
    bottoms = lm.bounds(1.5).tolist()
    low = lambda c: max([b for b in bottoms if b <= c], default=0)
    high = lambda c: next(b for b in bottoms if b > c) - 1 if c else 0
    n, v = sum(uni.values()), len(uni)
    total, before = 0.0, "start"
    for t in tokens("the cat sat on a hat"):
        p = (low(uni[t]) + 1) / (n + v + 1)
        total += math.log10((low(bi[before, t]) + 5 * p) / (max(high(context[before]), low(bi[before, t])) + 5))
        before = t
    assert got[0] == pytest.approx(total, abs=1e-9)


def test_levels_are_read_back_and_seldom_too_high():
    keys = W.mix(np.arange(20_000, dtype=np.uint64))
    counts = np.arange(20_000) % 1000 + 1
    levels = lm.level_of(counts, 1.5)
    bounds = lm.bounds(1.5)
    assert (bounds[levels - 1] <= counts).all() and (counts < bounds[levels]).all()
    held = lm.LevelFilter([int(levels.sum()) * 12 // 64])
    held.words[:] = lm.LevelFilter.segment(keys, levels, len(held.words))
    found = held.levels(keys)
    assert (found >= levels).all() and (found > levels).mean() < 0.05
    assert (held.levels(W.mix(np.arange(50_000, 70_000, dtype=np.uint64))) > 0).mean() < 0.05


def test_probabilities_after_a_word_sum_to_at_most_one(spark):
    model = lm.train(frame(spark, TRAIN), mu=3.0, bits_per_entry=64)
    words = sorted({t for x in TRAIN for t in tokens(x) if t})
    one = lm.score(model, frame(spark, ["cat"])).first().score
    two = [r.score for r in lm.score(model, frame(spark, [f"the {w}" for w in words])).collect()]
    assert one < 0 and sum(10**s for s in two) <= 1


def test_empty_tables_clashing_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    rows = lm.score(lm.train(empty), frame(spark, ["a b", None])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0), (1, 0, 0)]
    model = lm.train(frame(spark, TRAIN))
    assert lm.score(model, empty).count() == 0
    out = lm.score(model, frame(spark, ["a", "b"], score=["x", "y"], extra=[1, 2]))
    assert sorted(out.columns) == sorted(["doc_id", "extra", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    assert dict(out.dtypes)["score"] == "double" and out.count() == 2


def test_unseen_copies_score_above_the_base(spark):
    from tomeworks.llm.queries import QUERIES

    rows = QUERIES["op1_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_blocks_of_the_filter_score_as_one(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 900, 60)) for _ in range(60)] + [None, ""]
    asked = frame(spark, texts[:20] + [None, "never seen words"])
    for order in (2, 3):
        got = []
        for most in (256 << 20, 2048):
            model = lm.train(frame(spark, texts), order=order, mu=5.0, head_words=50, max_filter_bytes=most)
            got.append({r.doc_id: r.score for r in lm.score(model, asked).collect()})
        assert len(model.blocks) > 1 and got[0] == pytest.approx(got[1], abs=1e-9)
