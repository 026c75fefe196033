import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tomeworks.llm import quality
from tomeworks.llm import words as W
from tomeworks.llm.queries import QUERIES


def of(texts):
    return np.concatenate([quality.statistics(o, d) for _, o, d in W.runs(pa.array(texts, type=pa.string()), 300)])


def odds(part, whole):
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def plain(text):
    """The statistics from strings, one text at a time."""
    raw, words = text.encode(), [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words]
    shown = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    lines = [line for line in text.split("\n") if line]
    n, sizes = len(words), [len(w) for w in words]
    marks = sum(c in ".!?" for c in text)
    pairs = list(zip(words, words[1:]))
    seen = Counter(raw)
    return [
        math.log1p(len(text)), math.log1p(n), math.log1p(len(lines)), math.log1p(np.mean(sizes) if n else 0), math.log1p(np.std(sizes) if n else 0),
        math.log1p(n / max(len(lines), 1)), math.log1p(n / (marks + 1)),
        odds(sum("A" <= c <= "Z" for c in text), sum(b >= 0x80 or chr(b).isalpha() for b in raw)),
        odds(sum("A" <= w[0] <= "Z" for w in shown), n), odds(sum("0" <= c <= "9" for c in text), len(raw)),
        odds(sum(c in "#$%&*+/<=>@[\\]^_`{|}~" for c in text), len(raw)), odds(sum(w[-1] in "#$%&*+/<=>@[\\]^_`{|}~!" for w in words), n),
        odds(text.count("|"), len(raw)), odds(marks, len(raw)), odds(text.count("!"), len(raw)), odds(text.count(","), len(raw)),
        odds(sum(b >= 0x80 for b in raw), len(raw)), odds(sum(c in " \n\t" for c in text), len(raw)), odds(len(set(words)), n),
        odds(sum(a == b for a, b in pairs), len(pairs)), odds(len(set(pairs)), len(pairs)), odds(max(Counter(words).values(), default=0), n),
        odds(len({line.lower() for line in lines}), len(lines)), -sum(c / len(raw) * math.log2(c / len(raw)) for c in seen.values())]


def test_statistics_equal_plain_ones():
    texts = ["", "one", "One two, two TWO!!\nÉté | x$$$ 42\n\nOne two, two TWO!!", " lead\ttab \n", "日本 語 日本", "a b a b a b.", "#### $$"] * 3
    assert of(texts) == pytest.approx(np.array([plain(t) for t in texts]))


def test_densities_equal_the_formula():
    draw = np.random.default_rng(1)
    d, pooling, ridge = 3, 0.3, 0.1
    parts = [draw.normal(size=(n, d)) * s + m for n, s, m in ((40, 1.0, 0.0), (90, [1, 2, 3], 1.0))]
    model = quality.fit(np.array([40.0, 90.0]), np.stack([p.sum(axis=0) for p in parts]), np.stack([p.T @ p for p in parts]), pooling, ridge)
    both = np.concatenate(parts)
    scaled = [(p - both.mean(axis=0)) / both.std(axis=0) for p in parts]
    own = [np.cov(s.T, bias=True) for s in scaled]
    pooled = (40 * own[0] + 90 * own[1]) / 130
    logs = []
    x = (both - both.mean(axis=0)) / both.std(axis=0)
    for k, n in enumerate((40, 90)):
        c = (1 - pooling) * own[k] + pooling * pooled
        c = (1 - ridge) * c + ridge * np.trace(c) / d * np.eye(d)
        away = x - scaled[k].mean(axis=0)
        logs.append(math.log(n / 130) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away))
    assert model.score(both) == pytest.approx(1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30))))


def test_held_out_accuracy(spark):
    """On labelled documents that were not learned from."""
    at = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op13_quality"](spark, at).collect()}
    assert len(rows) == spark.read.parquet(f"{at}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[i]) for i, r in rows.items() if r.held_out and i in labels]
    assert sum(p == y for _, p, y in held) >= 0.95 * len(held)
    ones, zeros = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) >= 0.97 * len(ones) * len(zeros)


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, salt string")
    return docs.select("doc_id", "score", "salt", quality.statistics_of("text").alias("stats"))


def test_nulls_repeats_clashing_columns_and_one_or_no_label(spark):
    good = [(i, f"Plain words of text number {i}, in a sentence. Another {'one ' * (i % 7)}here.", 9, "s") for i in range(60)]
    bad = [(100 + i, f"### {i} $$$ BUY!! | BUY!! | {'NOW!! ' * (i % 9)}", 9, "s") for i in range(60)]
    odd = [(None, None, 9, "s"), (300, "", 9, None), (300, "", 9, None), (301, "word " * 200_000, 9, None), (5, good[5][1], 9, "s")]
    stats = frame(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(None, 1), (300, None), (301, 7), (5, 1), (None, 0)],
                                   "doc_id long, quality int")
    model = quality.train(stats, labels)
    out = quality.score(model, stats)
    assert out.columns == ["doc_id", "salt", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 125 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.doc_id < 60) for r in rows if r.doc_id is not None and r.doc_id < 200)
    assert len({r.score for r in rows if r.doc_id in (None, 300)}) == 1
    for some, value in ((labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0), (labels.limit(0), 0.5)):
        assert {r.score for r in quality.score(quality.train(stats, some), stats).collect()} == {value}
    assert quality.score(model, frame(spark, [])).count() == 0


def test_training_sums_repeated_rows_and_labels(spark):
    """A model from rows dealt over many tasks equals one from all rows at once."""
    texts = [f"{'Word ' * (i % 11 + 1)}{'#' * (i % 3)} {i}" for i in range(200)]
    stats = frame(spark, [(i % 150, t, 0, None) for i, t in enumerate(texts)]).repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(3, 0)], "doc_id long, quality int")
    model = quality.train(stats, labels)
    x, y = of(texts), np.array([i % 150 % 2 for i in range(200)])
    x = np.concatenate([x, x[[3, 153]]])
    y = np.concatenate([y, [0, 0]])
    want = quality.fit(np.array([(y == k).sum() for k in (0, 1)], dtype=float), np.stack([x[y == k].sum(axis=0) for k in (0, 1)]),
                       np.stack([x[y == k].T @ x[y == k] for k in (0, 1)]), 0.5, 0.01)
    assert model.score(x) == pytest.approx(want.score(x), abs=1e-6)
