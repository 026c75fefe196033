import random
import re
from collections import Counter

import numpy as np
import pytest

from tomeworks.llm import graph, neardup
from tomeworks.llm import words as W


def cell_set(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    counts = Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()
    return {(g, i) for g, n in counts.items() for i in range(n)}


def classes_by_hand(rows, similarity=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [cell_set(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return Counter((d, min(g), len(g)) for g in groups.values() for d in g)


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 60, 300]))]
        texts.append(" ".join(base))
        for _ in range(6):  # chains of growing distance, and copies with other case and marks
            base = list(base)
            for _ in range(max(1, len(base) // 60)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
        texts.append(texts[-1].upper().replace(" ", ", "))
    texts += ["one two", "One, two!", "one", "", None, "...", "same line again and again. " * 500, "same line again and again. " * 480]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.classes(df).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == classes_by_hand(rows)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {r.class_id for r in got}
    assert {r.doc_id for r in neardup.drop_near_copies(df).collect()} == kept


def test_members_of_a_group_that_its_middle_does_not_reach(spark):
    """Copies of one base that are less alike among themselves, and a second base in the same buckets."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(60):
        own = list(base)
        for j in rng.sample(range(400), 7 if i < 30 else 14):
            own[j] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == classes_by_hand(rows)


def test_signatures_estimate_the_weighted_similarity():
    a = W.mix(np.arange(1000, dtype=np.uint64))
    left, right = np.concatenate([a[:700], a[:50]]), np.concatenate([a[200:700], a[:50], a[:50]])
    grams, rows = np.concatenate([left, right]), np.repeat([0, 1], [len(left), len(right)])
    cell, at = neardup.cells(grams, rows)
    first, second = set(cell[at == 0].tolist()), set(cell[at == 1].tolist())
    sketch = neardup.signatures(cell, at, 2, 4000)
    assert np.isfinite(sketch).all()
    assert (sketch[0] == sketch[1]).mean() == pytest.approx(len(first & second) / len(first | second), abs=0.04)
    alone = neardup.signatures(*neardup.cells(left, np.zeros(len(left), dtype=np.int64)), 1, 4000)
    assert (alone[0] == sketch[0]).all()  # a text's signature does not depend on its batch


def test_repeated_rows_null_ids_clashing_columns_and_empty_tables(spark):
    text = "a b c d e f g h"
    rows = [(1, text, "p"), (1, text, "p"), (None, text, "q"), (2, None, "r"), (3, "", "s"), (3, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = neardup.classes(df).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.class_size) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1), (3, 3, 1), (3, 3, 1)]
    assert sum(r.kept for r in got) == 4
    stay = neardup.drop_near_copies(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in stay) == [(1, "p"), (2, "r"), (3, "s"), (3, "s")]
    assert neardup.classes(df.limit(0)).count() == 0 and neardup.drop_near_copies(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def one_pair_among_many(place):
    """All texts are far from one another but for two, and whatever two of them share, many others have as well."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(280)]
    phrases = [[[f"p{slot}.{turn}.{i}" for i in range(10)] for turn in range(3)] for slot in range(12)]
    picks = []
    while len(picks) < 150:
        pick = [rng.randrange(3) for _ in range(12)]
        if all(sum(a == b for a, b in zip(pick, other)) <= 7 for other in picks):
            picks.append(pick)
    near = list(picks[place])
    near[5] = (near[5] + 1) % 3
    return [(i, " ".join(base + [w for slot, turn in enumerate(pick) for w in phrases[slot][turn]])) for i, pick in enumerate([*picks, near])]


@pytest.mark.parametrize("block", [400, 20])
def test_one_similar_pair_among_many_texts_that_share_its_cells(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block, raising=False)
    rows = one_pair_among_many(20)
    expected = classes_by_hand(rows)
    assert sorted(d for d, _, n in expected if n > 1) == [20, 150]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, per_band=1).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expected
