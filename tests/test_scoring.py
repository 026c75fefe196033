import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tomeworks.operators.dense_index import ProbedScorer
from tomeworks.operators.scoring import DenseScorer, OverlapScorer, SparseScorer, best_of


def texts(n, seed, first):
    r = random.Random(seed)
    return pd.DataFrame({first: np.arange(n), "text": ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", r.randint(0, 9))) for _ in range(n)]})


def vectors(n, seed, first):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({first: np.arange(n), "vector": list(rng.integers(-3, 4, (n, 8)).astype(float))})
    frame["tokens"] = [np.sort(rng.choice(30, rng.integers(0, 5), replace=False)) for _ in range(n)]
    frame["weights"] = [rng.integers(1, 4, len(t)).astype(float) for t in frame["tokens"]]
    frame["list"] = np.arange(n) % 3
    frame["lists"] = [np.arange(i % 3 + 1) for i in range(n)]
    return frame


def pair(kind, q, c):
    if kind == "overlap":
        return float(len(set(q.text) & set(c.text)))
    if kind == "sparse":
        a, b = dict(zip(q.tokens, q.weights)), dict(zip(c.tokens, c.weights))
        return sum(a[t] * b[t] for t in a.keys() & b.keys()) if a.keys() & b.keys() else None
    return float(q.vector @ c.vector) if kind == "dense" or c.list in q.lists else None


@pytest.mark.parametrize("kind", ["overlap", "dense", "sparse", "probed"])
def test_several_runs_of_queries_equal_brute_force(kind):
    make = texts if kind == "overlap" else vectors
    queries, chunks = make(2100, 1, "query_id"), make(90, 2, "chunk_id")
    scorer = {"overlap": OverlapScorer.of, "dense": lambda f: DenseScorer.of(f, "IP"), "sparse": SparseScorer.of,
              "probed": lambda f: ProbedScorer.of(f, "IP")}[kind](queries)
    found = pd.concat(best_of(iter([chunks[:50], chunks[50:]]), {kind: scorer}, 3))
    got = {(r.query_id, r.chunk_id, r.score) for r in found.itertuples()}
    rows, want = list(chunks.itertuples()), set()
    for q in queries.itertuples():
        scored = [(-s, c.chunk_id) for c in rows if (s := pair(kind, q, c)) is not None]
        want |= {(q.query_id, i, -s) for s, i in sorted(scored)[:3]}
    assert got == want


@pytest.mark.parametrize("kind", ["overlap", "dense"])
def test_memory_does_not_grow_with_the_queries(kind):
    make, scorer_of = (texts, OverlapScorer.of) if kind == "overlap" else (vectors, DenseScorer.of)
    queries, chunks = make(20_000, 1, "query_id"), make(2048, 2, "chunk_id")
    tracemalloc.start()
    rows = sum(map(len, best_of(iter([chunks]), {kind: scorer_of(queries)}, 4)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 80_000 and peak < 250e6


def test_given_floors_leave_only_better_chunks_in_any_order():
    """``floor`` and ``last``: score and id of the k-th best found elsewhere, or none."""
    r = random.Random(3)
    queries, chunks = texts(300, 1, "query_id"), texts(500, 2, "chunk_id")
    chunks["chunk_id"] = [r.randrange(120) for _ in range(500)]
    queries["floor"] = [r.choice([-np.inf, 0.0, 2.0, float(len(t))]) for t in queries["text"]]
    queries["last"] = [np.iinfo(np.int64).max if f == -np.inf else r.randrange(120) for f in queries["floor"]]
    found = pd.concat(best_of(iter([chunks[:200], chunks[200:]]), {"overlap": OverlapScorer.of(queries)}, 3))
    got, rows = found.groupby("query_id")[["score", "chunk_id"]].apply(lambda f: sorted(map(tuple, f.to_numpy().tolist()))), list(chunks.itertuples())
    for q in queries.itertuples():
        scored = sorted((-pair("overlap", q, c), c.chunk_id) for c in rows)[:3]
        want = {(-s, i) for s, i in scored if (s, i) < (-q.floor, q.last)}
        assert want <= set(got.get(q.query_id, [])) and len(got.get(q.query_id, [])) <= 3


def test_only_chunks_that_can_still_enter_are_counted(monkeypatch):
    """Queries with k chunks that have all their characters need no later chunk; one with a rare character needs those with it."""
    queries = pd.DataFrame({"query_id": np.arange(3), "text": ["abc", "cab", "abz"]})
    chunks = pd.DataFrame({"chunk_id": np.arange(8000), "text": ["abcdefgh"] * 8000})
    chunks.loc[[5000, 7000], "text"] = "zaq"
    counted, added = [], np.add

    class Counting:
        @staticmethod
        def reduce(held, **named):
            counted.append(held.shape[1])
            return added.reduce(held, **named)

    monkeypatch.setattr("tomeworks.operators.scoring.np.add", Counting)
    found = pd.concat(best_of(iter([chunks]), {"overlap": OverlapScorer.of(queries)}, 2))
    assert {(r.query_id, r.chunk_id, r.score) for r in found.itertuples()} == {(q, i, 3.0 if q < 2 else 2.0) for q in range(3) for i in range(2)}
    assert sum(counted) == 3 * 2048 + 2
