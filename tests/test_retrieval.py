import random

import pytest
from pyspark.sql import functions as F

from tomeworks.operators import retrieval as R
from tomeworks.operators import understanding as U


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(9)
    text = lambda: "".join(r.choice("abcdefgh的了 ") for _ in range(r.randint(0, 12)))
    vec = lambda: [r.uniform(-1, 1) for _ in range(8)]
    sparse = lambda: {r.randint(0, 30): r.choice([-1.0, 0.5, 2.0]) for _ in range(r.randint(0, 6))}
    q = [(i, text(), vec(), sparse()) for i in range(23)]
    c = [(i * 7, text(), vec(), sparse()) for i in range(150)]
    fields = "dense_vector array<double>, sparse_vector map<int,double>"
    return (q, c, spark.createDataFrame(q, f"query_id bigint, query string, {fields}"),
            spark.createDataFrame(c, f"chunk_id bigint, content string, {fields}").repartition(5))


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return round(dot / (sum(x * x for x in a) ** .5 * sum(y * y for y in b) ** .5), 6)


def by_inner_product(queries, chunks, k, **limits):
    return R.search_dense(queries, chunks, k, metric="IP", **limits)


SCORES = {
    "inner": (by_inner_product, lambda q, c: round(sum(x * y for x, y in zip(q[2], c[2])), 6)),
    "overlap": (R.search_overlap, lambda q, c: float(len(set(q[1]) & set(c[1])))),
    "dense": (R.search_dense, lambda q, c: cosine(q[2], c[2])),
    "sparse": (R.search_sparse, lambda q, c: round(sum(w * c[3][t] for t, w in q[3].items() if t in c[3]), 6) if set(q[3]) & set(c[3]) else None),
}


@pytest.mark.parametrize("kind", SCORES)
@pytest.mark.parametrize("limits", [{}, {"block_bytes": 300}])
def test_search_equals_brute_force(tables, kind, limits):
    """With one block of queries, and with several."""
    search, score = SCORES[kind]
    q, c, queries, chunks = tables
    got = {}
    for r in search(queries, chunks, 3, **limits).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
    for one in q:
        scored = [(x[0], score(one, x)) for x in c]
        want = sorted(((i, s) for i, s in scored if s is not None), key=lambda p: (-p[1], p[0]))[:3]
        assert got.get(one[0], []) == want


@pytest.mark.parametrize("first_rows", [1, 2, 9, 60, 500])
def test_overlap_search_equals_brute_force_however_many_chunks_come_first(spark, first_rows):
    """Ids of chunks and queries that repeat, chunks without an id, and texts without characters."""
    r = random.Random(first_rows)
    text = lambda: "".join(r.choice("abcdefghij的了") for _ in range(r.choice([0, 3, 8, 30])))
    chunks = [(None if n == 17 else r.randrange(150), text()) for n in range(200)]
    queries = [(r.randrange(40), text()) for _ in range(50)]
    found = R.search_overlap(spark.createDataFrame(queries, "query_id bigint, query string"),
                             spark.createDataFrame(chunks, "chunk_id bigint, content string").repartition(3), 3, first_rows=first_rows)
    got = {}
    for row in found.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((-row["score"], row["chunk_id"]))
    for one in {i for i, _ in queries}:
        scored = [(-float(len(set(q) & set(t))), c) for i, q in queries if i == one for c, t in chunks]
        named = sorted(p for p in scored if p[1] is not None)
        assert [p for p in got[one] if p[1] is not None] == named[:sum(p[1] is not None for p in got[one])]
        assert len(got[one]) == 3


def test_queries_that_are_done_do_not_meet_the_other_chunks(spark, monkeypatch):
    met = []
    blocks = R.ranked_blocks
    monkeypatch.setattr(R, "ranked_blocks", lambda queries, *rest: met.extend(queries.collect()) or blocks(queries, *rest))
    chunks = spark.createDataFrame([(i, "abcdef") for i in range(30)] + [(40, "xyz")], "chunk_id bigint, content string")
    queries = spark.createDataFrame([(i, "abc") for i in range(20)] + [(50, "ax")], "query_id bigint, query string")
    got = R.search_overlap(queries, chunks, 2, first_rows=5).where("query_id >= 19").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == [(19, 0, 3.0), (19, 1, 3.0), (50, 0, 1.0), (50, 1, 1.0)]
    assert {r["query_id"] for r in met} == {50}


def test_no_cross_join(tables):
    _, _, queries, chunks = tables
    for limits in ({}, {"block_bytes": 300}):
        plan = R.search_dense(queries, chunks, 3, **limits)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_pass_for_both_scores(tables):
    _, _, queries, chunks = tables
    both = R.search_both(queries, chunks, 3, block_bytes=500)
    for kind, alone in (("dense", R.search_dense(queries, chunks, 3)), ("sparse", R.search_sparse(queries, chunks, 3))):
        columns = ["query_id", "chunk_id", "score", "rank"]
        assert set(both.where(F.col("kind") == kind).select(columns).collect()) == set(alone.select(columns).collect())


def test_no_queries(tables):
    _, _, queries, chunks = tables
    assert R.search_overlap(queries.where("false"), chunks, 3).count() == 0


def test_pack_stops_at_the_first_that_does_not_fit(spark):
    rows = [(1, 1, "a" * 50), (1, 2, ""), (1, 3, "b" * 500), (1, 4, "c"), (2, 1, "x" * 500)]
    packed = {r["query_id"]: r for r in R.pack_contexts(spark.createDataFrame(rows, "query_id int, rank int, content string"), 120).collect()}
    assert packed[1]["context"] == "[文档:1]\n" + "a" * 50 and packed[1]["chars_left"] == 120 - 57
    assert packed[2]["context"] == "" and packed[2]["chars_left"] == 120


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, chunk_id bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id bigint, chunk_id bigint, rank int")
    assert [(r["chunk_id"], r["rank"]) for r in R.rrf([a, b]).orderBy("rank").collect()] == [(11, 1), (10, 2)]


@pytest.mark.parametrize("scores, action, options", [
    ([0.8, 0.79], "confirm", []), ([0.6, 0.5], "confirm", []), ([0.6, 0.55, 0.5, 0.46], "clarify", ["i0", "i1", "i2"]),
    ([0.5], "confirm", []), ([0.46, 0.4], "confirm", []), ([0.4, 0.1], "no_filter", []),
])
def test_item_decision(spark, scores, action, options):
    df = spark.createDataFrame([(1, f"i{n}", s) for n, s in enumerate(scores)], "query_id int, item_name string, score double")
    row = U.decide_item(df).first()
    assert (row["action"], row["options"]) == (action, options)
    assert (row["item_name"] == "i0") == (action == "confirm")


def test_recalled(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], ["b"]), (None, ["b"])], "r array<string>, s array<string>")
    assert [r[0] for r in df.select(R.recalled(F.col("r"), F.col("s"))).collect()] == [True, False, False]


def test_contexts_of_hits_are_read_alone_and_hot_ones_are_dealt(spark, monkeypatch):
    hits = spark.createDataFrame([(q, c, n + 1) for q in range(50) for n, c in enumerate([7, q % 3, None])], "query_id bigint, chunk_id bigint, rank int")
    contexts = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(2, "again")], "chunk_id bigint, ctx string")
    kept, settled = [], R.settle
    monkeypatch.setattr(R, "settle", lambda df: kept.append(settled(df)) or kept[-1])
    for per_task in (500, 4):
        got = {r["query_id"]: r["contexts"] for r in R.retrieved_contexts(hits, contexts, per_task).collect()}
        assert got == {q: ["t7"] + {0: ["t0"], 1: ["t1"], 2: ["again", "t2"]}[q % 3] for q in range(50)}
    once, often = [sorted(r["ctx"] for r in df.collect()) for df in kept if "ctx" in df.columns]
    assert once == ["again", "t0", "t1", "t2", "t7"]
    assert often == ["again"] * 4 + ["t0"] * 5 + ["t1"] * 5 + ["t2"] * 4 + ["t7"] * 13
