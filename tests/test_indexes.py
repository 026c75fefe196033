import random

import numpy as np
from pyspark.sql import functions as F

from tomeworks.operators import dense_index as D
from tomeworks.operators import retrieval as R
from tomeworks.operators import sparse_index as S

ROWS = "{} bigint, sparse_vector map<int,float>"


def vectors(seed, n, longest, tokens=200):
    """Sparse rows whose sizes differ much, some without tokens, some equal."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        size = min(int(r.paretovariate(0.7)) - 1, longest)
        v = {min(int(r.paretovariate(0.8)), tokens): float(r.randint(1, 40)) / 4 for _ in range(size)}
        rows.append((i * 7 % n, rows[-1][1] if rows and i % 9 == 0 else v))
    return rows


def both(spark, chunks, queries, k, **options):
    c = spark.createDataFrame(chunks, ROWS.format("chunk_id")).repartition(3)
    q = spark.createDataFrame(queries, ROWS.format("query_id"))
    found = S.search_sparse_index(q, S.build_sparse_index(c, range_rows=options.pop("range_rows", 8)), k, **options)
    want = R.search_sparse(q, c, k)
    rows = [sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in d.collect()) for d in (found.hits, want)]
    return rows, found


def test_index_equals_the_full_search_and_reads_less(spark):
    chunks, queries = vectors(1, 3000, 400), vectors(2, 20, 12)
    (got, want), found = both(spark, chunks, queries, 4)
    assert got == want and got
    reads = found.reads.agg(F.sum("read").alias("read"), F.sum("postings").alias("all")).first()
    assert 0 < reads["read"] < 0.5 * reads["all"]


def test_negative_weights_ties_and_few_hits(spark):
    r = random.Random(7)
    chunks = [(i, {r.randint(1, 12): float(r.choice([-2, -1, 0, 1, 2])) for _ in range(r.randint(0, 4))}) for i in range(80)]
    queries = [(i, {r.randint(1, 14): float(r.choice([-1, 1, 2])) for _ in range(3)}) for i in range(15)] + [(90, {}), (91, {77: 1.0})]
    (got, want), _ = both(spark, chunks, queries, 5, probes=1)
    assert got == want
    assert not [row for row in got if row[0] in (90, 91)]
    for k in (1, 200):
        (got, want), _ = both(spark, chunks, queries, k, range_rows=1000)
        assert got == want


def test_empty_index_and_no_queries(spark):
    some = [(1, {1: 1.0})]
    for chunks, queries in (([], some), (some, []), ([(1, {})], some)):
        (got, want), _ = both(spark, chunks, queries, 4)
        assert got == want == []


def test_weights_that_are_null_and_chunks_without_id(spark):
    """A weight that is null is no posting; as in the full search of other chunks, nothing else changes."""
    chunks = spark.createDataFrame([(1, {1: None, 2: 1.0}), (2, {1: 2.0}), (3, {1: None}), (3, {2: 4.0})], ROWS.format("chunk_id"))
    blocks = {b["token"]: (b["chunk_ids"], b["weights"]) for b in S.build_sparse_index(chunks.where("chunk_id <> 2").unionByName(
        spark.createDataFrame([(None, {1: 2.0})], chunks.schema))).groupBy("token").agg(
        F.flatten(F.collect_list("chunk_ids")).alias("chunk_ids"), F.flatten(F.collect_list("weights")).alias("weights")).collect()}
    assert blocks[1] == ([None], [2.0]) and sorted(zip(*blocks[2])) == [(1, 1.0), (3, 4.0)]


def test_blocks_are_no_longer_than_ranges(spark):
    """A token in every chunk has one block a range."""
    chunks = spark.createDataFrame([(i, {1: 1.0, 100 + i: 1.0}) for i in range(500)], ROWS.format("chunk_id"))
    blocks = S.build_sparse_index(chunks, range_rows=50).where("token = 1").collect()
    assert sum(b["postings"] for b in blocks) == 500 and max(b["postings"] for b in blocks) <= 100 and len(blocks) == 10


def test_build_and_search_move_no_single_postings(spark, monkeypatch):
    """Vectors go whole to their range; a search moves only blocks of its tokens in ranges that it scores."""
    chunks = spark.createDataFrame([(i, {t: 1.0 for t in range(i, i + 50)}) for i in range(400)], ROWS.format("chunk_id"))
    index = S.build_sparse_index(chunks, range_rows=50)
    plan = index._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "hashpartitioning(level" in plan and "token#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    hits = S.search_sparse_index(chunks.limit(3).withColumnRenamed("chunk_id", "query_id"), index, 4).hits
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2
    # ranges hold no more postings than one call should
    monkeypatch.setattr(S, "RANGE_POSTINGS", 1000)
    ranges = S.build_sparse_index(chunks).groupBy(*S.RANGE).agg(F.sum("postings").alias("n")).collect()
    assert sum(r["n"] for r in ranges) == 20_000 and max(r["n"] for r in ranges) <= 2000


def clusters(n, seed=3):
    """Vectors around a few centres, one of which holds a third of them."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(20, 16)) * 4
    own = np.where(draw.random(n) < 1 / 3, 0, draw.integers(20, size=n))
    return [(i, [float(x) for x in centres[c] + draw.normal(size=16)]) for i, c in enumerate(own)]


DENSE = "{} bigint, dense_vector array<float>"


def test_inverted_file_finds_most_neighbours_in_few_lists(spark, tmp_path):
    rows = clusters(3000)
    chunks = spark.createDataFrame([*rows, (5000, None)], DENSE.format("chunk_id"))
    queries = spark.createDataFrame(rows[::20] + [(9000, None)], DENSE.format("query_id"))
    centroids = D.fit_centroids(chunks, sample_rows=1500)
    assert centroids.centres.shape == (55, 16) and centroids.probes < 28
    D.write_dense_index(D.build_dense_index(chunks, centroids), str(tmp_path / "i"))
    index = D.read_dense_index(spark, str(tmp_path / "i"))
    assert index.count() == 3000
    exact = R.search_dense(queries, chunks, 4)
    found = D.search_dense_index(queries, index, centroids, 4)
    row = D.recall(found, exact).first()
    assert row["exact_hits"] == 600 and row["recall"] >= 0.9
    # blocks of queries do not change the result, and all lists give the exact one
    blocks = D.search_dense_index(queries, index, centroids, 4, block_bytes=4000)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found.collect()))
    every = D.search_dense_index(queries, index, centroids, 4, probes=55)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_inverted_file_of_few_equal_or_no_rows(spark):
    none = spark.createDataFrame([], DENSE.format("chunk_id"))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, [0.0, 0.0])], DENSE.format("chunk_id"))
    asked = spark.createDataFrame([(1, [2.0, 4.0])], DENSE.format("query_id"))
    for chunks, want in ((none, []), (same, [(0, 1), (1, 2), (2, 3)]), (same.limit(1), [(0, 1)])):
        centroids = D.fit_centroids(chunks)
        hits = D.search_dense_index(asked, D.build_dense_index(chunks, centroids), centroids, 3, probes=9)
        assert sorted((r["chunk_id"], r["rank"]) for r in hits.collect()) == want


def test_blocks_of_queries_are_settled_one_by_one(spark):
    rows = clusters(300)
    chunks, queries = spark.createDataFrame(rows, DENSE.format("chunk_id")), spark.createDataFrame(rows[::7], DENSE.format("query_id"))
    one, many = R.search_dense(queries, chunks, 3), R.search_dense(queries, chunks, 3, block_bytes=500)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
