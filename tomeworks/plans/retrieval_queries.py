"""Search, fusion, reranking and packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeworks.operators import dense_index as D
from tomeworks.operators import embedding as E
from tomeworks.operators import retrieval as R
from tomeworks.operators import sparse_index as S
from tomeworks.operators import understanding as U
from tomeworks.operators.sampling import first_per_key
from tomeworks.operators.settle import settle, shared_folder
from tomeworks.plans import base as b
from tomeworks.plans.base import query

K = 4


def questions(spark, sf_dir):
    return b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("overlap_topk", """WITH q AS (
  SELECT item_id AS query_id, list_distinct(string_split(text, '')) AS chars FROM benchmark),
c AS (SELECT doc_id AS chunk_id, list_distinct(string_split(text, '')) AS chars FROM documents),
scored AS (SELECT query_id, chunk_id, CAST(len(list_intersect(q.chars, c.chars)) AS DOUBLE) AS score FROM q, c)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
WHERE rank <= 4""")
def overlap_topk(spark, sf_dir):
    chunks = b.documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return R.search_overlap(questions(spark, sf_dir), chunks, K)


@query("dense_topk", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT a.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(a.e, c.e), 6) AS score FROM v a, v c
  WHERE a.vec_id % 20 = 0)
SELECT query_id, chunk_id, score, rank, label FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
JOIN embeddings ON vec_id = chunk_id WHERE rank <= 4""")
def dense_topk(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("dense_vector"))
    hits = R.search_dense(asked, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense_vector")), K)
    return R.with_fields(hits, e.withColumnRenamed("vec_id", "chunk_id"), {"label": "label"})


def dense_index(spark, sf_dir):
    """Every 20th vector searched for in an inverted file of all, and exactly."""
    e = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense_vector"))
    asked = e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    centroids = D.fit_centroids(e)
    path = f"{shared_folder(spark)}/dense-index-{uuid.uuid4().hex}"
    D.write_dense_index(D.build_dense_index(e, centroids), path)
    index = D.read_dense_index(spark, path)
    return index, settle(D.search_dense_index(asked, index, centroids, K)), R.search_dense(asked, e, K)


@query("dense_index_topk")
def dense_index_topk(spark, sf_dir):
    """Approximate neighbours, each with its place in the exact ranking where it has one."""
    _, found, exact = dense_index(spark, sf_dir)
    return found.join(exact.select("query_id", "chunk_id", F.col("rank").alias("exact_rank")), ["query_id", "chunk_id"], "left")


@query("dense_index_recall", """SELECT count(*) AS indexed, count(*) FILTER (WHERE vec_id % 20 = 0) * least(4, count(*)) AS exact_hits, true AS enough
FROM embeddings WHERE embedding IS NOT NULL""", headline=False)
def dense_index_recall(spark, sf_dir):
    """Rows in the index, hits of the exact search, and whether at least nine tenths of them were found."""
    index, found, exact = dense_index(spark, sf_dir)
    return D.recall(found, exact).select(F.lit(index.count()).alias("indexed"), "exact_hits", (F.col("recall") >= 0.9).alias("enough"))


TERMS = """terms AS (
  SELECT kind, id, CAST(('0x' || substr(md5(word), 1, 7)) AS BIGINT) AS token, word, count(*) AS n FROM (
    SELECT 'c' AS kind, doc_id AS id, unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents
    UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(text, '[a-z]+')) FROM benchmark) GROUP BY ALL),
tokens AS (SELECT kind, id, token, sum(n) AS w FROM terms GROUP BY ALL)"""
SPARSE = """sparse AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.id AS query_id, c.id AS chunk_id, CAST(sum(q.w * c.w) AS DOUBLE) AS score
    FROM tokens q JOIN tokens c ON q.token = c.token WHERE q.kind = 'q' AND c.kind = 'c' GROUP BY q.id, c.id))"""
DENSE = """projected AS (
  SELECT kind, id, j, sum(n * (strpos('0123456789abcdef', substr(md5(word), j, 1)) - 8.5)) AS x
  FROM terms, (SELECT CAST(unnest(range(1, 33)) AS INT) AS j) GROUP BY kind, id, j),
vectors AS (SELECT kind, id, list(CAST(x AS DOUBLE) ORDER BY j) AS e FROM projected GROUP BY kind, id),
dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.id AS query_id, c.id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS score
    FROM vectors q, vectors c WHERE q.kind = 'q' AND c.kind = 'c'))"""


def embedded(spark, sf_dir):
    """Questions and documents with the hashed test vectors; texts without words have none."""
    docs = b.documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text"))
    asked = questions(spark, sf_dir).withColumnRenamed("query", "text")
    return tuple(
        E.embed(df, E.hashed_terms, text=F.col("text")).withColumn(
            "dense_vector", F.when(F.size("sparse_vector") > 0, F.col("dense_vector")))
        for df in (asked, docs)
    )


@query("embed_chunks", """WITH t AS (
  SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 7)) AS BIGINT) AS token,
         strpos('0123456789abcdef', substr(md5(word), 1, 1)) - 8.5 AS x FROM (
    SELECT doc_id, unnest(regexp_extract_all(source || '-' || lang || chr(10) || text, '[a-z]+')) AS word FROM documents))
SELECT doc_id, count(DISTINCT token) AS tokens, CAST(count(*) AS DOUBLE) AS weight, CAST(sum(x) AS DOUBLE) AS first
FROM t GROUP BY doc_id""")
def embed_chunks(spark, sf_dir):
    d = b.documents(spark, sf_dir).select(
        "doc_id", F.concat_ws("-", "source", "lang").alias("item_name"), F.col("text").alias("content"))
    v = E.embed(d, E.hashed_terms)
    total = F.aggregate(F.map_values("sparse_vector"), F.lit(0.0), lambda a, w: a + w)
    return v.select("doc_id", F.size("sparse_vector").alias("tokens"), total.alias("weight"),
                    F.col("dense_vector")[0].cast("double").alias("first"))


@query("sparse_topk", f"WITH {TERMS}, {SPARSE} SELECT * FROM sparse WHERE rank <= 4")
def sparse_topk(spark, sf_dir):
    asked, docs = embedded(spark, sf_dir)
    return R.search_sparse(asked, docs, K)


@query("sparse_index_topk", f"WITH {TERMS}, {SPARSE} SELECT * FROM sparse WHERE rank <= 4")
def sparse_index_topk(spark, sf_dir):
    """The rows of ``sparse_topk`` from an inverted index that is written and read again."""
    asked, docs = embedded(spark, sf_dir)
    path = f"{shared_folder(spark)}/sparse-index-{uuid.uuid4().hex}"
    S.write_sparse_index(S.build_sparse_index(docs, range_rows=64), path)
    return S.search_sparse_index(asked, S.read_sparse_index(spark, path), K).hits


@query("hybrid_topk", f"""WITH {TERMS}, {SPARSE}, {DENSE},
fused AS (
  SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (
    SELECT query_id, chunk_id, rank FROM sparse WHERE rank <= 20
    UNION ALL SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 20) GROUP BY query_id, chunk_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)
WHERE rank <= 4""")
def hybrid_topk(spark, sf_dir):
    asked, docs = embedded(spark, sf_dir)
    return U.search_hybrid(asked, docs, K)


@query("rerank_topk", """SELECT * FROM (
  SELECT source AS query_id, doc_id AS chunk_id, CAST(n_chars AS DOUBLE) AS score,
         row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
WHERE rank <= 3""")
def rerank_topk(spark, sf_dir):
    pairs = b.table(spark, sf_dir, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"))
    return R.rerank(pairs, 3)


@query("pack_contexts", """WITH ranked AS (
  SELECT source || lang AS query_id, source, lang AS title, CASE WHEN n_chars % 5 = 0 THEN '' ELSE text END AS content,
         doc_id AS chunk_id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY source || lang ORDER BY n_chars, doc_id) AS rank
  FROM documents),
lines AS (
  SELECT query_id, rank, '[文档:' || rank || '] [chunk_id=' || chunk_id || '] [title=' || title || '] [source=' || source
         || '] [score=' || printf('%.6f', score) || ']' || chr(10) || content AS line
  FROM ranked WHERE content <> ''),
used AS (SELECT *, sum(length(line)) OVER w + 2 * (count(*) OVER w - 1) AS used FROM lines
         WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
packed AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS contexts,
                  6000 - max(used) AS chars_left FROM used WHERE used <= 6000 GROUP BY query_id)
SELECT q.query_id, coalesce(context, '') AS context, coalesce(contexts, 0) AS contexts, coalesce(chars_left, 6000) AS chars_left
FROM (SELECT DISTINCT query_id FROM ranked) q LEFT JOIN packed p ON p.query_id = q.query_id""")
def pack_contexts(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select(
        F.concat("source", "lang").alias("query_id"), "source", F.col("lang").alias("title"),
        F.when(F.col("n_chars") % 5 == 0, "").otherwise(F.col("text")).alias("content"),
        F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"))
    # the whole ranking; packing prunes it to what its budget can hold
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_id"))
    return R.pack_contexts(d.withColumn("rank", place))


_ALIGNED = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
names AS (SELECT vec_id, label, e FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
scored AS (SELECT a.vec_id AS query_id, 'item-' || n.label AS item_name, n.vec_id AS item_id,
                  round(list_cosine_similarity(a.e, n.e), 6) AS score FROM v a, names n),
aligned AS (SELECT query_id, item_name, score FROM scored
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 5)"""


def aligned(spark, sf_dir):
    """Every vector as a mention, the first vector of each label as a known item."""
    e = b.table(spark, sf_dir, "embeddings")
    names = first_per_key(e, ["label"], [F.col("vec_id")]).select(
        F.col("vec_id").alias("item_id"), F.concat(F.lit("item-"), F.col("label").cast("string")).alias("item_name"),
        F.col("embedding").alias("dense_vector"))
    mentions = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("dense_vector"))
    return U.align_items(mentions, names, 5)


@query("item_alignment", f"{_ALIGNED} SELECT * FROM aligned")
def item_alignment(spark, sf_dir):
    return aligned(spark, sf_dir)


@query("item_decision", f"""{_ALIGNED},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_name) AS n FROM aligned),
best AS (SELECT query_id, max(CASE WHEN n = 1 THEN item_name END) AS one, max(CASE WHEN n = 1 THEN score END) AS s1,
                max(CASE WHEN n = 2 THEN score END) AS s2, count(*) FILTER (WHERE n <= 3 AND score >= 0.1) AS near,
                string_agg(item_name, ',' ORDER BY n) FILTER (WHERE n <= 3 AND score >= 0.1) AS options FROM top GROUP BY query_id),
decided AS (SELECT *, CASE WHEN s1 >= 0.3 OR (s1 >= 0.1 AND s1 - coalesce(s2, 0) >= 0.05) THEN 'confirm'
                           WHEN near > 1 THEN 'clarify' WHEN near = 1 THEN 'confirm' ELSE 'no_filter' END AS action FROM best)
SELECT query_id, action, CASE WHEN action = 'confirm' THEN one END AS item_name,
       CASE WHEN action = 'clarify' THEN options ELSE '' END AS options FROM decided""")
def item_decision(spark, sf_dir):
    done = U.decide_item(aligned(spark, sf_dir), high=0.3, mid=0.1, gap=0.05)
    return done.withColumn("options", F.array_join("options", ","))
