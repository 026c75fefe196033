"""Search over a chunk table, rank fusion, reranking, context packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeworks.functions.text import strip, text_or_empty
from tomeworks.operators.sampling import first_per_key
from tomeworks.operators.scoring import NO_ID, DenseScorer, OverlapScorer, SparseScorer, best_of
from tomeworks.operators.settle import settle

HITS = "kind string, query_id bigint, chunk_id bigint, score double"
BLOCK_BYTES = 8 << 20
FIRST_ROWS = 16_384
TEXT_ROWS = 256

ScorerOf = Callable[[pd.DataFrame], object]


def ranked_blocks(queries: DataFrame, chunks: DataFrame, scorers: Mapping[str, ScorerOf], size: Column, k: int, block_bytes: int,
                  wanted: Callable[[pa.Table], Column] | None = None) -> DataFrame:
    """Exact top ``k`` chunks of every query for each kind of score: ``kind, query_id, chunk_id, score, rank``.

    The queries are settled once and cut into blocks of about ``block_bytes`` by hash, ``size`` being
    the bytes of one. Each block is shipped to the tasks and meets every chunk where it lies: a task
    reduces its part of the chunks to ``k`` rows per query, and only those are shuffled, merged first by
    groups of tasks and then by query. The number of tasks follows the cores, so the rows that are
    merged do not grow with the chunks. All against all is possible and costs one scan for each block; with
    several, the hits of each are settled before the next is fetched, so the driver holds one at a time.
    ``wanted`` gives the filter of the scan for a block.
    """
    spark = queries.sparkSession
    held = settle(queries)
    total = held.agg(F.coalesce(F.sum(size + 64), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], HITS + ", rank int")
    blocks = -(-int(total) // block_bytes)
    tasks = 4 * spark.sparkContext.defaultParallelism
    scanned = chunks.coalesce(tasks)
    hits = None
    for block in range(blocks):
        own = held.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        read = scanned if wanted is None else chunks.where(wanted(own)).coalesce(tasks)
        part = read.mapInPandas(_reducer(own, scorers, k), HITS)
        part = part if blocks == 1 else settle(part)
        hits = part if hits is None else hits.unionByName(part)
    grouped = hits.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(max(1, int(tasks**0.5)))))
    order = [F.desc("score"), F.asc("chunk_id")]
    merged = first_per_key(grouped, ["kind", "query_id", "_group"], order, k).drop("_group", "_rank")
    return first_per_key(merged, ["kind", "query_id"], order, k, rank="rank")


def _reducer(block, scorers: Mapping[str, ScorerOf], k: int):
    def reduce_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = block.to_pandas()
        made = {kind: scorer_of(queries) for kind, scorer_of in scorers.items()}
        yield from best_of(frames, {kind: s for kind, s in made.items() if s is not None}, k)

    return reduce_task


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return first_per_key(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, rank="rank")


def _characters(text: Column) -> Column:
    """The distinct characters of a text, found before it would leave the JVM."""
    return F.array_join(F.array_distinct(F.split(text_or_empty(text), "")), "")


def _characters_of_long(text: Column) -> Column:
    """The same for whole chunks, in a third of the time or less."""
    @F.pandas_udf("string")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(set(t)))

    return distinct(text_or_empty(text))


def search_overlap(queries: DataFrame, chunks: DataFrame, k: int = 4, block_bytes: int = BLOCK_BYTES,
                   first_rows: int = FIRST_ROWS) -> DataFrame:
    """``queries(query_id, query)`` against ``chunks(chunk_id, content)`` by the number of
    distinct shared characters; ties in chunk order.

    All queries meet the chunks of the ``first_rows`` lowest ids, each in a task with others of its kind. A query
    with ``k`` chunks there that have all its characters is done, as later ids lose every tie. The others meet the
    remaining chunks, with the score that a chunk has to exceed. Exact, whatever the texts and the order of the rows.
    """
    order = [F.desc("score"), F.asc("chunk_id")]
    asked = settle(queries.select(F.col("query_id").cast("bigint"), _characters(F.col("query")).alias("text")))
    narrow = settle(chunks.select(F.col("chunk_id").cast("bigint"), _characters_of_long(F.col("content")).alias("text"))
                    .sortWithinPartitions(F.asc_nulls_last("chunk_id")), TEXT_ROWS)
    numbered = narrow.where("chunk_id IS NOT NULL")
    lowest = numbered.select("chunk_id").orderBy("chunk_id").limit(first_rows).toArrow()["chunk_id"]
    # Ids may repeat: those below the last one named are fewer than first_rows in any case.
    within = F.col("chunk_id") < lowest[-1].as_py() if len(lowest) == first_rows else F.lit(True)
    tasks = 4 * queries.sparkSession.sparkContext.defaultParallelism
    near = settle(asked.repartition(tasks).mapInPandas(_meeting(numbered.where(within).toArrow(), k), HITS)).drop("kind")
    ended = first_per_key(near, ["query_id"], order, k, rank="rank").where(F.col("rank") == k)
    beaten = ended.select("query_id", F.col("score").alias("floor"), F.col("chunk_id").alias("last"))
    still = asked.join(beaten, "query_id", "left").where("floor IS NULL OR floor < length(text)").select(
        "query_id", "text", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.coalesce("last", F.lit(int(NO_ID))).alias("last"))
    rest = narrow.where(F.col("chunk_id").isNull() | ~within)
    far = ranked_blocks(still, rest, {"overlap": OverlapScorer.of}, F.octet_length("text") + 16, k, block_bytes)
    return first_per_key(near.unionByName(far.drop("kind", "rank")), ["query_id"], order, k, rank="rank")


def _meeting(chunks: pa.Table, k: int):
    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = chunks.to_pandas()
        for queries in frames:
            if len(queries):
                yield from best_of(iter([held]), {"overlap": OverlapScorer.of(queries)}, k)

    return meet


def _dense(key: str, vector: str) -> list[Column]:
    return [F.col(key).cast("bigint"), F.col(vector).alias("vector")]


def _sparse(key: str, vector: str) -> list[Column]:
    return [F.col(key).cast("bigint"), F.map_keys(vector).alias("tokens"), F.map_values(vector).alias("weights")]


def _length(name: str) -> Column:
    return F.coalesce(F.array_size(name), F.lit(0))


def search_dense(queries: DataFrame, chunks: DataFrame, k: int = 4, vector: str = "dense_vector",
                 metric: str = "COSINE", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Top ``k`` by cosine, or by inner product with ``metric='IP'``. Scores count to six digits,
    ties go to the lower chunk id."""
    q = queries.select(*_dense("query_id", vector)).where("vector IS NOT NULL")
    c = chunks.select(*_dense("chunk_id", vector)).where("vector IS NOT NULL")
    found = ranked_blocks(q, c, {"dense": lambda f: DenseScorer.of(f, metric)}, 8 * _length("vector"), k, block_bytes)
    return found.drop("kind")


def search_sparse(queries: DataFrame, chunks: DataFrame, k: int = 4, vector: str = "sparse_vector",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Inner-product top ``k`` over ``token -> weight`` maps; only chunks sharing a token."""
    q = queries.where(F.size(vector) > 0).select(*_sparse("query_id", vector))
    c = chunks.where(F.size(vector) > 0).select(*_sparse("chunk_id", vector))
    return ranked_blocks(q, c, {"sparse": SparseScorer.of}, 16 * _length("tokens"), k, block_bytes).drop("kind")


def search_both(queries: DataFrame, chunks: DataFrame, k: int, dense: str = "dense_vector", sparse: str = "sparse_vector",
                metric: str = "COSINE", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Dense and sparse rankings in one pass over the chunks, told apart by ``kind``."""
    def flat(df: DataFrame, key: str) -> DataFrame:
        return df.select(*_dense(key, dense), *_sparse(key, sparse)[1:])

    return ranked_blocks(flat(queries, "query_id"), flat(chunks, "chunk_id"),
                   {"dense": lambda f: DenseScorer.of(f, metric), "sparse": SparseScorer.of},
                   8 * _length("vector") + 16 * _length("tokens"), k, block_bytes)


def with_fields(hits: DataFrame, chunks: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Hits with chunk columns under their logical names."""
    wanted = chunks.select(
        F.col("chunk_id").alias("_id"),
        *[F.col(actual).alias(logical) for logical, actual in fields.items() if logical != "chunk_id"],
    )
    return hits.join(wanted, hits["chunk_id"] == wanted["_id"]).drop("_id")


def rrf(rankings: Sequence[DataFrame], k: int = 4, k0: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``query_id, chunk_id, rank`` tables (k0 = 60 as published)."""
    union = None
    for r in rankings:
        part = r.select("query_id", "chunk_id", (F.lit(1.0) / (F.col("rank") + k0)).alias("w"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), 9).alias("score"))
    return _ranked(fused, k)


def rerank(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query by a pair score computed outside."""
    return _ranked(scored.drop("rank"), k)


def pack_contexts(ranked: DataFrame, budget: int = 6000) -> DataFrame:
    """One context string per query: chunks in rank order while they fit.

    Empty contents keep their number but are left out; packing ends at the first chunk that
    does not fit. Lengths are positive, so that is a running sum within the ``k`` rows of a query.
    """
    labels = [("chunk_id", "[chunk_id={}]"), ("title", "[title={}]"), ("source", "[source={}]"),
              ("file_title", "[file_title={}]"), ("url", "[url={}]")]
    parts = [F.concat(F.lit("[文档:"), F.col("rank").cast("string"), F.lit("]"))]
    for name, label in labels:
        if name in ranked.columns:
            before, after = label.split("{}")
            value = strip(F.col(name).cast("string"))
            parts.append(F.when(text_or_empty(value) != "", F.concat(F.lit(before), value, F.lit(after))))
    if "score" in ranked.columns:
        parts.append(F.when(F.col("score").isNotNull(), F.format_string("[score=%.6f]", F.col("score").cast("double"))))
    lines = ranked.where(text_or_empty(F.col("content")) != "").select(
        "query_id", "rank", F.concat(F.concat_ws(" ", *parts), F.lit("\n"), F.col("content")).alias("line")
    )
    # A line has at least eight characters and two to separate it, so only so many can fit; the
    # rest of a long ranking is pruned before the shuffle.
    lines = first_per_key(lines, ["query_id"], [F.col("rank")], (budget + 2) // 10 + 1)
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("line")).over(running) + 2 * (F.count("*").over(running) - 1)
    fitting = lines.withColumn("used", used).where(F.col("used") <= budget)
    packed = fitting.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]), "\n\n")
        .alias("context"),
        F.count("*").alias("contexts"),
        (F.lit(budget) - F.max("used")).alias("chars_left"),
    )
    every = ranked.select("query_id").distinct()
    return every.join(packed, "query_id", "left").select(
        "query_id", text_or_empty(F.col("context")).alias("context"),
        F.coalesce("contexts", F.lit(0)).alias("contexts"), F.coalesce("chars_left", F.lit(budget)).alias("chars_left"),
    )


def recalled(retrieved_texts: Column, seed_texts: Column) -> Column:
    """Whether a search brought back any of the texts the question was made from."""
    return F.coalesce(F.arrays_overlap(retrieved_texts, seed_texts), F.lit(False))


def retrieved_contexts(hits: DataFrame, contexts: DataFrame, per_task: int = 500) -> DataFrame:
    """``query_id, contexts`` in rank order from ``contexts(chunk_id, ctx)``; ``k`` per query.

    Only the contexts that were hit are read, once each. One that many queries hit is dealt over tasks of about
    ``per_task`` hits, with a copy for each.
    """
    tasks = 4 * hits.sparkSession.sparkContext.defaultParallelism
    hits = settle(hits)
    counted = settle(hits.groupBy("chunk_id").agg(F.ceil(F.count("*") / per_task).cast("int").alias("_parts")))
    shown = contexts.join(counted, "chunk_id", "left_semi").join(counted, "chunk_id")
    copies = settle(shown.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"))
    dealt = hits.join(counted, "chunk_id").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int")).drop("_parts")
    # Spark would put narrow hits into few tasks, which then write the texts of all.
    joined = dealt.repartition(tasks, "chunk_id", "_part").join(copies, ["chunk_id", "_part"])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "ctx")))
    return joined.groupBy("query_id").agg(F.transform(ordered, lambda r: r["ctx"]).alias("contexts"))
