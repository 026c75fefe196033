"""Inverted index over sparse vectors, searched range by range under upper bounds.

Chunks are cut into ranges: first by level, the logarithm of their total weight, so that a range holds
chunks of like size; a level of many chunks is cut by hash into parts of about ``range_rows``, or fewer where
that would be more than ``RANGE_POSTINGS`` postings. A posting block is one token in one range: chunk ids,
weights, and the least and largest weight. No block is longer than a range, however frequent its token, and no
key of the build or the search holds more than that. The build shuffles whole vectors to their range once; the
blocks are made there.

A search reads block heads first. The sum over a query's tokens of the most a block can add bounds every score in
a range; the same sum per level bounds all its ranges. Only heads and blocks of the queries' tokens are used, and
of blocks only those in ranges that are scored. The ranges of the highest bounds are scored exactly,
the k-th score found is the threshold, and only ranges whose bound reaches it are scored after that. Exact,
with ties by chunk id, for weights of any sign; a token of weight 0 is as good as absent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.operators.sampling import first_per_key
from tomeworks.operators.settle import settle

#: Levels double the total weight every so many steps.
STEPS = 4
RANGE = ["level", "part"]
#: Postings of a range, which one call of Python holds.
RANGE_POSTINGS = 2_000_000
DIGITS = 6


def _range_blocks(table: pa.Table) -> pa.Table:
    """The posting blocks of one range by token, each by chunk id."""
    table = table.combine_chunks()
    sizes = pc.list_value_length(table["tokens"]).to_numpy()
    tokens, weights = pc.list_flatten(table["tokens"]).to_numpy(), pc.list_flatten(table["weights"])
    held = pc.fill_null(pc.not_equal(weights, 0.0), False).to_numpy()
    owner, tokens, weights = np.repeat(np.arange(len(sizes)), sizes)[held], tokens[held], weights.to_numpy()[held]
    order = np.lexsort((pc.fill_null(table["chunk_id"], 0).to_numpy()[owner], tokens))
    owner, tokens, weights = owner[order], tokens[order], weights[order]
    first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] - 1))
    edges = pa.array(np.append(first, len(tokens)), type=pa.int32())
    chunk_ids = table["chunk_id"].combine_chunks().take(pa.array(owner))
    return pa.table({
        **{name: pa.repeat(table[name][0], len(first)) for name in RANGE}, "token": tokens[first],
        "top": np.maximum.reduceat(weights, first) if len(first) else weights, "low": np.minimum.reduceat(weights, first) if len(first) else weights,
        "postings": np.diff(edges.to_numpy()).astype(np.int64),
        "chunk_ids": pa.ListArray.from_arrays(edges, chunk_ids), "weights": pa.ListArray.from_arrays(edges, pa.array(weights))})


def build_sparse_index(chunks: DataFrame, vector: str = "sparse_vector", range_rows: int = 4096) -> DataFrame:
    """Posting blocks ``level, part, token, top, low, postings, chunk_ids, weights`` of
    ``chunks(chunk_id, vector)``, those of a range together and by token; chunks without tokens are in no block."""
    total = F.aggregate(F.map_values(vector), F.lit(0.0), lambda a, w: a + F.abs(w.cast("double")))
    held = chunks.where(F.size(vector) > 0).select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col(vector).alias("v"), total.alias("_total"))
    level = F.when(F.col("_total") > 0, F.floor(STEPS * F.log2("_total"))).otherwise(-(1 << 20)).cast("int")
    held = settle(held.select("chunk_id", F.map_keys("v").alias("tokens"), F.map_values("v").cast("array<double>").alias("weights"), level.alias("level")))
    # levels of doubles: a few thousand at most, whatever the chunks
    wanted = F.ceil(F.greatest(F.count("*") / range_rows, F.sum(F.size("tokens")) / RANGE_POSTINGS))
    parts = held.groupBy("level").agg(wanted.cast("int").alias("_parts"))
    placed = held.join(F.broadcast(parts), "level").select(
        "level", F.pmod(F.xxhash64("chunk_id"), F.col("_parts")).cast("int").alias("part"), "chunk_id", "tokens", "weights")
    token = held.schema["tokens"].dataType.elementType.simpleString()
    return placed.groupBy(*RANGE).applyInArrow(
        _range_blocks, f"level int, part int, token {token}, top double, low double, postings bigint, chunk_ids array<bigint>, weights array<double>")


def write_sparse_index(index: DataFrame, path: str) -> None:
    """Blocks as they are built, a range's together and by token, so that a reader's filters skip row groups."""
    index.write.parquet(path)


def read_sparse_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class IndexHits:
    hits: DataFrame  # query_id, chunk_id, score, rank
    reads: DataFrame  # query_id, postings of its tokens, and how many of them were read


def _most(query_weight: str = "qw") -> Column:
    """The most that a block can add to the score of any chunk of its range."""
    return F.greatest(F.col(query_weight) * F.col("top"), F.col(query_weight) * F.col("low"), F.lit(0.0))


def search_sparse_index(queries: DataFrame, index: DataFrame, k: int = 4, vector: str = "sparse_vector", probes: int = 4) -> IndexHits:
    """Inner-product top ``k`` of every query; only chunks sharing a token. ``probes`` ranges of each query
    are scored to find its threshold."""
    asked = settle(queries.where(F.size(vector) > 0).select(F.col("query_id").cast("bigint").alias("query_id"), F.explode(vector).alias("token", "qw")).withColumn(
        "qw", F.col("qw").cast("double")).where("qw <> 0"))
    tokens = asked.select("token").distinct()
    heads = settle(index.select(*RANGE, "token", "top", "low", "postings").join(tokens, "token", "left_semi"))
    by_level = heads.groupBy("level", "token").agg(F.max("top").alias("top"), F.min("low").alias("low"))
    levels = settle(asked.join(by_level, "token").groupBy("query_id", "level").agg(F.sum(_most()).alias("bound")))

    def bounds(of: DataFrame) -> DataFrame:
        """``query_id, level, part, bound`` for the levels ``of`` each query."""
        # levels do not grow with the chunks: settled, this is the side that Spark sees to be small
        wanted = settle(asked.join(of.select("query_id", "level"), "query_id"))
        return heads.join(wanted, ["level", "token"]).groupBy("query_id", *RANGE).agg(F.sum(_most()).alias("bound"))

    def scores(of: DataFrame) -> DataFrame:
        # settled, so that its size is known and no more of the index is moved than what is scored
        wanted = settle(of.select("query_id", *RANGE).join(asked, "query_id"))
        ranges = wanted.select(*RANGE).distinct()
        blocks = index.select(*RANGE, "token", "chunk_ids", "weights").join(tokens, "token", "left_semi").join(ranges, RANGE, "left_semi")
        found = wanted.join(blocks, [*RANGE, "token"]).select("query_id", "qw", F.explode(F.arrays_zip("chunk_ids", "weights")).alias("p"))
        return found.groupBy("query_id", F.col("p.chunk_ids").alias("chunk_id")).agg(F.round(F.sum(F.col("qw") * F.col("p.weights")), DIGITS).alias("score"))

    best_levels = first_per_key(levels, ["query_id"], [F.desc("bound"), F.desc("level")], probes)
    first = settle(first_per_key(bounds(best_levels), ["query_id"], [F.desc("bound"), F.desc("level"), F.asc("part")], probes).drop("_rank"))
    order = [F.desc("score"), F.asc("chunk_id")]
    early = settle(first_per_key(scores(first), ["query_id"], order, k))
    # a k-th score that is there; a query with fewer has no threshold yet
    threshold = early.where(F.col("_rank") == k).select("query_id", F.col("score").alias("least"))
    reaches = F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS)
    open_levels = levels.join(threshold, "query_id", "left").where(reaches)
    rest = settle(bounds(open_levels).join(threshold, "query_id", "left").where(reaches).join(first, ["query_id", *RANGE], "left_anti").select("query_id", *RANGE))
    hits = first_per_key(early.drop("_rank").unionByName(scores(rest)), ["query_id"], order, k, rank="rank")
    read = first.select("query_id", *RANGE).unionByName(rest).join(asked, "query_id").join(heads, [*RANGE, "token"]).groupBy("query_id").agg(F.sum("postings").alias("read"))
    reads = asked.join(heads, "token").groupBy("query_id").agg(F.sum("postings").alias("postings")).join(read, "query_id")
    return IndexHits(hits.select("query_id", "chunk_id", "score", "rank"), reads)
