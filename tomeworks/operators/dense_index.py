"""Inverted file over dense vectors: every row in the list of its nearest centroid, searches in the nearest lists.

Centroids are fitted on at most ``sample_rows`` rows, the first in hash order, which the driver holds
(``sample_rows`` x dimensions numbers). On the sample it is measured, too, how many of a query's nearest
lists hold the wished share of its neighbours: so many lists are probed. Every row of the table is assigned, in one map-only pass, and
written in order of its list, so that a reader's filter skips the files of other lists; a list of any
length spans as many files as it takes. A search sends its queries in blocks to the tasks, as the exact search does.
A chunk meets only the queries that probe its list. Which lists a query probes depends on its distances alone.

Approximate: ``recall`` compares with the exact search. With ``probes`` equal to the number of lists
the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.operators.retrieval import BLOCK_BYTES, ranked_blocks
from tomeworks.operators.sampling import take_in_hash_order, with_order
from tomeworks.operators.scoring import CELLS, DenseScorer, Scorer

SAMPLE_ROWS = 20_000
MOST_LISTS = 65_536
#: Rows of the sample that are tried as queries, and neighbours of each.
TRIED, NEIGHBOURS = 500, 4


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def kmeans(rows: np.ndarray, lists: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centroids by cosine; starts are drawn far from each other, empty lists start again at the row
    that fits its own list worst."""
    draw = np.random.default_rng(seed)
    rows = _unit(rows.astype(np.float64))
    lists = min(lists, len(rows))
    chosen = [int(draw.integers(len(rows)))]
    away = 1.0 - rows @ rows[chosen[0]]
    for _ in range(lists - 1):
        away = np.maximum(away, 0.0)
        chosen.append(int(draw.choice(len(rows), p=away / away.sum())) if away.sum() > 0 else int(draw.integers(len(rows))))
        away = np.minimum(away, 1.0 - rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        like = rows @ centres.T
        own = like.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = rows[np.argsort(like.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


@dataclass(frozen=True)
class Centroids:
    centres: np.ndarray
    probes: int  # nearest lists that hold the wished share of neighbours


def probes_for(rows: np.ndarray, centres: np.ndarray, target: float) -> int:
    """The least number of nearest lists that holds the share ``target`` of the nearest neighbours of the
    first rows, among ``rows``."""
    rows = _unit(rows.astype(np.float64))
    tried = rows[:TRIED]
    like = tried @ rows.T
    like[np.arange(len(tried)), np.arange(len(tried))] = -np.inf  # a row is no neighbour of itself
    n = min(NEIGHBOURS, len(rows) - 1)
    if n < 1:
        return len(centres)
    near = np.argpartition(-like, n - 1, axis=1)[:, :n]
    lists = (rows @ centres.T).argmax(axis=1)[near]
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, lists, axis=1) + 1, target, method="higher"))


def fit_centroids(chunks: DataFrame, lists: int | None = None, vector: str = "dense_vector", sample_rows: int = SAMPLE_ROWS, target: float = 0.95,
                  seed: int = 42) -> Centroids:
    """Centroids for ``lists`` lists, about the square root of the rows unless given, and how many to probe
    for a recall of about ``target``."""
    held = chunks.where(F.col(vector).isNotNull()).select(F.col("chunk_id"), F.col(vector).alias("vector"))
    if lists is None:
        lists = int(min(MOST_LISTS, max(1, round(held.count() ** 0.5))))
    sample = take_in_hash_order(with_order(held, seed, "centroids", F.col("chunk_id")), sample_rows, "ord").orderBy("rank").select("vector").toArrow()
    if not sample.num_rows:
        return Centroids(np.zeros((0, 0)), 0)
    rows = np.stack(sample.column(0).to_numpy())
    centres = kmeans(rows, lists, seed=seed)
    return Centroids(centres, probes_for(rows, centres, target))


def _nearest(centroids: np.ndarray, n: int, vector: Column) -> Column:
    """The ``n`` nearest lists of a vector column, nearest first."""
    n = min(n, len(centroids))

    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = max(1, CELLS // len(centroids))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch[lo:lo + step]
                like = np.round(_unit(np.stack(part.to_numpy(zero_copy_only=False)).astype(np.float64)) @ centroids.T, 9)
                best = np.argsort(-like, axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), pa.array(best.ravel()))

    nearest.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(nearest, "array<int>")(vector)


def build_dense_index(chunks: DataFrame, centroids: Centroids, vector: str = "dense_vector") -> DataFrame:
    """``list, chunk_id, vector`` of every chunk that has a vector."""
    held = chunks.where(F.col(vector).isNotNull()).select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col(vector).alias("vector"))
    if not len(centroids.centres):
        return held.select(F.lit(0).alias("list"), "chunk_id", "vector")
    return held.select(_nearest(centroids.centres, 1, F.col("vector"))[0].alias("list"), "chunk_id", "vector")


def write_dense_index(index: DataFrame, path: str) -> None:
    index.repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id").write.parquet(path)


def read_dense_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass
class ProbedScorer(Scorer):
    """Scores of chunks for the queries that probe their list; minus infinity for the others."""

    exact: DenseScorer
    ids: np.ndarray
    probing: dict[int, np.ndarray]

    @classmethod
    def of(cls, queries: pd.DataFrame, metric: str) -> ProbedScorer | None:
        if queries.empty:
            return None
        lists: dict[int, list[int]] = {}
        for q, own in enumerate(queries["lists"]):
            for number in own:
                lists.setdefault(int(number), []).append(q)
        return cls(DenseScorer(queries["vector"].tolist(), metric), queries["query_id"].to_numpy(), {k: np.array(v) for k, v in lists.items()})

    @staticmethod
    def usable(frame: pd.DataFrame) -> pd.DataFrame:
        return frame

    def encode(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return frame["list"].to_numpy(), self.exact.encode(frame)

    def score(self, encoded: tuple[np.ndarray, np.ndarray], some: slice) -> np.ndarray:
        numbers, vectors = encoded
        out = np.full((len(numbers), some.stop - some.start), -np.inf)
        for number in np.unique(numbers):
            asked = self.probing.get(int(number))
            if asked is not None:
                asked = asked[slice(*np.searchsorted(asked, [some.start, some.stop]))]
                rows = np.flatnonzero(numbers == number)
                out[np.ix_(rows, asked - some.start)] = self.exact.score(vectors[rows], asked)
        return out


def search_dense_index(queries: DataFrame, index: DataFrame, centroids: Centroids, k: int = 4, probes: int | None = None, vector: str = "dense_vector",
                       metric: str = "COSINE", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the best ``k`` chunks in the ``probes`` nearest lists of each query,
    those that the sample asks for unless given."""
    probes = centroids.probes if probes is None else probes
    asked = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("bigint").alias("query_id"), F.col(vector).alias("vector"))
    lists = _nearest(centroids.centres, probes, F.col("vector")) if len(centroids.centres) else F.array(F.lit(0))

    def wanted(block: pa.Table) -> Column:
        """A filter for the scan: the lists that a block of queries probes."""
        return F.col("list").isin(sorted({int(x) for own in block.column("lists").to_pylist() for x in own}))

    return ranked_blocks(asked.withColumn("lists", lists), index, {"dense": lambda f: ProbedScorer.of(f, metric)},
                         8 * F.array_size("vector") + 8 * F.lit(probes), k, block_bytes, wanted).drop("kind")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the exact hits, and the share of them that was found."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_found")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("exact_hits"), F.coalesce(F.sum("_found") / F.count("*"), F.lit(1.0)).alias("recall"))
