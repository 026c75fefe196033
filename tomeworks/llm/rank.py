"""Ranked lexical search: the best documents of each query, by range-maximum tables over posting lists.

Score of a document for a query, in whole numbers (``div`` rounds down): each query term, repeats included,
adds ``w * ((10^9 * tf) div (1000 * tf + 8 * m))`` with ``m = 100 - 75 + ((75 * n * N) div L)`` and
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``. N counts the documents with a term, L all their terms,
n those of one document, df the documents that hold a term, tf its occurrences in one.

Queries are taken in blocks of about ``block_bytes`` of text, each two passes:

1. Each task cuts its documents into segments and keeps per segment the postings of the block's terms;
   N, L and df come from an aggregate over the segments. No text and no posting is shuffled.
2. Per segment the posting lists lie one after another, ordered by document, with a sparse table: entry
   (j, i) is the largest impact, and the first document that has it, among 2^j postings from i on, so the
   maximum of any range of a list takes two look-ups. A query starts with the interval of all documents.
   The sum of its terms' range maxima bounds every score inside an interval. Intervals are taken best
   first: the document of the term that adds most to the bound gets its exact score, and the documents
   before and after it are new intervals. An interval ends when its bound cannot enter the best ``k``. Some
   intervals are taken at once, so that numpy works on whole arrays.

A task carries the best ``k`` of each query from segment to segment and hands on only those at its end; they
are merged by query, k rows a task. Exact: nothing is sampled, and ties go to the smaller id.

Edge cases: null texts have no terms. Ids must be whole numbers; a null id counts as larger than any other.
Repeated rows are documents of their own, as are repeated queries. Queries without terms, or whose terms
no document holds, return no row; so does an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.llm import words as W
from tomeworks.operators.sampling import first_per_key
from tomeworks.operators.settle import settle

#: Postings in a segment, about: its tables take 8 bytes a posting and level, at most some 80 MB.
SEGMENT_POSTINGS = 1 << 19
#: Bytes of documents' texts of a batch that are looked at together.
RUN_BYTES = 1 << 20
#: Intervals taken at once: at first, and at most.
FIRST_WAVE, LAST_WAVE = 16, 512
_NO_ID = (1 << 63) - 1
_LOW = (1 << 32) - 1

SEGMENT = ("docs bigint, words bigint, ids binary, lengths binary, sizes binary, terms binary, tfs binary, "
           "df_terms array<int>, df_counts array<int>")
SEGMENT_SCHEMA = pa.schema([
    ("docs", pa.int64()), ("words", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("sizes", pa.binary()),
    ("terms", pa.binary()), ("tfs", pa.binary()), ("df_terms", pa.list_(pa.int32())), ("df_counts", pa.list_(pa.int32()))])
HITS = "query bigint, id bigint, score bigint"


@dataclass
class Block:
    """Queries of one block: their numbers, and places in ``terms`` with counts."""

    terms: W.HashTable
    queries: list[tuple[int, np.ndarray, np.ndarray]]


def make_block(numbers: list[int], texts: pa.Array) -> Block:
    offsets, data = W.texts(texts)
    hashes, rows = W.word_hashes(offsets - offsets[0], data[offsets[0] : offsets[-1]], W.ALNUM)
    terms = np.unique(hashes)
    at = np.searchsorted(terms, hashes)
    cuts = np.searchsorted(rows, np.arange(len(numbers) + 1))
    queries = []
    for number, a, b in zip(numbers, cuts[:-1], cuts[1:]):
        if a < b:
            queries.append((number, *np.unique(at[a:b], return_counts=True)))
    return Block(W.HashTable(terms), queries)


def _segments(batches: Iterator[pa.RecordBatch], terms: W.HashTable) -> Iterator[pa.RecordBatch]:
    """Postings of ``terms`` in batches of ``id, text``; documents without any only count."""
    n_terms = max(len(terms.keys), 1)
    held: list[tuple[np.ndarray, ...]] = []
    docs = words = size = 0

    def send() -> Iterator[pa.RecordBatch]:
        ids, lengths, sizes, at, tfs = (np.concatenate(c) if held else np.zeros(0, dtype=np.int64) for c in (zip(*held) if held else [()] * 5))
        df = np.bincount(at, minlength=0)
        used = np.flatnonzero(df)
        row = {"docs": [docs], "words": [words], "ids": [ids.tobytes()], "lengths": [lengths.tobytes()], "sizes": [sizes.astype(np.int32).tobytes()],
               "terms": [at.astype(np.int32).tobytes()], "tfs": [tfs.astype(np.int32).tobytes()], "df_terms": [used.astype(np.int32)],
               "df_counts": [df[used].astype(np.int32)]}
        yield pa.RecordBatch.from_pydict(row, schema=SEGMENT_SCHEMA)

    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        for first, offsets, data in W.runs(batch.column(1), RUN_BYTES):
            n = len(offsets) - 1
            hashes, rows = W.word_hashes(offsets, data, W.ALNUM)
            lengths = W.row_counts(rows, n)
            docs, words = docs + int((lengths > 0).sum()), words + len(rows)
            at = terms.find(hashes)
            hit = at >= 0
            pairs, tfs = np.unique(rows[hit] * n_terms + at[hit], return_counts=True)
            sizes = W.row_counts(pairs // n_terms, n)
            some = np.flatnonzero(sizes)
            held.append((numbers[first : first + n][some], lengths[some], sizes[some], pairs % n_terms, tfs))
            size += len(pairs)
            if size >= SEGMENT_POSTINGS:
                yield from send()
                held, docs, words, size = [], 0, 0, 0
    if docs:
        yield from send()
    W.release()


@dataclass
class Corpus:
    """Counts over all documents: N, L, and the weight of each term of a block."""

    docs: int
    words: int
    weights: np.ndarray


class Segment:
    """Posting lists of some documents with a sparse table of maxima."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, corpus: Corpus) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[order], len(ids)
        place = np.empty(self.n, dtype=np.int64)
        place[order] = np.arange(self.n)
        m = 25 + (75 * lengths * corpus.docs) // corpus.words
        doc, tf = np.repeat(place, sizes), tfs.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
        key = terms.astype(np.int64) * self.n + doc
        order = np.argsort(key)
        self.key, self.impact = key[order], impact[order]
        self.starts = np.searchsorted(self.key, np.arange(len(corpus.weights) + 1) * self.n)
        longest = int(np.diff(self.starts).max(initial=1))
        # the largest impact, and of equal ones the first document
        packed = (self.impact << 32) | (self.n - 1 - doc[order])
        levels = [packed]
        for j in range(longest.bit_length() - 1):
            wider = levels[-1].copy()
            wider[: -(1 << j)] = np.maximum(levels[-1][: -(1 << j)], levels[-1][1 << j :])
            levels.append(wider)
        self.table, self.width = np.concatenate(levels), len(packed)
        self.log = np.frexp(np.arange(longest + 1))[1] - 1

    def maxima(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Packed maximum of each range of postings, 0 for an empty one; two look-ups each."""
        size = end - first
        some = size > 0
        level = self.log[np.where(some, size, 1)]
        row = level * self.width
        left = np.where(some, row + first, 0)
        right = np.where(some, row + end - (1 << level), 0)
        return np.where(some, np.maximum(self.table[left], self.table[right]), 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of this segment and those found before (``scores``, ``ids``, best first)."""
        used = self.starts[terms + 1] > self.starts[terms]
        terms, weights = terms[used], weights[used]
        if not len(terms):
            return scores, ids
        lists = terms * self.n
        first, end = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        low = np.zeros(1, dtype=np.int64)
        top = self.maxima(first, end)
        wave = FIRST_WAVE
        while True:
            adds = (top >> 32) * weights
            bound = adds.sum(axis=1)
            alive = bound > 0
            if len(scores) == k:
                # of equal scores the smaller id wins; those of an interval are not below its first
                alive &= (bound > scores[-1]) | ((bound == scores[-1]) & (self.ids[np.minimum(low, self.n - 1)] < ids[-1]))
            if not alive.all():
                first, end, low, top, adds, bound = (x[alive] for x in (first, end, low, top, adds, bound))
            if not len(low):
                return scores, ids
            if len(low) > wave:
                taken = np.zeros(len(low), dtype=bool)
                taken[np.argpartition(bound, len(low) - wave)[len(low) - wave :]] = True
            else:
                taken = np.ones(len(low), dtype=bool)
            wave = min(2 * wave, LAST_WAVE)
            a, b = first[taken], end[taken]
            chosen = top[taken][np.arange(len(a)), adds[taken].argmax(axis=1)]
            doc = self.n - 1 - (chosen & _LOW)
            wanted = lists[None, :] + doc[:, None]
            at = np.searchsorted(self.key, wanted.ravel()).reshape(wanted.shape)
            held = (at < b) & (self.key[np.minimum(at, self.width - 1)] == wanted)
            exact = np.where(held, self.impact[np.minimum(at, self.width - 1)], 0) @ weights
            all_scores, all_ids = np.concatenate([scores, exact]), np.concatenate([ids, self.ids[doc]])
            order = np.lexsort((all_ids, -all_scores))[:k]
            scores, ids = all_scores[order], all_ids[order]
            positive = scores > 0
            scores, ids = scores[positive], ids[positive]
            new_first, new_end = np.concatenate([a, at + held]), np.concatenate([at, b])
            rest = ~taken
            first, end = np.concatenate([first[rest], new_first]), np.concatenate([end[rest], new_end])
            low = np.concatenate([low[rest], low[taken], doc + 1])
            top = np.concatenate([top[rest], self.maxima(new_first, new_end)])


def _hits(batches: Iterator[pa.RecordBatch], block: Block, corpus: Corpus, k: int) -> Iterator[pa.RecordBatch]:
    best = {}
    none = np.zeros(0, dtype=np.int64)
    weighted = [(number, at, corpus.weights[at] * times) for number, at, times in block.queries]
    for batch in batches:
        for row in range(batch.num_rows):
            ids, lengths, sizes, terms, tfs = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=kind) for c, kind in enumerate(
                (np.int64, np.int64, np.int32, np.int32, np.int32)))
            if not len(ids):
                continue
            segment = Segment(ids, lengths, sizes, terms, tfs, corpus)
            for number, at, weights in weighted:
                best[number] = segment.search(at, weights, k, *best.get(number, (none, none)))
            del segment
    found = [(np.full(len(s), number), ids, s) for number, (s, ids) in best.items() if len(s)]
    columns = [np.concatenate(c) for c in zip(*found)] if found else [none] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["query", "id", "score"])
    W.release()


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(block.terms)
    segments = settle(docs.mapInArrow(lambda batches: _segments(batches, terms.value), SEGMENT))
    total = segments.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    if not total.docs:
        return None
    counted = segments.select(F.explode(F.arrays_zip("df_terms", "df_counts")).alias("e")).groupBy(F.col("e.df_terms").alias("term")).agg(
        F.sum("e.df_counts").alias("df"))
    weights = np.zeros(len(block.terms.keys), dtype=np.int64)
    for r in counted.collect():  # at most the block's terms
        weights[r.term] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r.df + 1)))
    sent = spark.sparkContext.broadcast((block, Corpus(total.docs, total.words, weights)))
    return segments.select("ids", "lengths", "sizes", "terms", "tfs").mapInArrow(lambda batches: _hits(batches, *sent.value, k), HITS)


def search(
    docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", query_key: str = "item_id", query_text: str = "text", *,
    k: int = 10, block_bytes: int = 4 << 20,
) -> DataFrame:
    """``query_key, rank, key, score`` of the ``k`` best documents of each row of ``queries``, ranks from 1."""
    spark = docs.sparkSession
    asked = settle(queries.select(F.col(query_key).alias("item"), F.coalesce(F.col(query_text), F.lit("")).alias("text")).withColumn(
        "query", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    read = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hits = None
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).select("query", "text").toArrow()
        if own.num_rows:
            found = _search_block(read, make_block(own.column(0).to_pylist(), own.column(1).combine_chunks()), k)
            if found is not None:
                found = found if blocks == 1 else settle(found)
                hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], HITS)
    ranked = first_per_key(hits, ["query"], [F.desc("score"), F.col("id")], k, "rank")
    return ranked.join(asked.select("query", "item"), "query").select(
        F.col("item").alias(query_key), F.col("rank").cast("int").alias("rank"), F.nullif(F.col("id"), F.lit(_NO_ID)).alias(key), "score")
