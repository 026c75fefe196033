"""Exact de-duplication in two passes with a Bloom filter.

Pass one sends only hashes, packed and made distinct per batch, to segments of a filter whose bits
count to two: a bit is *repeated* if at least two occurrences set it. Every text that occurs twice has
only repeated bits. Pass two tests each row against the repeated bits, which are broadcast: rows that
cannot have a copy pass straight through; the few others are grouped by their strong digest, so a
false positive costs a little shuffling and never changes the result.

The filter takes ``bits_per_row`` and at most ``max_filter_bytes``. Beyond that more rows are shuffled,
at worst all of them, and the result stays the same.

Texts are equal when their SHA-256 digests after joining white space are. Null is the empty text.
The row with the smallest id stays; a null id counts as larger than any other, and of rows with equal
ids and texts exactly one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.llm import words as W
from tomeworks.llm.columns import sheltered
from tomeworks.operators.sampling import join_counted
from tomeworks.operators.settle import settle

U = np.uint64
PROBES = 4
SEGMENT_ROWS = 250_000


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: str | Column) -> Column:
    return F.sha2(normalised(text), 256)


def _segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> U(40)) * U(segments) >> U(24)).astype(np.int64)


def _bits(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """PROBES bit numbers of each key."""
    first = W.mix(keys)
    step = W.mix(first + U(1)) | U(1)
    turns = np.arange(PROBES, dtype=U)
    return ((first[:, None] + turns * step[:, None]) % U(n_bits)).astype(np.int64)


def counted_bits(hashes: DataFrame, rows: int, times: int, bits_per_row: int = 12, max_filter_bytes: int = 128 << 20) -> tuple[list[np.ndarray], int]:
    """The bits set at least ``times`` (1 or 2) times, in segments, and the bits of each segment;
    ``hashes`` has one 64-bit hash per row."""
    segments = max(1, -(-rows // SEGMENT_ROWS))
    n_bits = int(max(64, min(-(-rows * bits_per_row // segments), max_filter_bytes * 8 // segments)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(W.mix(batch.column(0).to_numpy(zero_copy_only=False).view(U)), return_counts=True)
            cuts = np.searchsorted(_segment_of(keys, segments), np.arange(segments + 1))
            used = np.flatnonzero(cuts[1:] > cuts[:-1])
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array(used, type=pa.int32()),
                "keys": [keys[cuts[s] : cuts[s + 1]].tobytes() for s in used],
                "again": [np.minimum(counts[cuts[s] : cuts[s + 1]], 2).astype(np.uint8).tobytes() for s in used]},
                schema=pa.schema([("segment", pa.int32()), ("keys", pa.binary()), ("again", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        seen = np.zeros(n_bits, dtype=np.uint8)
        for keys, again in zip(table.column("keys").to_pylist(), table.column("again").to_pylist()):
            keys, again = np.frombuffer(keys, dtype=U), np.frombuffer(again, dtype=np.uint8)
            for each in (1, 2):
                at, n = np.unique(_bits(keys[again == each], n_bits), return_counts=True)
                seen[at] = np.minimum(2, seen[at] + np.minimum(n * each, 2))
        return pa.table({"segment": table.column("segment").combine_chunks()[:1], "bits": [np.packbits(seen >= times).tobytes()]})

    made = hashes.mapInArrow(send, "segment int, keys binary, again binary")
    made = {r.segment: r.bits for r in made.groupBy("segment").applyInArrow(count, "segment int, bits binary").collect()}
    empty = np.zeros(-(-n_bits // 8), dtype=np.uint8)
    return [np.frombuffer(made[s], dtype=np.uint8) if s in made else empty for s in range(segments)], n_bits


def possibly_repeated(df: DataFrame, hashed: Column, bits_per_row: int = 12, max_filter_bytes: int = 128 << 20) -> Column:
    """Boolean column: false only where the value of ``hashed`` occurs once in ``df``.

    Runs pass one over ``df`` at once.
    """
    hash64 = F.xxhash64(hashed)
    return _tester(df, counted_bits(df.select(hash64.alias("h")), df.count(), 2, bits_per_row, max_filter_bytes))(hash64)


def member_filter(hashes: DataFrame, rows: int, hash64: Column, bits_per_row: int = 12, max_filter_bytes: int = 128 << 20) -> Column:
    """Boolean column: true wherever ``hash64`` is among the ``rows`` hashes, and seldom elsewhere."""
    return _tester(hashes, counted_bits(hashes, rows, 1, bits_per_row, max_filter_bytes))(hash64)


def member_test(hashes: DataFrame, rows: int, bits_per_row: int = 12, max_filter_bytes: int = 128 << 20):
    """``member_filter`` for use inside another function: called in a task, it gives a function from an
    array of hashes to booleans."""
    return _test(hashes, counted_bits(hashes, rows, 1, bits_per_row, max_filter_bytes))


def _test(df: DataFrame, counted: tuple[list[np.ndarray], int]):
    segments, n_bits = counted
    sent = df.sparkSession.sparkContext.broadcast(segments)

    def start():
        held = np.stack(sent.value)

        def test(array: pa.Array) -> np.ndarray:
            keys = W.mix(array.to_numpy(zero_copy_only=False).view(U))
            bits = _bits(keys, n_bits)
            at = _segment_of(keys, len(held))[:, None]
            return ((held[at, bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=1)

        return test

    return start


def _tester(df: DataFrame, counted: tuple[list[np.ndarray], int]):
    start = _test(df, counted)

    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = start()
        for array in batches:
            yield pa.array(each(array))

    test.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(test, "boolean")


def copy_groups(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` without ``text`` and with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` for
    every row; columns of these names are replaced."""
    df, (text, key), restore = sheltered(df, text, key, replaced=("keep_id", "group_size", "kept", "text_sha256"))
    others = [c for c in df.columns if c not in (text, key)]
    narrow = settle(df.select(key, *others, digest(text).alias("text_sha256")).withColumn("_row", F.monotonically_increasing_id()))
    marked = settle(narrow.withColumn("_maybe", possibly_repeated(narrow, F.col("text_sha256"))))
    alone = marked.where(~F.col("_maybe")).select(
        key, *others, F.col(key).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rest = marked.where("_maybe")
    groups = rest.groupBy("text_sha256").agg(
        F.min(F.struct(F.col(key).isNull(), F.col(key).alias("id"), F.col("_row").alias("row"))).alias("_first"), F.count("*").alias("group_size"))
    joined = join_counted(rest, groups, "text_sha256", "group_size", F.col("_row"))
    return restore(alone.unionByName(joined.select(
        key, *others, F.col("_first.id").alias("keep_id"), "group_size", (F.col("_first.row") == F.col("_row")).alias("kept"), "text_sha256")))


def drop_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with their columns. Rows without a possible copy are not shuffled."""
    df, (text, key), restore = sheltered(df, text, key)
    hashed = digest(text)
    marked = df.withColumn("_sha", hashed).withColumn("_maybe", possibly_repeated(df, hashed))
    others = [c for c in df.columns if c not in (text, key)]
    order = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(*others) if others else F.lit(0))
    best = marked.where("_maybe").groupBy("_sha").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("_best"))
    return restore(marked.where(~F.col("_maybe")).select(df.columns).unionByName(best.select("_best.*")))
