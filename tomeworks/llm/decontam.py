"""Benchmark decontamination by winnowing.

Texts are lower-cased word sequences. A window is ``span`` consecutive words of an item; an item of
fewer words, but not none, is one window. Document words inside an occurrence of a window are hit.

Both sides keep fingerprints only: of every ``span - k + 1`` consecutive k-gram hashes the smallest
one, the rightmost of equal ones. A window chooses by its own words alone, so wherever a document
repeats a window it keeps the same fingerprint at the same place, and no occurrence is missed. Document
and item fingerprints are joined, and every hit is extended along its diagonal, the alignment of item
and document, to the maximal runs of equal words; runs of ``span`` words or more are hits.

The item side is broadcast in blocks of at most ``block_words`` words, counted beforehand; further
blocks are further map-only passes over the documents. Items of fewer than ``span`` words are compared
by the hash of all their words with the document windows of that length.

Edge cases: null or wordless documents and items have no words and no hits. Repeated item ids count
once. An item without id is searched for like any other; only the list of items lacks it. Documents are handled row by row, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.llm import words as W
from tomeworks.operators.settle import settle

U = np.uint64
PAIRS_AT_ONCE = 200_000
RUN_BYTES = 512 << 10


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    out = words[: max(len(words) - n + 1, 0)]
    for i in range(1, n):
        out = W.chain(out, words[i : i + len(out)])
    return out


def winnow(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` grams, the place and value of its smallest, rightmost gram."""
    n = max(len(grams) - width + 1, 0)
    least, at = grams[:n].copy(), np.arange(n)
    for i in range(1, width):
        right = grams[i : i + n]
        smaller = right <= least
        least[smaller] = right[smaller]
        at[smaller] = np.flatnonzero(smaller) + i
    return at, least


def whole(rows: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words lie in one row."""
    return rows[: max(len(rows) - n + 1, 0)] == rows[n - 1 :] if len(rows) >= n else np.zeros(0, dtype=bool)


@dataclass
class Items:
    """One block of the benchmark, ready for look-ups."""

    ids: list[str | None]
    words: np.ndarray
    starts: np.ndarray  # first word of each item, and the end
    table: W.HashTable
    first: np.ndarray  # for each fingerprint its entries in ``places``
    places: np.ndarray  # word numbers
    owners: np.ndarray
    short: dict[int, tuple[W.HashTable, list[list[int]]]]


def index_items(ids: list[str | None], texts: pa.Array, span: int, k: int) -> Items:
    parts, rows = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)]
    for row, offsets, data in W.runs(texts):
        hashes, at = W.word_hashes(offsets, data, W.ALNUM)
        parts.append(hashes)
        rows.append(at + row)
    words, rows = np.concatenate(parts), np.concatenate(rows)
    counts = W.row_counts(rows, len(ids))
    starts = np.concatenate([[0], np.cumsum(counts)])
    grams = gram_hashes(words, k)
    at, _ = winnow(grams, span - k + 1)
    at = np.unique(at[whole(rows, span)])
    order = np.argsort(grams[at], kind="stable")
    keys, first = np.unique(grams[at][order], return_index=True)
    short: dict[int, tuple[W.HashTable, list[list[int]]]] = {}
    for n in sorted({int(c) for c in counts if 0 < c < span}):
        owners: dict[int, list[int]] = {}
        for i in np.flatnonzero(counts == n).tolist():
            owners.setdefault(int(gram_hashes(words[starts[i] : starts[i + 1]], n)[0]), []).append(i)
        short[n] = W.HashTable(np.array(list(owners), dtype=U)), list(owners.values())
    return Items(ids, words, starts, W.HashTable(keys), np.append(first, len(order)), at[order], rows[at[order]], short)


def find_hits(items: Items, words: np.ndarray, rows: np.ndarray, span: int, k: int) -> tuple[np.ndarray, set[tuple[int, int]]]:
    """Which words are hit, and the pairs (row, item) with hits."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    pairs: set[tuple[int, int]] = set()
    for n, (table, owners) in items.short.items():
        inside = whole(rows, n)
        found = table.find(gram_hashes(words, n))
        at = np.flatnonzero(inside & (found >= 0))
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        for row, entry in set(zip(rows[at].tolist(), found[at].tolist())):
            pairs.update((row, i) for i in owners[entry])
    grams = gram_hashes(words, k)
    at, _ = winnow(grams, span - k + 1)
    at = np.unique(at[whole(rows, span)])
    found = items.table.find(grams[at])
    at, found = at[found >= 0], found[found >= 0]
    counts = items.first[found + 1] - items.first[found]
    sums = np.cumsum(counts)
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + PAIRS_AT_ONCE, side="right")))
        _extend(items, words, rows, at[low:high], found[low:high], counts[low:high], span, change, pairs)
        low = high
    return np.cumsum(change[:-1]) > 0, pairs


def _extend(items: Items, words: np.ndarray, rows: np.ndarray, at: np.ndarray, found: np.ndarray, counts: np.ndarray, span: int,
            change: np.ndarray, pairs: set[tuple[int, int]]) -> None:
    """Mark the runs of at least ``span`` equal words on the diagonals of the given hits."""
    entry = np.repeat(items.first[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    here = np.repeat(at, counts)
    owner = items.owners[entry]
    begin = here - (items.places[entry] - items.starts[owner])  # where the item's first word would be
    diagonals = np.unique(np.stack([rows[here], owner, begin], axis=1), axis=0)
    row, owner, begin = diagonals.T
    lengths = items.starts[owner + 1] - items.starts[owner]
    edges = np.concatenate([[0], np.cumsum(lengths)])
    within = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
    place = np.repeat(begin, lengths) + within
    valid = (place >= 0) & (place < len(words))
    safe = np.clip(place, 0, max(len(words) - 1, 0))
    same = valid & (rows[safe] == np.repeat(row, lengths)) & (words[safe] == items.words[np.repeat(items.starts[owner], lengths) + within])
    # runs of equal words that do not cross from one diagonal to the next
    ahead = np.concatenate([[False], same[:-1]])
    ahead[edges[:-1]] = False
    then = np.concatenate([same[1:], [False]])
    then[edges[1:] - 1] = False
    starts, ends = np.flatnonzero(same & ~ahead), np.flatnonzero(same & ~then) + 1
    long = ends - starts >= span
    starts, ends = starts[long], ends[long]
    np.add.at(change, place[starts], 1)
    np.add.at(change, place[ends - 1] + 1, -1)
    which = np.searchsorted(edges, starts, side="right") - 1
    pairs.update(zip(row[which].tolist(), owner[which].tolist()))


_RESULT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _search(items: Items, array: pa.Array, span: int, k: int) -> pa.Array:
    out: list[dict] = []
    for _, offsets, data in W.runs(array, RUN_BYTES):
        words, rows = W.word_hashes(offsets, data, W.ALNUM)
        n = len(offsets) - 1
        counts = W.row_counts(rows, n)
        hit, pairs = find_hits(items, words, rows, span, k)
        owners: dict[int, set[str]] = {}
        for row, item in pairs:
            named = owners.setdefault(row, set())
            if items.ids[item] is not None:
                named.add(items.ids[item])
        starts = np.concatenate([[0], np.cumsum(counts)])
        out += [{"n_words": c, "spans": _spans(hit[starts[i] : starts[i + 1]]) if i in owners else [], "items": sorted(owners.get(i, ()))}
                for i, c in enumerate(counts.tolist())]
    return pa.array(out, type=_RESULT)


def _searcher(sent, span: int, k: int):
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield _search(sent.value, array, span, k)
        W.release()

    search.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(search, "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", *, item: str = "item_id", item_text: str = "text", span: int = 13, k: int = 5,
    block_words: int = 2_000_000,
) -> DataFrame:
    """``df`` with ``n_words``, ``n_hit``, ``spans`` (word numbers, end exclusive) and ``items`` (ids as
    sorted strings) for every row; columns of these names are replaced."""
    spark = df.sparkSession
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (2 * block_words)))  # a word and its separator take two bytes at least
    added = ["n_words", "n_hit", "spans", "items"]
    out = df.select([c for c in df.columns if c not in added])
    kept = out.columns
    for block in range(blocks):
        mine = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        order = pa.compute.sort_indices(mine, sort_keys=[("item", "ascending"), ("text", "ascending")])
        mine = mine.take(order)
        sent = spark.sparkContext.broadcast(index_items(mine.column("item").to_pylist(), mine.column("text").combine_chunks(), span, k))

        found = _searcher(sent, span, k)(text)
        if block:
            out = out.withColumn("_new", found).select(
                *kept, F.struct(F.col("_found.n_words"), F.concat("_found.spans", "_new.spans").alias("spans"),
                                F.array_union("_found.items", "_new.items").alias("items")).alias("_found"))
        else:
            out = out.select(*kept, found.alias("_found"))
        if block < blocks - 1:
            out = settle(out)
    # spans of several blocks may overlap: count the words of their union
    ordered = F.array_sort("_found.spans")
    union = F.aggregate(ordered, F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
                        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"),
                                              (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n")))
    return out.select(*kept, F.col("_found.n_words").alias("n_words"), union["n"].alias("n_hit"), ordered.alias("spans"),
                      F.array_sort("_found.items").alias("items"))


def contaminated(least_share: int = 20):
    """The column of the rule: hit words make up at least one in ``least_share`` words."""
    return (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))
