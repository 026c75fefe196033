"""Packing documents into sequences of at most ``capacity`` tokens.

A document is its token ids and an end id. Longer ones are cut into pieces of ``capacity`` tokens, only
the first of which may be shorter. Full pieces are sequences of their own. For the others the histogram
of lengths, at most ``capacity`` numbers whatever the data, goes to the driver, where the configuration
linear program is solved: a configuration is a multiset of lengths that fits into one sequence, and as
few sequences as possible must cover the histogram. Multiplicative weights give each length a price
that falls as the length is covered; a knapsack dynamic program finds the configurations of the highest
price; each is used for a part of what its scarcest length still lacks. The fractional solution is rounded
up within what is left, and what rounding leaves is packed best fit, longest first.

The plan says which ranks of each length go to which sequences, so the pieces only need their rank among
those of equal length. Ranks come from counts per (length, bucket) and a row number inside the bucket, so
no length is gathered in one task however frequent it is.

Edge cases: null is the empty text, one piece of the end id alone. Rows are packed as they are, repeated
ones too. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeworks.llm import words as W
from tomeworks.llm.columns import sheltered
from tomeworks.llm.tokens import Encoder, grouped
from tomeworks.operators.settle import settle

BUCKET_ROWS = 50_000
#: Texts in one Arrow batch, and bytes of texts that are encoded together.
TEXT_BATCH, RUN_BYTES = 500, 1 << 20

_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def pieces(df: DataFrame, path: str, text: str = "text", *, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """``df`` without ``text`` and with one row per piece: ``piece``, ``start``, ``length``, ``ids_crc32``
    and, if asked for, ``ids`` (unsigned 32-bit, little-endian)."""

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for column in batches:
            sizes: list[int] = []
            piece, start, length, crc, raw = [], [], [], [], []
            for texts in grouped(column, RUN_BYTES):
                counts, ids = encoder.encode(texts)
                counts = counts + 1
                ends = np.cumsum(counts)
                flat = np.insert(ids, ends - np.arange(1, len(counts) + 1), end_id).astype("<u4").tobytes()
                at = 0
                for n in counts.tolist():
                    first = n % capacity or min(n, capacity)
                    cuts = [0, *range(first, n + 1, capacity)]
                    sizes.append(len(cuts) - 1)
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = flat[4 * (at + a) : 4 * (at + b)]
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own))
                        raw.append(own if with_ids else None)
                    at += n
            made = pa.StructArray.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(raw, pa.binary())],
                fields=list(_PIECE))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]), type=pa.int32()), made)
            del made, piece, start, length, crc, raw
        del encoder
        W.release()

    cut.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(cut, "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>")
    added = ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    kept = [c for c in df.columns if c not in {text, *added}]
    # explode would add a filter on the array's size and run the function a second time for it
    found = df.select(*kept, udf(text).alias("_pieces")).select(*kept, F.explode_outer("_pieces").alias("_piece"))
    return found.select(*kept, *[F.col(f"_piece.{c}").alias(c) for c in added[: 5 if with_ids else 4]])


def _best_values(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """The knapsack program: for each capacity the highest total price of a multiset of lengths that fits,
    and the length added last (0 where a unit stays empty)."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    value = np.full(capacity + 1, -np.inf)
    value[1 : len(prices)] = np.where(prices[1:] > 0, prices[1:], -np.inf)
    for c in range(1, capacity + 1):
        total = best[c - 1 :: -1][:c] + value[1 : c + 1]
        i = int(total.argmax())
        if total[i] > best[c - 1]:
            best[c], last[c] = total[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, last.tolist()


def _lengths_of(last: list[int], capacity: int) -> list[int]:
    out = []
    while capacity > 0:
        if last[capacity]:
            out.append(last[capacity])
        capacity -= last[capacity] or 1
    return out


def knapsack(prices: np.ndarray, capacity: int) -> list[int]:
    """The multiset of lengths of the highest total price that fits; ``prices`` by length."""
    return _lengths_of(_best_values(prices, capacity)[1], capacity)


def solve(histogram: np.ndarray, capacity: int, rounds: int = 250, step: float = 0.25) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used; every piece of ``histogram`` (by length) is in one.

    The solution of the linear program is rounded up in the order in which it was found, within what is
    left. What its last steps would still cover, when few lengths are open and configurations begin to leave room,
    is packed better one by one: of some places to stop, that with the fewest sequences is taken, and
    of equal ones the last.
    """
    amounts = list(_fractional(histogram, capacity, rounds, step).items())
    left = histogram.astype(np.int64).copy()
    found: list[tuple[tuple[int, ...], int]] = []
    stops = {-(-len(amounts) * part // 16) for part in (1, 2, 4, 8, 12, 16)}
    best: list[tuple[tuple[int, ...], int]] | None = None
    for i, (lengths, amount) in enumerate(amounts, 1):
        used, copies = np.unique(lengths, return_counts=True)
        times = int(min(np.ceil(amount - 1e-9), (left[used] // copies).min()))
        if times > 0:
            left[used] -= times * copies
            found.append((lengths, times))
        if i in stops:
            plan = found + _best_fit(left, capacity)
            if best is None or sum(t for _, t in plan) <= sum(t for _, t in best):
                best = plan
    return best or []


def _fractional(histogram: np.ndarray, capacity: int, rounds: int, step: float, rate: float = 0.3, close: float = 0.002) -> dict[tuple[int, ...], float]:
    """Multiplicative weights on the covering program: configurations with amounts, in the order found.

    The price of a length is a little more than its share of a sequence, since long pieces are harder to
    place, times a weight that falls with the share covered. One knapsack program gives the best
    configuration with each length; all whose price is as good as the best, but for ``close``, are used in turn, each for
    at most ``step`` of any of its lengths in a round.
    """
    present = np.flatnonzero(histogram)
    total = np.maximum(histogram.astype(np.float64), 1e-9)
    share = np.arange(capacity + 1) / capacity
    bulk = (histogram * share)[present]
    covered = np.zeros(capacity + 1)  # as a part of all
    amounts: dict[tuple[int, ...], float] = {}
    for _ in range(rounds if len(present) else 0):
        mean = float((np.minimum(covered[present], 1.0) * bulk).sum() / bulk.sum())
        prices = np.zeros(capacity + 1)
        prices[present] = share[present] ** 1.1 * np.exp(rate * (mean - covered[present]))
        prices[covered >= 1 - 1e-9] = 0.0
        open_ = np.flatnonzero(prices)
        if mean > 0.999 or not len(open_):
            break
        best, last = _best_values(prices, capacity)
        value = prices[open_] + best[capacity - open_]
        used = np.zeros(capacity + 1)
        for i in np.argsort(-value, kind="stable"):
            if value[i] < (1 - close) * best[capacity]:
                break
            length = int(open_[i])
            choice = tuple(sorted([length, *_lengths_of(last, capacity - length)], reverse=True))
            copies = Counter(choice)
            amount = min(total[n] * min(1 - covered[n], step - used[n]) / m for n, m in copies.items())
            if amount <= 1e-9:
                continue
            amounts[choice] = amounts.get(choice, 0.0) + amount
            for n, m in copies.items():
                covered[n] += amount * m / total[n]
                used[n] += amount * m / total[n]
    return amounts


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack pieces longest first, each into the open sequence with the least room that fits. Sequences of
    equal content are handled together, so the work depends on the lengths, not on the pieces."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        for room in range(length, capacity):
            each = room // length  # a sequence takes copies as long as they fit: nothing fits better
            for content in list(open_[room]):
                if not n:
                    break
                bins = min(open_[room][content], n // each)
                for times, copies in ((bins, each), (1 if n > bins * each and bins < open_[room][content] else 0, n - bins * each)):
                    if times:
                        open_[room][content] -= times
                        rest = room - copies * length
                        made = content + (length,) * copies
                        open_[rest][made] = open_[rest].get(made, 0) + times
                        n -= times * copies
                if not open_[room][content]:
                    del open_[room][content]
            if not n:
                break
        each = capacity // length
        for times, copies in ((n // each, each), (1 if n % each else 0, n % each)):
            if times:
                made = (length,) * copies
                open_[capacity - copies * length][made] = open_[capacity - copies * length].get(made, 0) + times
    return [(made, times) for by_room in open_ for made, times in by_room.items()]


def assignment(plan: list[tuple[tuple[int, ...], int]], histogram: np.ndarray) -> dict[str, np.ndarray]:
    """For every run of ranks of one length: the first place of the run among all pieces ordered by
    length and rank, the first sequence and the offset in it."""
    place = np.cumsum(histogram) - histogram
    first, sequence, offset = [], [], []
    base = 0
    for lengths, times in plan:
        at = 0
        for length in lengths:
            first.append(int(place[length]))
            sequence.append(base)
            offset.append(at)
            place[length] += times
            at += length
        base += times
    order = np.argsort(np.array(first, dtype=np.int64), kind="stable")
    return {"first": np.array(first, dtype=np.int64)[order], "sequence": np.array(sequence, dtype=np.int64)[order],
            "offset": np.array(offset, dtype=np.int64)[order], "starts": np.cumsum(histogram) - histogram}


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. Sequences of one full piece have negative numbers."""
    cut, (size,), restore = sheltered(cut, "length", replaced=("sequence_id", "offset"))
    names = cut.columns
    rows = settle(cut.withColumns({"length": F.col(size), "_row": F.monotonically_increasing_id()}), TEXT_BATCH)
    short = rows.where(F.col("length") < capacity)
    total = short.count()
    full = rows.where(F.col("length") == capacity).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    if not total:
        return restore(full)
    buckets = -(-total // BUCKET_ROWS)
    dealt = short.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    counts = settle(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        histogram[r.length] = r.n
    sent = rows.sparkSession.sparkContext.broadcast(assignment(solve(histogram, capacity), histogram))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")) - 1).join(
        offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        plan = sent.value
        at = plan["starts"][length.to_numpy()] + rank.to_numpy()
        run = np.searchsorted(plan["first"], at, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(plan["sequence"][run] + at - plan["first"][run]), pa.array(plan["offset"][run])], names=["sequence_id", "offset"])

    place.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(place, "sequence_id bigint, offset bigint")
    placed = ranked.select(*names, udf("length", "_rank").alias("_at")).select(*names, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
    return restore(full.unionByName(placed))
