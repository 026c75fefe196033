"""Language-model scoring with a log-frequency Bloom filter.

Every n-gram of the training texts (orders 1 to ``order``) is held as its quantised count: count c
has level ``1 + floor(log_base c)``, and the filter gets one entry for each level up to it. A count
is read back by probing level after level until one is missing. Probabilities are Dirichlet-smoothed:

    P(w | h) = (q(hw) + mu * P(w | h')) / (max(Q(h), q(hw)) + mu),    P(w) = (q(w) + 1) / (N + V + 1)

q is the smallest count of its level and Q(h) the largest, so that without false positives the
probabilities of all words after h sum to at most one. Words are told apart by 64-bit hashes.

Spark counts: tasks send packed arrays of hashes with counts, already summed per batch, to shards;
each shard sums them and makes its segment of the filter, of ``bits_per_entry`` for each entry. Segments
are broadcast in blocks of at most ``max_filter_bytes`` (one segment at least). With several blocks each
is a further map-only pass that adds the levels of its own n-grams to those of every token.

Edge cases: null is the empty text, which has one token (the end). Without training tokens every
probability is 1 / 1 for the base and the model. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.llm import words as W
from tomeworks.llm.columns import sheltered
from tomeworks.operators.settle import settle

U = np.uint64
START, END = W.mix(np.array([1, 2], dtype=U))

#: Tokens that a shard holds at most, about; and n-grams a task sums up before it sends them.
SHARD_TOKENS = 2_000_000
SUM_TOKENS = 1_200_000
PROBES = 4


def token_stream(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with one end per row, their rows, and the places of the ends."""
    hashes, rows = W.word_hashes(offsets, data, W.NOT_BLANK)
    n = len(offsets) - 1
    counts = W.row_counts(rows, n)
    ends = np.cumsum(counts + 1) - 1
    tokens = np.full(len(hashes) + n, END)
    tokens[np.arange(len(hashes)) + rows] = hashes
    return tokens, np.repeat(np.arange(n), counts + 1), ends


def ngram_keys(tokens: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, by order from 1; texts begin with starts."""
    firsts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    keys, before = [tokens], tokens
    for n in range(2, order + 1):
        # the n-gram at i is the pair of the (n-1)-gram at i-1 and the token at i
        left = np.empty_like(before)
        left[1:] = before[:-1]
        left[firsts] = W.mix(np.array([n], dtype=U) + START)[0]
        before = W.chain(left, tokens)
        keys.append(before)
    return keys


def context_keys(keys: list[np.ndarray], ends: np.ndarray) -> list[np.ndarray]:
    """For each order from 2, the key of the context before each token."""
    firsts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    out = []
    for n in range(2, len(keys) + 1):
        left = np.empty_like(keys[n - 2])
        left[1:] = keys[n - 2][:-1]
        left[firsts] = W.mix(np.array([n], dtype=U) + START)[0]
        out.append(left)
    return out


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)


SHARDED = "kind int, shard int, n_keys int, keys binary, counts binary"


def _count_rows(batches: Iterator[pa.RecordBatch], order: int, shards: int) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"kind": [], "shard": [], "n_keys": [], "keys": [], "counts": []}
        for kind in range(order):
            keys, counts = _sums(all_keys := np.concatenate([h[kind] for h in held]), np.ones(len(all_keys), dtype=np.int64))
            cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            for s in range(shards):
                if cuts[s] < cuts[s + 1]:
                    part = slice(cuts[s], cuts[s + 1])
                    out["kind"].append(kind)
                    out["shard"].append(s)
                    out["n_keys"].append(cuts[s + 1] - cuts[s])
                    out["keys"].append(keys[part].tobytes())
                    out["counts"].append(counts[part].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("kind", pa.int32()), ("shard", pa.int32()), ("n_keys", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    for batch in batches:
        for _, offsets, data in W.runs(batch.column(0)):
            tokens, _, ends = token_stream(offsets, data)
            # the starts are contexts too: they count as often as there are texts
            keys = ngram_keys(tokens, ends, order)
            for n in range(2, order + 1):
                keys[n - 2] = np.concatenate([keys[n - 2], np.full(len(ends), W.mix(np.array([n], dtype=U) + START)[0])])
            held.append(keys)
            size += len(tokens)
            if size >= SUM_TOKENS:
                yield from send()
                held, size = [], 0
                W.release()
    if held:
        yield from send()
    held = []
    W.release()  # a worker lives on for later stages


class LevelFilter:
    """Bloom filter of (key, level) in segments of 64-bit words. An entry sets ``PROBES`` bits of one
    word, so a probe reads memory once."""

    def __init__(self, sizes: list[int]) -> None:
        self.sizes = np.array(sizes, dtype=U)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.words = np.zeros(sum(sizes), dtype=U)

    @staticmethod
    def places(keys: np.ndarray, level: int, sizes: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
        h = W.mix(keys + U(level * int(W._ODD) & (1 << 64) - 1))
        mask = np.zeros(len(keys), dtype=U)
        for i in range(PROBES):
            mask |= U(1) << ((h >> U(6 * i)) & U(63))
        return ((h >> U(32)) * sizes >> U(32)).astype(np.int64), mask

    @staticmethod
    def segment(keys: np.ndarray, levels: np.ndarray, n_words: int) -> np.ndarray:
        out = np.zeros(n_words, dtype=U)
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= level], levels[levels >= level]
            at, mask = LevelFilter.places(keys, level, U(n_words))
            np.bitwise_or.at(out, at, mask)
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level found of each key; 0 for a key that is not there."""
        found = np.zeros(len(keys), dtype=np.int64)
        if not len(self.words):
            return found
        shard = shard_of(keys, len(self.sizes))
        alive = np.flatnonzero(self.sizes[shard])
        sizes, starts = self.sizes[shard], self.starts[shard]
        level = 1
        while len(alive):
            at, mask = self.places(keys[alive], level, sizes[alive])
            alive = alive[(self.words[starts[alive] + at] & mask) == mask]
            found[alive] = level
            level += 1
        return found


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    """``1 + floor(log_base count)``, exact at the bounds of levels."""
    return np.searchsorted(bounds(base), counts, side="right")


def bounds(base: float) -> np.ndarray:
    """The smallest whole count of each level, without levels that no whole count has."""
    return np.unique(np.ceil(base ** np.arange(0, int(np.log(2.0**62) / np.log(base)) - 1)).astype(np.int64))


@dataclass
class Model:
    order: int
    base: float
    mu: float
    tokens: int
    distinct: int
    head: np.ndarray
    head_counts: np.ndarray


@dataclass
class Trained:
    model: Model
    unigrams: DataFrame
    shards: int
    segments: DataFrame
    sizes: list[int]
    blocks: list[list[int]]

    def filter(self, block: list[int]) -> LevelFilter:
        """The segments of some shards; the others are empty."""
        mine = set(block)
        held = LevelFilter([n if s in mine else 0 for s, n in enumerate(self.sizes)])
        for r in self.segments.where(F.col("shard").isin(block)).toLocalIterator():  # never more than one partition on the way
            held.words[held.starts[r.shard] :][: self.sizes[r.shard]] = np.frombuffer(r.bits, dtype=U)
        return held


def blocks_of(sizes: list[int], max_filter_bytes: int) -> list[list[int]]:
    """Consecutive shards whose segments fit, one at least; one block where there are none."""
    blocks: list[list[int]] = [[]]
    held = 0
    for shard, n in enumerate(sizes):
        if blocks[-1] and held + 8 * n > max_filter_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append(shard)
        held += 8 * n
    return blocks


def train(
    df: DataFrame, text: str = "text", *, order: int = 2, base: float = 1.5, mu: float = 1000.0, bits_per_entry: int = 12,
    max_filter_bytes: int = 256 << 20, head_words: int = 500_000,
) -> Trained:
    """Learn from ``text`` of all rows. Exact counts serve ``base_score`` and ``n_known`` alone: those of at
    most ``head_words`` words are broadcast, the others stay in a table. The model reads the filter."""
    spark = df.sparkSession
    size = df.agg(F.coalesce(F.sum(F.octet_length(text) + 6), F.lit(0))).first()[0]
    shards = max(8, -(-size // (6 * SHARD_TOKENS)))
    counted = df.select(text).mapInArrow(lambda batches: _count_rows(batches, order, shards), SHARDED)
    bottoms = bounds(base)

    def shard(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        entries, sums = [], []
        for kind in range(order):
            part = table.filter(pa.compute.equal(table.column("kind"), kind))
            keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), dtype=U)
            counts = np.frombuffer(b"".join(part.column("counts").to_pylist()), dtype=np.int32)
            keys, counts = _sums(keys, counts.astype(np.int64))
            entries.append((keys, level_of(counts, base)))
            if kind == 0:
                first, first_counts = keys, counts
            del part
        n_entries = sum(int(levels.sum()) for _, levels in entries)
        n_words = max(1, -(-n_entries * bits_per_entry // 64))
        bits = np.zeros(n_words, dtype=U)
        for keys, levels in entries:
            bits |= LevelFilter.segment(keys, levels, n_words)
        # counts of the starts are contexts, not words
        word = np.isin(first, W.mix(np.arange(2, order + 1, dtype=U) + START), invert=True)
        first, first_counts = first[word], first_counts[word]
        by_level = np.bincount(level_of(first_counts, base), minlength=len(bottoms) + 1)
        sums = [int(first_counts.sum()), len(first)]
        return pa.table({"shard": [number], "tokens": [sums[0]], "distinct": [sums[1]], "by_level": [by_level.tolist()],
                         "bits": [bits.tobytes()], "keys": [first.tobytes()], "counts": [first_counts.tobytes()]},
                        schema=pa.schema([("shard", pa.int32()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("by_level", pa.list_(pa.int64())),
                                          ("bits", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]))

    made = settle(counted.groupBy("shard").applyInArrow(
        shard, "shard int, tokens bigint, distinct bigint, by_level array<bigint>, bits binary, keys binary, counts binary"))
    rows = {r.shard: r for r in made.select("shard", "tokens", "distinct", "by_level", (F.octet_length("bits") / 8).cast("int").alias("n")).collect()}
    tokens, distinct = sum(r.tokens for r in rows.values()), sum(r.distinct for r in rows.values())
    levels = np.sum([r.by_level for r in rows.values()], axis=0) if rows else np.zeros(1, dtype=np.int64)
    above = np.cumsum(levels[::-1])[::-1]  # words at a level or above
    fits = np.flatnonzero(above <= head_words)
    least = int(bottoms[max(int(fits[0]) - 1, 0)]) if len(fits) and fits[0] <= len(bottoms) else int(bottoms[-1])
    sizes = [rows[s].n if s in rows else 0 for s in range(shards)]

    def head_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(keys, dtype=U), np.frombuffer(counts, dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"keys": [keys[counts >= least].tobytes()], "counts": [counts[counts >= least].tobytes()]})

    heads = made.select("keys", "counts").mapInArrow(head_rows, "keys binary, counts binary").collect()
    head = np.frombuffer(b"".join(r.keys for r in heads), dtype=U)
    head_counts = np.frombuffer(b"".join(r.counts for r in heads), dtype=np.int64)
    model = Model(order, base, mu, tokens, distinct, head, head_counts)
    return Trained(model, made.select("shard", "keys", "counts"), shards, made.select("shard", "bits"), sizes, blocks_of(sizes, max_filter_bytes))


def token_levels(held: LevelFilter, tokens: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """For each token the levels of the n-grams that end there and then of the contexts before it."""

    def levels(keys: np.ndarray) -> np.ndarray:
        keys, back = np.unique(keys, return_inverse=True)
        return held.levels(keys)[back]

    keys = ngram_keys(tokens, ends, order)
    return np.stack([levels(k) for k in [*keys, *context_keys(keys, ends)]], axis=1).astype(np.uint16)


def log_probabilities(m: Model, found: np.ndarray) -> np.ndarray:
    """log10 P of each token from its ``token_levels``."""
    bottoms = bounds(m.base)
    low = np.concatenate([[0], bottoms]).astype(np.float64)
    high = np.concatenate([[0], bottoms[1:] - 1, [bottoms[-1]]]).astype(np.float64)
    p = (low[found[:, 0]] + 1.0) / (m.tokens + m.distinct + 1.0)
    for n in range(2, m.order + 1):
        seen = found[:, m.order + n - 2]
        # an n-gram occurs only where its context does
        joint = np.where(seen > 0, low[found[:, n - 1]], 0.0)
        p = (joint + m.mu * p) / (np.maximum(high[seen], joint) + m.mu)
    return np.log10(p)


def _unpacked(raw: pa.Array, first: int, n: int, order: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.slice(first, n).to_pylist()), dtype=np.uint16).reshape(-1, 2 * order - 1)


def _with_levels(held, df: DataFrame, text: str, order: int, more: bool) -> DataFrame:
    """``df`` with the packed levels of its tokens in ``_levels``, added to those of earlier blocks."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for array, before in batches:
            out: list[bytes] = []
            for first, offsets, data in W.runs(array):
                tokens, _, ends = token_stream(offsets, data)
                found = token_levels(held.value, tokens, ends, order)
                if more:
                    found = found + _unpacked(before, first, len(ends), order)
                cuts = np.concatenate([[0], ends + 1]).tolist()
                out += [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.array(out, type=pa.binary())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    before = F.col("_levels") if more else F.lit(None).cast("binary")
    return settle(df.withColumn("_levels", F.arrow_udf(run, "binary")(text, before)))


def score(trained: Trained, df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text`` and with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``; columns of these names are replaced."""
    spark = df.sparkSession
    m, shards = trained.model, trained.shards
    sent = spark.sparkContext.broadcast(m)
    df, (text,), restore = sheltered(df, text, replaced=("n_tokens", "n_known", "train_tokens", "base_score", "score"))
    kept = [c for c in df.columns if c != text]
    uid = "_row"
    total = float(m.tokens + m.distinct + 1)
    several = len(trained.blocks) > 1
    asked = df.select(*kept, text)
    if several:
        for i, block in enumerate(trained.blocks):
            segment = spark.sparkContext.broadcast(trained.filter(block))
            asked = _with_levels(segment, asked, text, m.order, i > 0)
            segment.unpersist()
    held = None if several else spark.sparkContext.broadcast(trained.filter(trained.blocks[0]))

    def parts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = sent.value
        table = W.HashTable(model.head)
        for array, packed in batches:
            out: list[tuple] = []
            for start, offsets, data in W.runs(array):
                tokens, rows, ends = token_stream(offsets, data)
                n = len(ends)
                at = table.find(tokens)
                found = token_levels(held.value, tokens, ends, model.order) if held else _unpacked(packed, start, n, model.order)
                logs = log_probabilities(model, found)
                known = at >= 0
                base = np.where(known, np.log10((model.head_counts[at] if len(model.head) else np.zeros(len(at))) + 1.0), 0.0)
                rest, rest_rows = tokens[~known], rows[~known]
                cuts = np.searchsorted(rest_rows, np.arange(n + 1))
                raw, first = rest.tobytes(), np.bincount(rows, minlength=n)
                out += zip(first.tolist(), np.bincount(rows, weights=known, minlength=n).astype(np.int64).tolist(),
                           np.bincount(rows, weights=base, minlength=n).tolist(), np.bincount(rows, weights=logs, minlength=n).tolist(),
                           [raw[8 * a : 8 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
            names = ["n_tokens", "known", "base", "score", "rest"]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.StructArray.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds)], names=names)
            del out, columns
            W.release()

    parts.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    levels = F.col("_levels") if several else F.lit(None).cast("binary")
    part = F.arrow_udf(parts, "n_tokens bigint, known bigint, base double, score double, rest binary")
    passed = settle(asked.select(*kept, part(text, levels).alias("_p")).select(
        *kept, F.monotonically_increasing_id().alias(uid), F.col("_p.n_tokens").alias("_n"), F.col("_p.known").alias("_known"),
        F.col("_p.base").alias("_base"), F.col("_p.score").alias("_score"), F.col("_p.rest").alias("_rest")))

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rest = batch.column(1).to_pylist()
            lengths = np.array([len(r) // 8 for r in rest], dtype=np.int64)
            keys = np.frombuffer(b"".join(rest), dtype=U)
            owners = np.repeat(ids, lengths)
            to = shard_of(keys, shards)
            order = np.argsort(to, kind="stable")
            keys, owners, cuts = keys[order], owners[order], np.searchsorted(to[order], np.arange(shards + 1))
            used = np.flatnonzero(cuts[1:] > cuts[:-1])
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(used, type=pa.int32()), "keys": [keys[cuts[s] : cuts[s + 1]].tobytes() for s in used],
                "owners": [owners[cuts[s] : cuts[s + 1]].tobytes() for s in used]},
                schema=pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary())]))

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("uid", pa.int64()), ("known", pa.int64()), ("base", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        keys = np.frombuffer(b"".join(asked.column("keys").to_pylist()), dtype=U)
        owners = np.frombuffer(b"".join(asked.column("owners").to_pylist()), dtype=np.int64)
        mine = np.frombuffer(b"".join(held.column("keys").to_pylist()), dtype=U)
        counts = np.frombuffer(b"".join(held.column("counts").to_pylist()), dtype=np.int64)
        at = np.minimum(np.searchsorted(mine, keys), max(len(mine) - 1, 0))
        hit = mine[at] == keys if len(mine) else np.zeros(len(keys), dtype=bool)
        ids, back = np.unique(owners[hit], return_inverse=True)
        return pa.table({"uid": ids, "known": np.bincount(back, minlength=len(ids)).astype(np.int64),
                         "base": np.bincount(back, weights=np.log10(counts[at[hit]] + 1.0), minlength=len(ids))}, schema=schema)

    asked = passed.where(F.octet_length("_rest") > 0).select(uid, "_rest").mapInArrow(by_shard, "shard int, keys binary, owners binary")
    answers = (
        asked.groupBy("shard").cogroup(trained.unigrams.groupBy("shard")).applyInArrow(look_up, "uid bigint, known bigint, base double")
        .groupBy("uid").agg(F.sum("known").alias("_more"), F.sum("base").alias("_add")).withColumnRenamed("uid", uid)
    )
    out = passed.drop("_rest").join(answers, uid, "left")
    return restore(out.select(
        *kept, F.col("_n").alias("n_tokens"), (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(m.tokens).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_add", F.lit(0.0)) - F.col("_n") * F.log10(F.lit(total))).alias("base_score"),
        F.col("_score").alias("score"),
    ))
