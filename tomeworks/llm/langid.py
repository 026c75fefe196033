"""Language identification by prediction by partial matching.

Per language a context tree over bytes is kept as counts: for each context of up to ``order`` bytes,
which bytes followed how often. The code length of a byte after a context with total T and q
distinct followers is -log2(n / (T + q)) if it was seen n times there; else the escape, log2((T + q) / q),
plus the code length after the next shorter context; below the empty context all 256 bytes are equal.
Statistics are frozen after training. A text gets the language with the shortest code.

Training takes a bounded sample: of each language at most ``sample_rows`` rows, those with the smallest
hashes among a hashed share of twice as many, cut to whole rows of ``sample_bytes`` in all (the first
row always). Every language is trained in one task
of that bound, and the merged trees, bounded by languages x sample bytes, are broadcast.

Scoring is done on whole Arrow batches: the code lengths of all languages for a window (context and
byte) are looked up at once; only positions whose window was never seen go on to shorter contexts.

Edge cases: null texts and texts without a letter get ``und`` with score 0, and so does everything
if no labelled row exists. Equal code lengths go to the first language by name. Null labels and
null texts are never learned from. A language is never lost where ids or texts repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.llm import words as W
from tomeworks.operators.sampling import first_per_key
from tomeworks.operators.settle import settle

U = np.uint64
UNKNOWN = "und"
RUN_BYTES = 512 << 10


def windows(data: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes up to each position as one number; before the start come zeros."""
    out = data.astype(U)
    for i in range(1, n):
        out[i:] |= data[:-i].astype(U) << U(8 * i)
    return out


def padded(offsets: np.ndarray, data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ``order`` zero bytes before each; the positions of the real bytes and their rows."""
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(data)) + (rows + 1) * order
    out = np.zeros(len(data) + len(lengths) * order, dtype=np.uint8)
    out[places] = data
    return out, places, rows


def count_windows(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of 1 to ``order + 1`` bytes and their counts."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data, places, _ = padded(offsets, np.frombuffer(b"".join(texts), dtype=np.uint8), order)
    return [np.unique(windows(data, n)[places], return_counts=True) for n in range(1, order + 2)]


@dataclass
class Level:
    """Contexts of one length: what their escapes cost, and the windows that begin with them."""

    contexts: W.HashTable
    escapes: np.ndarray
    seen: W.HashTable
    costs: np.ndarray


@dataclass
class Model:
    languages: list[str]
    order: int
    levels: list[Level]  # from the empty context up


def build(languages: list[str], counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int) -> Model:
    levels: list[Level] = []
    for n in range(order + 1):
        seen = np.unique(np.concatenate([counts[x][n][0] for x in languages]))
        context_of = seen >> U(8)
        contexts = np.unique(context_of)
        shorter = lookup_costs(levels, seen, len(languages)) if levels else np.full((len(seen), len(languages)), 8.0)
        costs, escapes = shorter.copy(), np.zeros((len(contexts), len(languages)))
        for k, x in enumerate(languages):
            keys, n_seen = counts[x][n]
            at = np.searchsorted(contexts, keys >> U(8))
            total = np.bincount(at, weights=n_seen, minlength=len(contexts))
            distinct = np.bincount(at, minlength=len(contexts))
            used = total > 0
            escapes[used, k] = np.log2((total[used] + distinct[used]) / distinct[used])
            here = np.searchsorted(seen, keys)
            costs[:, k] += escapes[np.searchsorted(contexts, context_of), k]
            costs[here, k] = np.log2((total[at] + distinct[at]) / n_seen)
        levels.append(Level(W.HashTable(W.mix(contexts)), escapes.astype(np.float32), W.HashTable(W.mix(seen)), costs.astype(np.float32)))
    return Model(languages, order, levels)


def lookup_costs(levels: list[Level], window: np.ndarray, n_languages: int) -> np.ndarray:
    """Code lengths of the last byte of each window in every language, by the given levels."""
    out = np.full((len(window), n_languages), 8.0, dtype=np.float32)
    rest = np.arange(len(window))
    spent = np.zeros((len(window), n_languages), dtype=np.float32)
    for n in range(len(levels) - 1, -1, -1):
        mask = U((1 << 8 * (n + 1)) - 1)
        keys = window[rest] & mask
        at = levels[n].seen.find(W.mix(keys))
        hit = at >= 0
        out[rest[hit]] = spent[rest[hit]] + levels[n].costs[at[hit]]
        rest = rest[~hit]
        context = levels[n].contexts.find(W.mix(keys[~hit] >> U(8)))
        known = context >= 0
        spent[rest[known]] += levels[n].escapes[context[known]]
    out[rest] = spent[rest] + 8.0
    return out


def code_lengths(model: Model, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bits of each text in every language."""
    n = len(offsets) - 1
    spread, places, _ = padded(offsets, data, model.order)
    window = windows(spread, model.order + 1)[places]
    bits = lookup_costs(model.levels, window, len(model.languages))
    out = np.zeros((n, len(model.languages)))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(bits, offsets[filled], axis=0, dtype=np.float64)
    return out


def train(
    df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, order: int = 4, sample_rows: int = 1000,
    sample_bytes: int = 1_500_000,
) -> Model:
    """Learn from the labelled rows of ``df``; ``key`` and text only seed the choice of the sample."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # a language's share of the hash range holds twice the sample on average, so that few rows are ranked
    # and the rows of its least hash are always there, however often ids or texts repeat
    place = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(1)), F.lit(1 << 40))
    rows = labelled.select(F.col(lang).alias("lang"), place.alias("place"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"))
    shares = settle(rows.groupBy("lang").agg((F.lit(2.0 * sample_rows) / F.count("*")).alias("share"), F.min("place").alias("least")))
    near = (F.col("place") / float(1 << 40) < F.col("share")) | (F.col("place") == F.col("least"))
    sample = rows.join(shares, "lang").where(near).drop("place", "share", "least")
    sample = first_per_key(sample, ["lang"], [F.col("h"), F.col("text")], sample_rows).drop("_rank")

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("text", "ascending")])
        texts, size = [], 0
        for t in table.column("text").to_pylist():
            raw = t.encode()
            if texts and size + len(raw) > sample_bytes:
                break
            texts.append(raw)
            size += len(raw)
        counted = count_windows(texts, order)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "windows": [[k.tobytes() for k, _ in counted]],
                         "counts": [[c.astype(np.int64).tobytes() for _, c in counted]]})

    rows = sample.groupBy("lang").applyInArrow(count, "lang string, windows array<binary>, counts array<binary>").collect()
    counts = {r.lang: [(np.frombuffer(k, dtype=U), np.frombuffer(c, dtype=np.int64)) for k, c in zip(r.windows, r.counts)] for r in rows}
    languages = sorted(counts)
    return build(languages, counts, order) if languages else Model([], order, [])


def identify(model: Model, df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``score`` compares the mean bits per byte of the best language with those of all: a share between
    1 / languages (no preference) and 1.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for array in batches:
            best, share = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
            for _, offsets, data in W.runs(array, RUN_BYTES):
                bits = code_lengths(m, offsets, data)
                best.append(bits.argmin(axis=1))
                mean = bits / np.maximum(np.diff(offsets), 1)[:, None]
                share.append(1.0 / np.exp2(4 * (mean.min(axis=1)[:, None] - mean)).sum(axis=1))
            yield pa.StructArray.from_arrays([pa.array(m.languages).take(pa.array(np.concatenate(best))), pa.array(np.concatenate(share))],
                                             names=["lang_pred", "score"])
        W.release()

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return df.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    udf = F.arrow_udf(predict, "lang_pred string, score double")
    made = df.select(*kept, has_letter.alias("_letter"), udf(text).alias("_p"))
    return made.select(*kept, F.when(F.col("_letter"), F.col("_p.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                       F.when(F.col("_letter"), F.col("_p.score")).otherwise(0.0).alias("score"))
