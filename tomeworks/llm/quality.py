"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Every text becomes ``STATISTICS`` transformed numbers: logarithms of sizes, log-odds of shares. Both classes
(label 1 and 0) get a mean and a covariance. A covariance is shrunk in two steps, with S the covariance of
the class, P the one pooled over the classes and d the number of statistics:

    C = (1 - pooling) * S + pooling * P,    C' = (1 - ridge) * C + ridge * (trace(C) / d) * I

The score is the posterior of label 1, from the difference of the two Gaussian log-densities plus the log of
the ratio of the classes. Mahalanobis distances come from Cholesky factors, computed once.

Training reads every labelled row: tasks sum counts, statistics and their products, which Spark adds up; the
driver gets one number for each class and pair of statistics. Nothing is sampled. Scoring is map-only.

Edge cases: null is the empty text; it and all texts without words get a score like any other. Null labels
and labels other than 0 and 1 are not learned from; a document with several labels counts once for each,
and repeated rows count as often as they occur. With rows of one label only the score is 1 or 0 for all, and
without any 0.5. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.llm import words as W

U = np.uint64
#: Texts looked at together: about so many bytes, and at most so many rows, since each has a histogram of bytes.
RUN_BYTES, RUN_ROWS = 512 << 10, 4096
#: Tasks that the rows of one document id are dealt over when labels are looked up.
SALTS = 16
#: Log-density differences beyond this change a score by less than 1e-13.
LARGEST = 30.0

STATISTICS = (
    "chars", "words", "lines", "word length", "word length spread", "words a line", "words a sentence", "capitals of letters", "capital words",
    "digits", "symbols", "symbol ends", "pipes", "marks", "exclamations", "commas", "beyond ASCII", "blank", "distinct words",
    "words like the one before", "distinct pairs", "commonest word", "distinct lines", "entropy of bytes")

_UPPER = W.byte_class(range(0x41, 0x5B))
_LETTER = W.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_DIGIT = W.byte_class(range(0x30, 0x3A))
_MARK = W.byte_class(b".!?")
_SYMBOL = W.byte_class(b"#$%&*+/<=>@[\\]^_`{|}~")
_CONTINUES = W.byte_class(range(0x80, 0xC0))
_NOT_LINE_END = ~W.byte_class(b"\n")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys of each row, and how often its commonest one occurs."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
    times = np.diff(np.concatenate([first, [len(r)]]))
    most = np.zeros(n)
    np.maximum.at(most, r[first], times)
    return np.bincount(r[first], minlength=n).astype(np.float64), most


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of a share; half a case is added on both sides, so that no share is 0 or 1."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0.0) + 0.5))


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    chars = size - _per_row(_CONTINUES[data], offsets)
    starts, ends, rows = W.word_bounds(offsets, data, W.NOT_BLANK)
    hashes = W.span_hashes(data, starts, ends)
    n_words = W.row_counts(rows, n).astype(np.float64)
    before = np.concatenate([[0], np.cumsum(~_CONTINUES[data])])
    length = (before[ends] - before[starts]).astype(np.float64)
    total = np.bincount(rows, weights=length, minlength=n)
    mean = total / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(np.bincount(rows, weights=length**2, minlength=n) / np.maximum(n_words, 1) - mean**2, 0.0))
    line_starts, line_ends, line_rows = W.word_bounds(offsets, data, _NOT_LINE_END)
    n_lines = W.row_counts(line_rows, n).astype(np.float64)
    distinct_lines, _ = _distinct(line_rows, W.span_hashes(data, line_starts, line_ends), n)
    distinct_words, commonest = _distinct(rows, hashes, n)
    same_row = rows[1:] == rows[:-1]
    pair_rows = rows[1:][same_row]
    n_pairs = W.row_counts(pair_rows, n).astype(np.float64)
    distinct_pairs, _ = _distinct(pair_rows, W.chain(hashes[:-1], hashes[1:])[same_row], n)
    repeats = np.bincount(pair_rows, weights=(hashes[1:] == hashes[:-1])[same_row], minlength=n)
    letters, marks = _per_row(_LETTER[data], offsets), _per_row(_MARK[data], offsets)
    capital = np.bincount(rows, weights=_UPPER[data[starts]], minlength=n)
    symbol_ends = np.bincount(rows, weights=_SYMBOL[data[ends - 1]] | (data[ends - 1] == 0x21), minlength=n)
    seen = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 256 + data, minlength=256 * n).reshape(n, 256)
    share = seen / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)
    return np.stack([
        np.log1p(chars), np.log1p(n_words), np.log1p(n_lines), np.log1p(mean), np.log1p(spread), np.log1p(n_words / np.maximum(n_lines, 1)),
        np.log1p(n_words / (marks + 1)), _odds(_per_row(_UPPER[data], offsets), letters), _odds(capital, n_words),
        _odds(_per_row(_DIGIT[data], offsets), size), _odds(_per_row(_SYMBOL[data], offsets), size), _odds(symbol_ends, n_words),
        _odds(_per_row(data == 0x7C, offsets), size), _odds(marks, size), _odds(_per_row(data == 0x21, offsets), size),
        _odds(_per_row(data == 0x2C, offsets), size), _odds(_per_row(data >= 0x80, offsets), size), _odds(size - _per_row(W.NOT_BLANK[data], offsets), size),
        _odds(distinct_words, n_words), _odds(repeats, n_pairs), _odds(distinct_pairs, n_pairs), _odds(commonest, n_words),
        _odds(distinct_lines, n_lines), entropy], axis=1)


def statistics_of(text: Column | str) -> Column:
    """The statistics of a text column as an array of doubles, computed over whole texts."""

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            made = [statistics(offsets, data) for _, offsets, data in W.runs(array, RUN_BYTES, RUN_ROWS)]
            flat = np.concatenate(made).ravel() if made else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(array) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat))
        W.release()

    compute.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(compute, "array<double>")(text)


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the lower Cholesky factor of the covariance
    constant: float  # log of the prior minus half the log-determinant

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray, prior: float) -> Gaussian:
        lower = np.linalg.cholesky(covariance)
        return cls(mean, np.linalg.inv(lower), float(np.log(prior) - np.log(np.diag(lower)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Up to a constant that all classes share."""
        return self.constant - 0.5 * (((x - self.mean) @ self.factor.T) ** 2).sum(axis=1)


@dataclass
class Model:
    """Both classes on statistics scaled by ``centre`` and ``scale``; without classes all get ``otherwise``."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[Gaussian]
    otherwise: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.otherwise)
        scaled = (x - self.centre) / self.scale
        low, high = (c.log_density(scaled) for c in self.classes)
        return 1.0 / (1.0 + np.exp(-np.clip(high - low, -LARGEST, LARGEST)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooling: float, ridge: float) -> Model:
    """From the number of rows, the sums and the sums of products of both classes."""
    d, total = sums.shape[1], counts.sum()
    if not counts.all():
        return Model(np.zeros(d), np.ones(d), [], 0.5 if not total else float(counts[1] > 0))
    centre = sums.sum(axis=0) / total
    spread = np.diag(products.sum(axis=0)) / total - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means = sums / counts[:, None]
    own = [(products[k] / counts[k] - np.outer(means[k], means[k])) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (counts[0] * own[0] + counts[1] * own[1]) / total
    classes = []
    for k in (0, 1):
        c = (1 - pooling) * own[k] + pooling * pooled
        c = (1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-6) * np.eye(d)
        classes.append(Gaussian.of((means[k] - centre) / scale, c, counts[k] / total))
    return Model(centre, scale, classes, 0.5)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: for each class the number of rows, the sums, and the products of all pairs of statistics."""
    d = len(STATISTICS)
    held = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for k in (0, 1):
            times = batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.float64)
            weighted = x * times[:, None]
            held[k] += np.concatenate([[times.sum()], weighted.sum(axis=0), (weighted.T @ x).ravel()])
    yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], type=pa.int32()), "sums": held.tolist()})


def train(
    stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", x: str = "stats", *, pooling: float = 0.5, ridge: float = 0.01,
) -> Model:
    """Learn from the rows of ``stats`` (``key`` and the statistics ``x``) that ``labels`` names by ``key``."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(
        *[F.count_if(F.col(label) == k).alias(name) for k, name in enumerate(("zeros", "ones"))])
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = stats.select(F.col(key).alias("key"), F.col(x).alias("x")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, ["key", "salt"]).select("x", "zeros", "ones")
    sums = joined.mapInArrow(_pair_sums, "label int, sums array<double>").select("label", F.posexplode("sums").alias("place", "value"))
    d = len(STATISTICS)
    held = np.zeros((2, 1 + d + d * d))
    for r in sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():  # classes x pairs of statistics
        held[r.label, r.place] = r.value
    return fit(held[:, 0], held[:, 1 : 1 + d], held[:, 1 + d :].reshape(2, d, d), pooling, ridge)


def score(model: Model, stats: DataFrame, x: str = "stats", threshold: float = 0.3) -> DataFrame:
    """``stats`` without ``x`` and with ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def apply(array: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(array.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))))

    apply.__annotations__ = {"array": pa.Array, "return": pa.Array}
    kept = [c for c in stats.columns if c not in {x, "score", "predicted"}]
    return stats.select(*kept, F.arrow_udf(apply, "double")(x).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
