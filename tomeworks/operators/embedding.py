"""Vectors for chunks through a caller's encoder, and a hashed bag of words for tests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.functions.text import text_or_empty

# An encoder takes texts and returns one dense vector and one CSR row (token ids, weights) each.
CsrRow = tuple[Sequence[int], Sequence[float]]
Encoder = Callable[[Sequence[str]], tuple[Sequence[Sequence[float]], Sequence[CsrRow]]]
VECTORS = "struct<dense:array<float>,tokens:array<int>,weights:array<float>>"


def embedding_text() -> Column:
    return F.concat(text_or_empty(F.col("item_name")), F.lit("\n"), text_or_empty(F.col("content")))


def csr_row(indices: Column, weights: Column) -> Column:
    """One row of a sparse matrix as token id to weight."""
    return F.map_from_arrays(indices, weights)


def embed(chunks: DataFrame, make_encoder: Callable[[], Encoder], batch_size: int = 8,
          text: Column | None = None) -> DataFrame:
    """Add ``dense_vector`` and ``sparse_vector``. The encoder is made once per task and only
    the text column travels to Python."""

    @F.pandas_udf(VECTORS)
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for texts in batches:
            dense: list = []
            rows: list = []
            for start in range(0, len(texts), batch_size):
                d, r = encode(texts.iloc[start:start + batch_size].tolist())
                dense.extend(d)
                rows.extend(r)
            yield pd.DataFrame({
                "dense": dense, "tokens": [r[0] for r in rows], "weights": [r[1] for r in rows],
            })

    # Declared non-deterministic so that no filter on a vector evaluates the encoder again below.
    once = vectors.asNondeterministic()
    done = chunks.withColumn("_v", once(embedding_text() if text is None else text))
    return done.select(
        *chunks.columns, F.col("_v.dense").alias("dense_vector"),
        csr_row(F.col("_v.tokens"), F.col("_v.weights")).alias("sparse_vector"),
    )


def hashed_terms() -> Encoder:
    """Term counts under a 28-bit hash, and their fixed projection to 32 dimensions (one per
    hex digit of the hash)."""
    token = re.compile(r"[a-z]+")

    def one(text: str) -> tuple[np.ndarray, CsrRow]:
        counts = Counter(token.findall(text))
        digests = b"".join(hashlib.md5(w.encode()).digest() for w in counts)
        octets = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16).astype(np.int64)
        n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        digits = np.stack([octets >> 4, octets & 15], axis=2).reshape(-1, 32)
        ids = (octets[:, 0] << 20) | (octets[:, 1] << 12) | (octets[:, 2] << 4) | (octets[:, 3] >> 4)
        tokens, place = np.unique(ids, return_inverse=True)
        weights = np.bincount(place, weights=n, minlength=len(tokens))
        return (n @ (digits - 7.5)).astype(np.float32), (tokens.astype(np.int32), weights.astype(np.float32))

    def encode(texts: Sequence[str]):
        done = [one(t) for t in texts]
        return [d for d, _ in done], [r for _, r in done]

    return encode
