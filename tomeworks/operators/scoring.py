"""Blocks of query-by-chunk scores and their running top k, inside one task.

All three searches are inner products: shared characters of 0/1 rows, cosine of unit rows,
sparse dot products. A scorer is built from a bounded block of queries. It reads a slice of
chunks once (``encode``) and scores it for one run of queries after the other (``offer``), at most
``SLICE x WIDTH`` pairs at a time, so a task's memory does not grow with its queries. Shared characters
are counted only for pairs that can still be among a query's best.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd

SLICE = 2048
WIDTH = 1024
CELLS = 4_000_000
NO_ID = np.iinfo(np.int64).max


class Scorer:
    """What the scorers have in common: every pair of a slice and a run is scored."""

    def top(self, run: slice, k: int) -> TopK:
        return TopK(run.stop - run.start, k)

    def offer(self, encoded: Any, ids: np.ndarray, run: slice, top: TopK) -> None:
        top.offer(self.score(encoded, run), ids)


class DenseScorer(Scorer):
    """Cosine similarity, or the plain inner product."""

    def __init__(self, vectors: Sequence[Sequence[float]], metric: str = "COSINE", digits: int = 6) -> None:
        if metric not in ("COSINE", "IP"):
            raise ValueError(f"unknown metric {metric}")
        self.cosine = metric == "COSINE"
        self.queries = self._unit(np.stack([np.asarray(v, dtype=np.float64) for v in vectors])).T
        self.digits = digits

    @classmethod
    def of(cls, queries: pd.DataFrame, metric: str = "COSINE") -> DenseScorer | None:
        held = queries[queries["vector"].notna()]
        if held.empty:
            return None
        made = cls(held["vector"].tolist(), metric)
        made.ids = held["query_id"].to_numpy()
        return made

    @staticmethod
    def usable(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[frame["vector"].notna()]

    def _unit(self, rows: np.ndarray) -> np.ndarray:
        if not self.cosine:
            return rows
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)

    def encode(self, frame: pd.DataFrame) -> np.ndarray:
        return self._unit(np.stack([np.asarray(v, dtype=np.float64) for v in frame["vector"]]))

    def score(self, rows: np.ndarray, some: slice | np.ndarray) -> np.ndarray:
        """Scores of encoded rows for some of the queries, by number."""
        return np.round(rows @ self.queries[:, some], self.digits)


class OverlapScorer(Scorer):
    """Number of distinct characters two texts share.

    A query whose ``k`` best so far share ``floor`` characters with it needs a chunk that shares more, or as many
    under a lower id. Such a chunk has one of any ``size - floor`` (or one more) of the query's characters, so only
    chunks with one of its rarest are counted; with ``k`` chunks that share them all only lower ids are.
    """

    def __init__(self, texts: Sequence[str], floors: np.ndarray | None = None, last: np.ndarray | None = None) -> None:
        own = [set(text) for text in texts]
        chars = sorted(set().union(*own))
        at = {c: i for i, c in enumerate(chars)}
        self.places = np.full(max(map(ord, chars), default=0) + 2, -1, dtype=np.int32)
        self.places[[ord(c) for c in chars]] = np.arange(len(chars))
        self.width = len(chars)
        self.rows = max(1, CELLS // max(1, self.width))
        self.sizes = np.array([len(o) for o in own], dtype=np.int64)
        self.edges = np.r_[0, np.cumsum(self.sizes)]
        self.codes = np.fromiter((at[c] for o in own for c in o), dtype=np.int32, count=self.edges[-1])
        self.floors, self.last = floors, last

    @classmethod
    def of(cls, queries: pd.DataFrame) -> OverlapScorer | None:
        """Of queries, where ``floor`` and ``last`` may name score and id of the ``k``-th best found elsewhere."""
        if queries.empty:
            return None
        made = cls(queries["text"].tolist(), *[queries[c].to_numpy() for c in ("floor", "last") if c in queries])
        made.ids = queries["query_id"].to_numpy()
        return made

    @staticmethod
    def usable(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values("chunk_id", kind="stable")

    def top(self, run: slice, k: int) -> TopK:
        top = TopK(run.stop - run.start, k)
        if self.floors is not None:
            top.floor, top.last = self.floors[run].astype(np.float64), self.last[run].astype(np.int64)
        return top

    def encode(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have each character, and how many."""
        texts = frame["text"].tolist()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        codes = self.places[np.minimum(points, len(self.places) - 1)]
        present = np.zeros((self.width, len(texts)), dtype=np.uint8)
        present[codes[codes >= 0], owner[codes >= 0]] = 1
        return present, np.count_nonzero(present, axis=1)

    def offer(self, encoded: tuple[np.ndarray, np.ndarray], ids: np.ndarray, run: slice, top: TopK) -> None:
        present, often = encoded
        sizes, edges = self.sizes[run], self.edges[run.start:run.stop + 1]
        needs = np.where(ids[0] > top.last, top.floor + 1, top.floor) if len(ids) else np.full(len(sizes), np.inf)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q in np.flatnonzero(needs <= sizes):
            codes, need, rows = self.codes[edges[q]:edges[q + 1]], needs[q], None
            if need > 0:
                rarest = codes[np.argsort(often[codes], kind="stable")[:int(sizes[q] - need) + 1]]
                rows = np.flatnonzero(present[rarest].any(axis=0))
                if not len(rows):
                    continue
            narrow = rows is not None and 4 * len(rows) < len(ids)
            held = present[codes[:, None], rows] if narrow else present[codes]
            scores = np.add.reduce(held, axis=0, dtype=np.uint8 if len(codes) < 256 else np.uint32)
            best = np.flatnonzero(scores >= need)
            if len(best) > top.k:
                own = scores[best]
                best = best[own >= np.partition(own, len(own) - top.k)[len(own) - top.k]]
                # Rows come in the order of their ids, so a stable order by score is the final one.
                best = best[np.argsort(-scores[best].astype(np.int64), kind="stable")[:top.k]]
            if len(best):
                found.append((q, scores[best], rows[best] if narrow else best))
        if found:
            top.add(np.repeat([q for q, _, _ in found], [len(r) for _, _, r in found]),
                    np.concatenate([s for _, s, _ in found]).astype(np.float64), ids[np.concatenate([r for _, _, r in found])])


class SparseScorer(Scorer):
    """Inner product of sparse rows; pairs without a common token score minus infinity.

    Queries are taken 64 at a time, so the columns of a product are the tokens of 64 queries.
    """

    BLOCK = 64

    def __init__(self, rows: Sequence[tuple[Sequence[int], Sequence[float]]], digits: int = 6) -> None:
        self.width = len(rows)
        self.digits = digits
        self.blocks = []
        for start in range(0, self.width, self.BLOCK):
            part = rows[start:start + self.BLOCK]
            ids = [np.asarray(i, dtype=np.int64) for i, _ in part]
            tokens = np.unique(np.concatenate(ids))
            weights = np.zeros((len(tokens), len(part)))
            for q, (_, w) in enumerate(part):
                weights[np.searchsorted(tokens, ids[q]), q] = w
            self.blocks.append((start, tokens, weights, bool((weights >= 0).all())))

    @classmethod
    def of(cls, queries: pd.DataFrame) -> SparseScorer | None:
        held = cls.usable(queries)
        if held.empty:
            return None
        made = cls(list(zip(held["tokens"], held["weights"])))
        made.ids = held["query_id"].to_numpy()
        return made

    @staticmethod
    def usable(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[frame["tokens"].map(lambda t: t is not None and len(t) > 0).astype(bool)]

    def encode(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Tokens and weights of all rows, where each row has its own, and whether all weights are positive."""
        tokens = np.concatenate([np.asarray(t, dtype=np.int64) for t in frame["tokens"]])
        weights = np.concatenate([np.asarray(w, dtype=np.float64) for w in frame["weights"]])
        return tokens, weights, np.r_[0, np.cumsum(frame["tokens"].map(len).to_numpy())], bool((weights > 0).all())

    def score(self, encoded: tuple[np.ndarray, np.ndarray, np.ndarray, bool], some: slice) -> np.ndarray:
        tokens, weights, edges, positive = encoded
        count, sizes = len(edges) - 1, np.diff(edges)
        out = np.full((count, some.stop - some.start), -np.inf)
        for first, known, matrix, plain in self.blocks[some.start // self.BLOCK:-(-some.stop // self.BLOCK)]:
            start = first - some.start
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            hit = known[at] == tokens
            step = max(1, CELLS // len(known))
            for lo in range(0, count, step):
                hi = min(lo + step, count)
                cut = slice(edges[lo], edges[hi])
                owner = np.repeat(np.arange(hi - lo), sizes[lo:hi])[hit[cut]]
                rows = np.zeros((hi - lo, len(known)))
                rows[owner, at[cut][hit[cut]]] = weights[cut][hit[cut]]
                total = rows @ matrix
                # With positive weights a shared token shows in the product itself.
                shared = total > 0 if positive and plain else ((rows != 0) * 1.0) @ ((matrix != 0) * 1.0) > 0
                out[lo:hi, start:start + matrix.shape[1]] = np.where(shared, np.round(total, self.digits), -np.inf)
        return out


class TopK:
    """The best ``k`` of each query so far: highest score, then lowest id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.last = np.full(queries, NO_ID)
        self.q = np.zeros(0, dtype=np.int64)
        self.s = np.zeros(0)
        self.i = np.zeros(0, dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        n = len(ids)
        bar = self.floor
        if n >= self.k:
            bar = np.maximum(bar, np.partition(scores, n - self.k, axis=0)[n - self.k])
        rows, queries = np.nonzero((scores >= bar) & (scores > -np.inf))
        self.add(queries, scores[rows, queries], ids[rows])

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        q = np.concatenate([self.q, queries])
        s = np.concatenate([self.s, scores])
        i = np.concatenate([self.i, ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        last = place[keep] == self.k - 1
        self.floor[self.q[last]] = self.s[last]
        null = np.isnan(self.i[last])
        self.last[self.q[last][null]] = NO_ID
        self.last[self.q[last][~null]] = self.i[last][~null]


def best_of(frames: Iterator[pd.DataFrame], scorers: Mapping[str, Any], k: int) -> Iterator[pd.DataFrame]:
    """Scores of all frames of one task, reduced to ``k`` rows per kind and query."""
    runs = {kind: [slice(lo, min(lo + WIDTH, len(scorer.ids))) for lo in range(0, len(scorer.ids), WIDTH)] for kind, scorer in scorers.items()}
    tops = {kind: [scorers[kind].top(run, k) for run in own] for kind, own in runs.items()}
    for frame in frames:
        for kind, scorer in scorers.items():
            own = scorer.usable(frame)
            most = getattr(scorer, "rows", SLICE)
            lo, step = 0, min(SLICE, most)
            while lo < len(own):
                part = own.iloc[lo:lo + step]
                ids, encoded = part["chunk_id"].to_numpy(), scorer.encode(part)
                for run, top in zip(runs[kind], tops[kind]):
                    scorer.offer(encoded, ids, run, top)
                # Where the first slices rule out what follows, later ones may be larger.
                lo, step = lo + step, min(2 * step, most)
    for kind, own in tops.items():
        for run, top in zip(runs[kind], own):
            yield pd.DataFrame({"kind": kind, "query_id": scorers[kind].ids[run][top.q], "chunk_id": top.i, "score": top.s})
