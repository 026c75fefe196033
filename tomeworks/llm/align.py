"""Alignment of two tokenizers' tokens, by lockstep merging of many documents at once.

A text is encoded by a byte-level tokenizer (A, as a space and the text) and by a piece tokenizer (B, which
adds the space itself). Where a token of A and one of B end at the same byte, the text is cut into groups; a
link is a pair of token occurrences, one of A and one of B, in the same group.

Texts are cut into units before a single space or line break between visible characters. Neither tokenizer
has a token across such a place, so a unit's ids do not depend on its neighbours, and every task encodes a
unit that recurs only once. Stretches of ``LANE_UNITS`` units are the lanes of the merge. All lanes of some
documents move together: one state vector holds each lane's place in A, its place in B and where its
open group began. In a step the side whose token ends first moves on; where both end together, the step
emits the group, a cut and the links between all its tokens. Lanes that are finished leave the vector.

How many documents hold an id pair linked is summed per task, then by Spark. The counts are broadcast in
blocks of at most ``block_pairs`` pairs, each a map-only pass over the pairs of every document, which are
kept as packed arrays. Neither texts nor documents' links are shuffled.

Edge cases: texts that are null or empty, or of which the joined bytes of a tokenizer's tokens are not the
space and the text (a U+2581 in it, say), have no tokens: all numbers are 0 and the digest is ''. Strings of
special tokens are plain text. Repeated rows are documents of their own. Columns named like the results
are replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeworks.llm import words as W
from tomeworks.llm.tokens import _shown_bytes
from tomeworks.operators.settle import settle

#: Bytes of texts merged together, and rows of an Arrow batch.
RUN_BYTES, BATCH_ROWS = 2 << 20, 1000
LANE_UNITS = 64
#: Units whose ids a task keeps in each of two generations, and units in one call of a library.
KEPT_UNITS, CALL_UNITS = 100_000, 4096
#: Links written out at once; groups with more are counted by distinct ids.
SOME_LINKS = 4 << 20
#: Pairs a task sums up before it hands them on.
SUM_PAIRS = 4 << 20

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: White space next to a space or line break, or one of these at an end: not every one of them is a cut then.
_UNEVEN = rf"\A[ \n]|[ \n]\z|[{_SPACES}][ \n]|[ \n][{_SPACES}]"

RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


class Pair:
    """Both tokenizers: ids of units, and the bytes of ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {shown: byte for byte, shown in _shown_bytes().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        self.held: dict[str, tuple[bytes, bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bytes, bool]] = {}

    def ids_a(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """A unit begins with the space that the tokenizer adds, or with a line break, before which it adds one."""
        coded = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [ids if u[0] == " " else ids[1:] for u, ids in zip(units, coded)]

    def spells(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw

    def known(self, units: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of distinct units in A and B, and whether both spell the unit."""
        if len(self.held) > KEPT_UNITS:
            self.older, self.held = self.held, {}
        found = list(map(self.held.get, units))
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = self.older.get(units[i])
                if ids is None:
                    new.append(i)
                else:
                    self.held[units[i]] = found[i] = ids
        for first in range(0, len(new), CALL_UNITS):
            some = new[first : first + CALL_UNITS]
            own = [units[i] for i in some]
            coded_a, coded_b = self.ids_a(own), self.ids_b(own)
            raw = "".join(own).encode()
            spelt = all(b"".join(map(table.__getitem__, chain.from_iterable(coded))) == raw for table, coded in ((self.bytes_a, coded_a), (self.bytes_b, coded_b)))
            for i, u, a, b in zip(some, own, coded_a, coded_b):
                same = spelt or self.spells(u.encode(), a, b)
                self.held[u] = found[i] = array("I", a).tobytes(), array("I", b).tobytes(), same
        return found


def units_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units of a space and each text, the units of all texts in order, and how many each has."""
    n = len(texts)
    counts = np.zeros(n, dtype=np.int64)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    number: dict[str, int] = {}
    parts: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * n
    for i in np.flatnonzero(uneven & ~empty).tolist():
        parts[i] = np.array([number.setdefault(u, len(number)) for u in _CUT.split(" " + texts[i].as_py())], dtype=np.int64)
        counts[i] = len(parts[i])
    even = np.flatnonzero(~uneven & ~empty)
    if len(even):
        cut = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        # after the replacement a unit that begins with a line break has no other space before it
        own = np.array([number.setdefault(p if p[:1] == "\n" else " " + p, len(number)) for p in coded.dictionary.to_pylist()], dtype=np.int64)
        which, bounds = own[coded.indices.to_numpy()], cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        for i, a, b in zip(even.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            parts[i] = which[a:b]
        counts[even] = np.diff(bounds)
    return list(number), np.concatenate([np.zeros(0, dtype=np.int64), *parts]), counts


def _spread(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of units ``which``, one after another."""
    each = sizes[which]
    starts = (np.cumsum(sizes) - sizes)[which]
    return flat[np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(each.sum())]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, last_a: np.ndarray) -> np.ndarray:
    """Groups ``(first token of A, past the last, first token of B, past the last)`` in order of tokens.

    ``end_a`` and ``end_b`` are the byte offsets where tokens end; lane i begins at tokens ``first_a[i]`` and
    ``first_b[i]`` and ends before token ``last_a[i]`` of A, where a token of B ends too.
    """
    some = first_a < last_a
    a, b, last = first_a[some], first_b[some], last_a[some]
    from_a, from_b = a.copy(), b.copy()
    out: list[np.ndarray] = []
    while len(a):
        at_a, at_b = end_a[a], end_b[b]
        cut = at_a == at_b
        a, b = a + (at_a <= at_b), b + (at_b <= at_a)
        out.append(np.stack([from_a[cut], a[cut], from_b[cut], b[cut]]))
        from_a, from_b = np.where(cut, a, from_a), np.where(cut, b, from_b)
        going = a < last
        if not going.all():
            a, b, last, from_a, from_b = (x[going] for x in (a, b, last, from_a, from_b))
    groups = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
    return groups[:, np.argsort(groups[0])]


def _digits() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.arange(1 << 17)
    sizes = 1 + sum((numbers >= 10**p).astype(np.int64) for p in range(1, 6))
    shown = np.stack([(numbers // 10 ** np.maximum(sizes - 1 - p, 0)) % 10 + 48 for p in range(6)], axis=1).astype(np.uint8)
    return shown, sizes


_SHOWN, _SHOWN_SIZES = _digits()


def written(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, group_docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """All groups as text, ``a1,a2|b1;a3|b2,b3`` for each document, and the documents' offsets in it."""
    a0, a1, b0, b1 = groups
    n = len(ids_a) + len(ids_b)
    ids, ends = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
    ids[np.arange(len(ids_a)) + np.repeat(b0, a1 - a0)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(a1, b1 - b0)] = ids_b
    ends[a1 + b0 - 1], ends[a1 + b1 - 1] = ord("|"), ord(";")
    sizes = _SHOWN_SIZES[ids] + 1
    past = np.cumsum(sizes)
    starts = past - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint8)
    for p in range(_SHOWN.shape[1]):
        long = np.flatnonzero(sizes > p + 1)
        out[starts[long] + p] = _SHOWN[ids[long], p]
    out[past - 1] = ends
    tokens = np.concatenate([[0], np.cumsum(np.bincount(group_docs, weights=a1 - a0 + b1 - b0, minlength=n_docs).astype(np.int64))])
    return out, np.concatenate([[0], past])[tokens]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def link_pairs(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, group_docs: np.ndarray, n_ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document the distinct linked id pairs, ``a * n_ids_b + b``, with their number of links."""
    a0, a1, b0, b1 = groups
    links = (a1 - a0) * (b1 - b0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    small = np.flatnonzero(links <= SOME_LINKS)
    chunk = (np.cumsum(links[small]) - 1) // SOME_LINKS if len(small) else small
    for part in np.split(small, np.flatnonzero(np.diff(chunk)) + 1):
        if not len(part):
            continue
        each, wide = links[part], (b1 - b0)[part]
        group = np.repeat(np.arange(len(part)), each)
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        pairs = ids_a[a0[part][group] + k // wide[group]].astype(np.int64) * n_ids_b + ids_b[b0[part][group] + k % wide[group]]
        docs = group_docs[part][group]
        order = np.lexsort((pairs, docs))
        docs, pairs = docs[order], pairs[order]
        first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])]))
        found.append((docs[first], pairs[first], np.diff(np.concatenate([first, [len(docs)]]))))
    for g in np.flatnonzero(links > SOME_LINKS).tolist():
        ua, ca = np.unique(ids_a[a0[g] : a1[g]], return_counts=True)
        ub, cb = np.unique(ids_b[b0[g] : b1[g]], return_counts=True)
        found.append((np.full(len(ua) * len(ub), group_docs[g]), (ua.astype(np.int64)[:, None] * n_ids_b + ub).ravel(), (ca[:, None] * cb).ravel()))
    if len(found) == 1:
        return found[0]
    docs, pairs, times = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3
    order = np.lexsort((pairs, docs))
    docs, pairs, times = docs[order], pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])])) if len(docs) else docs
    return docs[first], pairs[first], np.add.reduceat(times, first) if len(first) else times


@dataclass
class Aligned:
    """Of some documents: numbers, digests, and the packed id pairs with their number of links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    pairs: list[bytes]
    times: list[bytes]


def align(pair: Pair, texts: pa.Array) -> Aligned:
    n = len(texts)
    units, which, counts = units_of(texts)
    known = pair.known(units)
    spelt = np.array([k[2] for k in known], dtype=bool)
    doc_of_unit = np.repeat(np.arange(n), counts)
    wrong = np.bincount(doc_of_unit[~spelt[which]], minlength=n) > 0
    keep = ~wrong[doc_of_unit]
    which, doc_of_unit = which[keep], doc_of_unit[keep]
    counts = np.where(wrong, 0, counts)
    sizes_a, sizes_b = (np.array([len(k[side]) // 4 for k in known], dtype=np.int64) for side in (0, 1))
    flat_a, flat_b = (np.frombuffer(b"".join([k[side] for k in known]), dtype="<u4") for side in (0, 1))
    ids_a, ids_b = _spread(flat_a, sizes_a, which), _spread(flat_b, sizes_b, which)
    # offsets go on from document to document, on both sides by the same bytes
    end_a, end_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
    past_a, past_b = (np.concatenate([[0], np.cumsum(s[which])]) for s in (sizes_a, sizes_b))
    first_units = np.cumsum(counts) - counts
    in_doc = np.arange(len(which)) - first_units[doc_of_unit]
    lanes = np.flatnonzero(in_doc % LANE_UNITS == 0)
    groups = lockstep(end_a, end_b, past_a[lanes], past_b[lanes], np.concatenate([past_a[lanes[1:]], past_a[-1:]]) if len(lanes) else lanes)
    doc_ends = past_a[np.cumsum(counts)]
    group_docs = np.searchsorted(doc_ends, groups[0], side="right")
    n_a, n_b = (np.bincount(doc_of_unit, weights=s[which], minlength=n).astype(np.int64) for s in (sizes_a, sizes_b))
    text, at = written(ids_a, ids_b, groups, group_docs, n)
    raw = memoryview(text)
    digests = [hashlib.sha256(raw[s : e - 1]).hexdigest() if s < e else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
    docs, pairs, times = link_pairs(ids_a, ids_b, groups, group_docs, len(pair.size_b))
    cuts = np.searchsorted(docs, np.arange(n + 1)).tolist()
    pairs, times = pairs.astype("<u4" if len(pair.size_a) * len(pair.size_b) <= 1 << 32 else "<u8"), times.astype("<u4")
    links = (groups[1] - groups[0]) * (groups[3] - groups[2])
    return Aligned(n_a, n_b, np.bincount(group_docs, minlength=n), np.bincount(group_docs, weights=links, minlength=n).astype(np.int64), digests,
                   [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], [times[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _aligned_rows(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """The columns before the last, the text, and the results of the merge."""
    pair = Pair(path_a, path_b)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for first, offsets, _ in W.runs(column, RUN_BYTES):
            n = len(offsets) - 1
            made = align(pair, column.slice(first, n).cast(pa.large_string()))
            kept = [batch.column(c).slice(first, n) for c in range(batch.num_columns - 1)]
            numbers = [pa.array(x, type=pa.int64()) for x in (made.n_a, made.n_b, made.n_groups, made.n_links)]
            packed = [pa.array(x, type=pa.binary()) for x in (made.pairs, made.times)]
            names = [f"c{i}" for i in range(len(kept) + 7)]
            yield pa.RecordBatch.from_arrays([*kept, *numbers, pa.array(made.digests), *packed], names=names)
    del pair
    W.release()


def _pair_rows(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """In how many documents of the task each pair is linked."""
    keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    waiting: list[np.ndarray] = []
    size = 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "docs"])

    for batch in batches:
        for raw in batch.column(0):
            own = np.frombuffer(raw.as_buffer(), dtype=kind)
            waiting.append(own)
            size += len(own)
            if size >= SUM_PAIRS:
                more, times = np.unique(np.concatenate(waiting), return_counts=True)
                keys, counts = _summed(np.concatenate([keys, more.astype(np.int64)]), np.concatenate([counts, times]))
                waiting, size = [], 0
                if len(keys) >= SUM_PAIRS:
                    yield rows()
                    keys, counts = keys[:0], counts[:0]
    if waiting:
        more, times = np.unique(np.concatenate(waiting), return_counts=True)
        keys, counts = _summed(np.concatenate([keys, more.astype(np.int64)]), np.concatenate([counts, times]))
    if len(keys):
        yield rows()
    W.release()


def _looked_up(sent, kind: str, pairs: str, times: str) -> Column:
    """Struct of the best links and the sum of counts, as far as the broadcast pairs go."""

    def look_up(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        keys, docs, top = sent.value
        for raw, raw_times in batches:
            n_best, count_sum = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
            for i, (p, t) in enumerate(zip(raw, raw_times)):
                own, links = np.frombuffer(p.as_buffer(), dtype=kind), np.frombuffer(t.as_buffer(), dtype="<u4").astype(np.int64)
                if len(own) and len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    here = keys[at] == own
                    n_best[i], count_sum[i] = links[here & top[at]].sum(), (links * docs[at])[here].sum()
            yield pa.StructArray.from_arrays([pa.array(n_best), pa.array(count_sum)], names=["n_best", "count_sum"])

    look_up.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(look_up, "n_best bigint, count_sum bigint")(pairs, times)


def alignment(df: DataFrame, path_a: str, path_b: str, text: str = "text", *, block_pairs: int = 4 << 20) -> DataFrame:
    """``df`` without ``text`` and with ``RESULTS``; the tokenizer files are readable by every worker."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in {text, *RESULTS}]
    pairs, times = _free("_pairs", kept), _free("_times", kept)
    found = _free("_found", kept)
    whole = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(_free("_text", kept)))
    numbers = [T.StructField(name, T.LongType()) for name in RESULTS[:4]]
    schema = T.StructType([*whole.schema.fields[:-1], *numbers, T.StructField("groups_sha256", T.StringType()),
                           T.StructField(pairs, T.BinaryType()), T.StructField(times, T.BinaryType())])
    asked = settle(whole.mapInArrow(lambda batches: _renamed(_aligned_rows(batches, path_a, path_b), schema.names), schema), BATCH_ROWS)
    import sentencepiece
    from tokenizers import Tokenizer

    n_ids_a = Tokenizer.from_file(path_a).get_vocab_size(with_added_tokens=True)
    n_ids_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    kind = "<u4" if n_ids_a * n_ids_b <= 1 << 32 else "<u8"
    counted = asked.select(pairs).mapInArrow(lambda batches: _pair_rows(batches, kind), "pair bigint, docs bigint").groupBy("pair").agg(
        F.sum("docs").alias("docs"))
    # an id of A is linked with at most all ids of B, so no window is longer than that
    best = F.col("docs") == F.max("docs").over(Window.partitionBy(F.floor(F.col("pair") / n_ids_b)))
    counts = settle(counted.select("pair", "docs", best.alias("top")))
    blocks = max(1, -(-counts.count() // block_pairs))
    for i in range(blocks):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).toArrow()
        keys, docs, top = (own.column(c).to_numpy() for c in range(3))
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order].astype(kind), docs[order], top[order]))
        del own, keys, docs, top, order
        before = {name: F.col(name) if i else F.lit(0).cast("bigint") for name in RESULTS[5:]}
        with_found = asked.withColumn(found, _looked_up(sent, kind, pairs, times))
        added = with_found.select(*kept, *RESULTS[:5], pairs, times, *[(before[n] + F.col(f"{found}.{n}")).alias(n) for n in before])
        asked = settle(added) if i + 1 < blocks else added
    return asked.select(*kept, *RESULTS)


def _renamed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.rename_columns(names)
