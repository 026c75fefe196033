"""Near-duplicates by weighted MinHash signatures of hashed darts.

A text is a weighted set: its elements are the shingles of five words, an element's weight the number
of its occurrences. Each element owns the region [0, weight) x [0, rank); a Poisson process with one
dart per unit of area throws the same hashed darts into that region in every text that has the element.
Only darts up to a rank are thrown, chosen so that about ``k * (ln k + 2)`` hit the text; each dart
goes to one of k coordinates, and the earliest (smallest rank) of each coordinate is the signature.
Texts with a coordinate still empty get twice the rank again. Two signatures agree in a coordinate with
the probability of the weighted Jaccard similarity, and the work for a text of n shingles is n + k log k.

Banded joining: texts that agree in all ``per_band`` coordinates of a band share a bucket; a pair of
similarity s does with probability 1 - (1 - s^per_band)^bands, 0.99995 at 0.8. Texts of equal words are
folded into one before that, so copies are never paired. In a bucket every text is compared with one
pivot only, exactly, on the shingles themselves, so the comparisons grow with the texts and not with the
pairs of a group. A text that this leaves in another class than its pivot is compared exactly with every
text of that pivot, in blocks (``_link_rest``).

Words are lower-cased runs of letters and digits. Texts of one to four words are one shingle; null
and wordless texts are in a class of their own, each. A null id counts as larger than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.llm import words as W
from tomeworks.llm.columns import sheltered
from tomeworks.llm.decontam import gram_hashes, whole
from tomeworks.llm.exact import member_filter, member_test
from tomeworks.llm.graph import components
from tomeworks.operators.sampling import join_counted
from tomeworks.operators.settle import settle

U = np.uint64
SHINGLE = 5
#: Texts handled at once: each throws about k * (ln k + 2) darts, however short it is.
RUN_TEXTS = 200
#: Bytes of text handled at once.
RUN_BYTES = 512 << 10
#: Texts, or pairs of their shingle sets, in one Arrow batch.
TEXT_BATCH = 500
#: Texts of one pivot in a block, and bytes of their differing cells, about.
BLOCK_TEXTS = 400
BLOCK_BYTES = 1 << 20
#: Pairs of blocks in one Arrow batch.
BLOCK_BATCH = 50
#: Differing cells that two blocks are compared by at once.
COLUMNS = 2048


def shingles(words: np.ndarray, rows: np.ndarray, n: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their rows, in order of rows."""
    inside = whole(rows, size)
    grams, at = gram_hashes(words, size)[inside], rows[: len(inside)][inside]
    counts = W.row_counts(rows, n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ends = starts[short + 1] - 1
        whole_text = words[starts[short]]
        for i in range(1, size - 1):
            more = starts[short] + i <= ends
            whole_text[more] = W.chain(whole_text[more], words[starts[short][more] + i])
        grams, at = np.concatenate([grams, W.mix(whole_text + U(size))]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        grams, at = grams[order], at[order]
    return grams, at


def cells(grams: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of the weight axis: (element, 0), (element, 1), ... up to its weight."""
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    number = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    return W.chain(grams, number.astype(U)), rows


def signatures(cell: np.ndarray, rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """The earliest rank per row and coordinate; rows without cells stay infinite."""
    sketch = np.full(n * k, np.inf)
    weight = W.row_counts(rows, n)
    limit = (np.log(k) + 2) * k / np.maximum(weight, 1)
    while len(cell):
        _throw(cell, rows, limit, sketch, k)
        lacking = (weight > 0) & np.isinf(sketch.reshape(n, k)).any(axis=1)
        again = lacking[rows]
        cell, rows = cell[again], rows[again]
        limit = limit * 2
    return sketch.reshape(n, k)


def _throw(cell: np.ndarray, rows: np.ndarray, limit: np.ndarray, sketch: np.ndarray, k: int) -> None:
    """Throw all darts of rank up to each row's limit. The rank axis is cut into unit cells too, each
    with its own arrivals, so that the darts of a cell do not depend on the text."""
    many = np.ceil(limit[rows]).astype(np.int64)
    total = many.sum()
    start = np.repeat(np.cumsum(many) - many, many)
    base = (np.arange(total) - start).astype(np.float64)
    h = W.chain(np.repeat(cell, many), base.astype(U))
    row = np.repeat(rows, many)
    room = np.minimum(limit[row] - base, 1.0)
    time, turn = np.zeros(len(h)), 0
    while len(h):
        h = W.mix(h + U(0x9E3779B97F4A7C15))
        time = time - np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        hit = time < room
        h, time, base, row, room = h[hit], time[hit], base[hit], row[hit], room[hit]
        at = row * k + (W.mix(h ^ U(0xA5A5A5A5A5A5A5A5)) % U(k)).astype(np.int64)
        np.minimum.at(sketch, at, base + time)
        turn += 1


def text_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's word sequence."""
    counts = W.row_counts(rows, n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    place = (np.arange(len(words)) - starts[rows]).astype(U)
    filled = np.flatnonzero(counts)
    out = []
    for seed in (1, 2):
        one = W.mix(W.chain(words, place) + U(seed * 7919))
        sums = np.zeros(n, dtype=U)
        if len(filled):
            sums[filled] = np.add.reduceat(one, starts[filled])
        out.append(W.mix(sums + counts.astype(U)).view(np.int64))
    return out[0], out[1]


_FEATURES = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _features(bands: int, per_band: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        k = bands * per_band
        for array in batches:
            parts = [pa.array([], type=_FEATURES)]
            for _, offsets, data in W.runs(array, RUN_BYTES, RUN_TEXTS):
                n = len(offsets) - 1
                words, rows = W.word_hashes(offsets, data, W.ALNUM)
                h1, h2 = text_hashes(words, rows, n)
                sketch = signatures(*cells(*shingles(words, rows, n)), n, k).view(U).reshape(n, bands, per_band)
                key = np.broadcast_to(W.mix(np.arange(bands, dtype=U)), (n, bands))
                for i in range(per_band):
                    key = W.chain(key, sketch[:, :, i])
                used = W.row_counts(rows, n) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used * bands)]), type=pa.int32()), pa.array(key[used].ravel().view(np.int64)))
                parts.append(pa.StructArray.from_arrays([pa.array(h1), pa.array(h2), lists], fields=list(_FEATURES)))
            yield pa.concat_arrays(parts)
        W.release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "h1 bigint, h2 bigint, bands array<bigint>")


def _cell_sets(wanted):
    """Two hashes and the cells of each text that ``wanted`` (see ``member_test``) lets through by its key hash;
    null for the others. One function, so that a task has one Python worker."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("cells", pa.binary())])
        test = wanted()
        for keys, array in batches:
            some = test(keys)
            out: list[dict | None] = [None] * len(array)
            places = np.flatnonzero(some)
            for first, offsets, data in W.runs(array.filter(pa.array(some))):
                n = len(offsets) - 1
                words, rows = W.word_hashes(offsets, data, W.ALNUM)
                h1, h2 = text_hashes(words, rows, n)
                cell, at = cells(*shingles(words, rows, n))
                cell = cell[np.lexsort((cell, at))]
                cuts = np.concatenate([[0], np.cumsum(W.row_counts(at, n))]) * 8
                raw = cell.tobytes()
                for i, a, b, c, d in zip(places[first : first + n].tolist(), h1.tolist(), h2.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    out[i] = {"h1": a, "h2": b, "cells": raw[c:d]}
            yield pa.array(out, type=kind)
        W.release()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # non-deterministic, so that no filter on a result evaluates it a second time
    return F.arrow_udf(run, "h1 bigint, h2 bigint, cells binary").asNondeterministic()


def _jaccard():
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.empty(len(left))
        (at, data), (with_at, with_data) = W.texts(left), W.texts(right)
        for i in range(len(out)):
            both = np.concatenate([data[at[i] : at[i + 1]], with_data[with_at[i] : with_at[i + 1]]]).view(U)
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = shared / (len(both) - shared)
        W.release()
        return pa.array(out)

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def _differences():
    """The cells that only one of two sets has."""
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        (at, data), (with_at, with_data) = W.texts(left), W.texts(right)
        for i in range(len(left)):
            both = np.concatenate([data[at[i] : at[i + 1]], with_data[with_at[i] : with_at[i + 1]]]).view(U)
            both.sort()
            twice = np.zeros(len(both) + 1, dtype=bool)
            twice[1:-1] = both[1:] == both[:-1]
            out.append(both[~(twice[1:] | twice[:-1])].tobytes())
        W.release()
        return pa.array(out, type=pa.binary())

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")


def shared_counts(left: np.ndarray, left_rows: np.ndarray, n: int, right: np.ndarray, right_rows: np.ndarray, m: int) -> np.ndarray:
    """How many cells each of n sets shares with each of m sets."""
    keys = np.intersect1d(left, right)
    out = np.zeros((n, m), dtype=np.int64)
    sides = []
    for cell, rows in ((left, left_rows), (right, right_rows)):
        at = np.minimum(np.searchsorted(keys, cell), max(len(keys) - 1, 0))
        hit = keys[at] == cell if len(keys) else np.zeros(len(cell), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], rows[hit][order]))
    for low in range(0, len(keys), COLUMNS):
        high = min(low + COLUMNS, len(keys))
        dense = []
        for (at, rows), size in zip(sides, (n, m)):
            part = slice(*np.searchsorted(at, [low, high]))
            one = np.zeros((size, high - low), dtype=np.float32)
            one[rows[part], at[part] - low] = 1
            dense.append(one)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """As many links (row, column) of the matrix as connect the same rows and columns."""
    out: list[tuple[int, int]] = []
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    while rows.any():
        ahead = [(int(np.argmax(rows)), True)]
        rows[ahead[0][0]] = False
        while ahead:
            at, is_row = ahead.pop()
            new = np.flatnonzero(linked[at] & columns) if is_row else np.flatnonzero(linked[:, at] & rows)
            (columns if is_row else rows)[new] = False
            for other in new.tolist():
                out.append((at, other) if is_row else (other, at))
                ahead.append((other, not is_row))
    return out


def _block_links(similarity: float):
    """Links between the components of two blocks of texts of one pivot, from every pair of their texts."""
    def unpack(block: pa.Array) -> tuple[np.ndarray, ...]:
        (at, data), n = W.texts(block.field("cells")), len(block)
        cell = np.frombuffer(data[at[0] : at[-1]].tobytes(), dtype=U)
        differing = np.diff(at) // 8
        return block.field("label").to_numpy(), block.field("size").to_numpy(), differing, cell, np.repeat(np.arange(n), differing)

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out: list[list[dict[str, int]]] = []
        for one, other in zip(left, right):
            label, size, differing, cell, rows = unpack(one.values)
            with_label, with_size, with_differing, with_cell, with_rows = unpack(other.values)
            shared = shared_counts(cell, rows, len(label), with_cell, with_rows, len(with_label))
            sizes = size[:, None] + with_size
            # what is in one text and not the other is what is in one difference from the pivot and not the other
            both = (sizes - (differing[:, None] + with_differing - 2 * shared)) // 2
            linked = (both / (sizes - both) >= similarity) & (label[:, None] != with_label)
            out.append([{"a": int(label[i]), "b": int(with_label[j])} for i, j in _spanning(linked)])
        W.release()
        return pa.array(out, type=pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<a:bigint,b:bigint>>")


def _pairs(buckets: DataFrame, pivots: DataFrame) -> DataFrame:
    """``(bucket, node, pivot)`` for the nodes that are not their bucket's pivot; ``pivots`` has
    ``bucket``, ``pivot`` and the bucket's size ``_n``."""
    return join_counted(buckets, pivots, "bucket", "_n", F.col("node")).where("node <> pivot").select("bucket", "node", "pivot")


def _middles(buckets: DataFrame) -> DataFrame:
    """The pivot of each bucket is the node that meets most others in its buckets: those in the middle
    of a group link most of it."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("_n"))
    met = join_counted(buckets, sizes, "bucket", "_n", F.col("node")).groupBy("node").agg(F.sum("_n").alias("_met"))
    best = F.max(F.struct("_met", F.xxhash64("node"), "node"))["node"]
    return _pairs(buckets, buckets.join(met, "node").groupBy("bucket").agg(best.alias("pivot"), F.count("*").alias("_n")))


def _components_of(known: DataFrame, similarity: float) -> DataFrame:
    return settle(components(known.where(F.col("similarity") >= similarity).select(F.col("node").alias("a"), F.col("pivot").alias("b"))))


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the component of a node, itself if it has no link."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias("_label")).hint("merge")
    return df.join(named, node, "left").withColumn(name, F.coalesce("_label", node)).drop("_label")


def _link_rest(known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The components, after every text in another component than its pivot's is compared with all texts of that pivot.

    Two texts of one bucket that are both in their pivot's component need no comparison; all others get
    one, so no link inside a bucket is missed. The texts of a pivot are cut into blocks of bounded size,
    and each pair of blocks is one row: |x - y| of two texts follows from the cells in which each differs
    from the pivot, which one matrix product counts for all pairs of two blocks.
    """
    labels = _components_of(known, similarity)
    told = _labelled(_labelled(known, labels, "node", "_c"), labels, "pivot", "_p").select("node", "pivot", F.col("_c").alias("label"), (F.col("_c") != F.col("_p")).alias("_apart"))
    told = settle(told)
    if not told.where("_apart").limit(1).count():
        return labels
    around = told.join(told.where("_apart").select("pivot").distinct().hint("merge"), "pivot", "left_semi")
    right = sets.select(F.col("node").alias("pivot"), F.col("cells").alias("_with"))
    differing = settle(around.join(sets.hint("merge"), "node").join(right.hint("merge"), "pivot").select(
        "node", "pivot", "label", "_apart", (F.octet_length("cells") / 8).cast("bigint").alias("size"), _differences()("cells", "_with").alias("cells")), TEXT_BATCH)

    def blocks(rows, size):
        return F.greatest(F.ceil(rows / BLOCK_TEXTS), F.ceil(size / BLOCK_BYTES)).cast("int")

    room = F.octet_length("cells").cast("bigint")
    # at most as many as there are full blocks
    large = settle(differing.groupBy("pivot").agg(
        blocks(F.count("*"), F.sum(room)).alias("_all"), blocks(F.count_if("_apart"), F.sum(F.when(F.col("_apart"), room))).alias("_of_apart")).where("_all > 1"))
    dealt = differing.join(F.broadcast(large), "pivot", "left")
    text = F.collect_list(F.struct("label", "size", "cells"))

    def block_of(column):
        return F.pmod(F.xxhash64("node"), F.col(column)).cast("int")

    links = _block_links(similarity)
    small = dealt.where("_all IS NULL").groupBy("pivot").agg(text.alias("_left")).select(F.explode(links("_left", "_left")).alias("_l"))
    found = settle(small.select("_l.a", "_l.b").distinct(), BLOCK_BATCH)
    if large.limit(1).count():
        several = dealt.where("_all IS NOT NULL")
        left = settle(several.where("_apart").groupBy("pivot", block_of("_of_apart").alias("_i"), "_all").agg(text.alias("_left")))
        right = settle(several.groupBy("pivot", block_of("_all").alias("_j"), "_of_apart").agg(text.alias("_right")))
        # the place of a pair of blocks is its key, so that those of one pivot are spread
        left = left.select("pivot", "_i", F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("_j"), "_left")
        right = right.select("pivot", F.explode(F.sequence(F.lit(0), F.col("_of_apart") - 1)).alias("_i"), "_j", "_right")
        met = left.join(right.hint("merge"), ["pivot", "_i", "_j"]).select(F.explode(links("_left", "_right")).alias("_l"))
        found = found.unionByName(settle(met.select("_l.a", "_l.b").distinct(), BLOCK_BATCH))
    near = known.where(F.col("similarity") >= similarity).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return settle(components(near.unionByName(found)))


def classes(
    df: DataFrame, text: str = "text", key: str = "doc_id", *, similarity: float = 0.8, bands: int = 25, per_band: int = 5,
) -> DataFrame:
    """``df`` without ``text`` and with ``class_id`` (the smallest key of the class), ``class_size`` and
    ``kept`` (true for one row of each class) for every row; columns of these names are replaced.

    A class is a connected component of the links of at least ``similarity``.
    """
    df, (text, key), restore = sheltered(df, text, key, replaced=("class_id", "class_size", "kept"))
    others = [c for c in df.columns if c not in (text, key)]
    rows = settle(df.select(key, *others, _features(bands, per_band)(text).alias("_f")).select(
        key, *others, F.col("_f.h1").alias("_h1"), F.col("_f.h2").alias("_h2"), F.col("_f.bands").alias("_bands"),
        F.monotonically_increasing_id().alias("_row")), TEXT_BATCH)
    worded = rows.where(F.size("_bands") > 0)
    # one node per distinct text
    least = F.struct(F.col(key).isNull(), F.col(key).alias("id"), F.col("_row").alias("row"))
    nodes = settle(worded.groupBy("_h1", "_h2").agg(F.min(least).alias("_first"), F.count("*").alias("_n"), F.first("_bands").alias("_bands")).select(
        F.col("_first.row").alias("node"), F.col("_first.id").alias("_id"), "_h1", "_h2", "_n", "_bands"))
    buckets = nodes.select("node", F.explode("_bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    buckets = settle(join_counted(buckets, shared, "bucket", "_n", F.col("node")).select("bucket", "node"))
    wanted = settle(buckets.select("node").distinct().join(nodes, "node").select("node", "_id", "_h1", "_h2"))
    sets = settle(_fetch(df, text, key, wanted), TEXT_BATCH)

    pairs = _middles(buckets).select("node", "pivot").distinct()
    labels = _link_rest(settle(_compare(settle(pairs), sets), TEXT_BATCH), sets, similarity)
    member = _members(worded, nodes)
    member = member.join(labels, "node", "left").withColumn("_class", F.coalesce("label", "node"))
    member = member.select(key, *others, "_row", "_class").unionByName(
        rows.where(F.size("_bands") == 0).select(key, *others, "_row", F.col("_row").alias("_class")))
    found = member.groupBy("_class").agg(F.min(least).alias("_first"), F.count("*").alias("class_size"))
    return restore(join_counted(member, found, "_class", "class_size", F.col("_row")).select(
        key, *others, F.col("_first.id").alias("class_id"), "class_size", (F.col("_first.row") == F.col("_row")).alias("kept")))


def _members(worded: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of each row; texts with very many copies are dealt over several tasks."""
    pair = F.struct("_h1", "_h2")
    return join_counted(worded.withColumn("_pair", pair), nodes.select(pair.alias("_pair"), "_n", "node"), "_pair", "_n", F.col("_row"))


def _fetch(df: DataFrame, text: str, key: str, wanted: DataFrame) -> DataFrame:
    """``(node, cells)``: only rows that a bounded filter says may be wanted are read into shingles."""
    test = member_test(wanted.select(F.xxhash64("_id").alias("h")), wanted.count())
    maybe = df.select(F.col(key).alias("_id"), _cell_sets(test)(F.xxhash64(key), text).alias("_c")).where("_c IS NOT NULL")
    maybe = maybe.select("_id", F.col("_c.h1").alias("_h1"), F.col("_c.h2").alias("_h2"), F.col("_c.cells").alias("cells"))
    match = (maybe["_id"].eqNullSafe(wanted["_id"])) & (maybe["_h1"] == wanted["_h1"]) & (maybe["_h2"] == wanted["_h2"])
    return maybe.join(wanted, match).select("node", "cells").dropDuplicates(["node"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, pivot, similarity)``, exact."""
    left = pairs.join(sets.hint("merge"), "node")
    right = sets.select(F.col("node").alias("pivot"), F.col("cells").alias("_with"))
    return left.join(right.hint("merge"), "pivot").select("node", "pivot", _jaccard()("cells", "_with").alias("similarity"))


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows that stay, with their columns. Only rows that may have to go are shuffled."""
    df, (text, key), restore = sheltered(df, text, key)
    made = df.withColumn("_same", F.xxhash64(*df.columns))
    decided = classes(made.select(key, text, "_same"), text, key, **options).groupBy(F.col(key).alias("_id"), "_same").agg(
        F.bool_or("kept").alias("_stays"), F.bool_and("kept").alias("_all"))
    listed = settle(decided.where("NOT _all").select("_id", "_same", "_stays"))
    maybe = member_filter(listed.select(F.xxhash64("_id").alias("h")), listed.count(), F.xxhash64(key))
    marked = made.withColumn("_maybe", maybe)
    rest = marked.where("_maybe").drop("_maybe")
    match = rest[key].eqNullSafe(listed["_id"]) & (rest["_same"] == listed["_same"])
    untouched = rest.join(listed, match, "left_anti")
    once = rest.join(listed.where("_stays"), match, "left_semi").dropDuplicates([key, "_same"])
    return restore(marked.where("NOT _maybe").select(df.columns).unionByName(untouched.select(df.columns)).unionByName(once.select(df.columns)))
