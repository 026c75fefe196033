"""Size-bounded text splitting on a list of separators (the public recursive scheme).

``pieces_of`` is the column form that jobs use; ``split_to_size`` does the same to one string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeworks.functions.text import let, strip

# A piece, and whether it is finished or still to be cut by finer separators.
_ITEMS = "array<struct<text:string,done:boolean>>"


def _cut_before(text: str, sep: str) -> list[str]:
    """Pieces of ``text`` that each start with ``sep``, apart from the first."""
    head, *tail = text.split(sep)
    return ([head] if head else []) + [sep + t for t in tail]


def _pack(pieces: Sequence[str], limit: int) -> Iterator[str]:
    """Concatenate neighbours greedily up to ``limit`` characters."""
    start, used = 0, 0
    for i, piece in enumerate(pieces):
        if used and used + len(piece) > limit:
            yield "".join(pieces[start:i])
            start, used = i, 0
        used += len(piece)
    if start < len(pieces):
        yield "".join(pieces[start:])


def _pieces(text: str, limit: int, separators: Sequence[str]) -> Iterator[str]:
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1:]
    if not sep:
        yield from (text[i:i + limit] for i in range(0, len(text), limit))
        return
    small: list[str] = []
    for piece in _cut_before(text, sep):
        if len(piece) < limit:
            small.append(piece)
            continue
        yield from _pack(small, limit)
        small = []
        if finer:
            yield from _pieces(piece, limit, finer)
        else:
            yield piece
    yield from _pack(small, limit)


def split_to_size(text: str, limit: int, separators: Sequence[str]) -> list[str]:
    """Split on the first separator that occurs, pack the small pieces, and treat pieces that
    are still too long with the separators after it. An empty separator cuts anywhere."""
    stripped = (piece.strip() for piece in _pieces(text, limit, separators))
    return [piece for piece in stripped if piece]


def _item(text: Column, done: bool) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(done).alias("done")))


def _cut_and_pack(text: Column, sep: str, limit: Column) -> Column:
    """Cut before each ``sep``; neighbours below ``limit`` characters are joined up to it, longer pieces wait."""
    cut = F.split(text, re.escape(sep), -1)
    starting = F.transform(cut, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(sep), p)))
    zero = F.struct(F.array().cast(_ITEMS).alias("out"), F.lit("").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        flushed = F.when(acc["open"] == "", acc["out"]).otherwise(F.concat(acc["out"], _item(acc["open"], True)))
        too_long = F.length(piece) >= limit
        full = F.length(acc["open"]) + F.length(piece) > limit
        out = F.when(too_long, F.concat(flushed, _item(piece, False))).when(full, flushed).otherwise(acc["out"])
        left = F.when(too_long, F.lit("")).when(full, piece).otherwise(F.concat(acc["open"], piece))
        return F.struct(out.alias("out"), left.alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["out"]).otherwise(F.concat(acc["out"], _item(acc["open"], True)))

    return F.aggregate(starting, zero, add, finish)


def pieces_of(text: Column, limit: Column, separators: Sequence[str]) -> Column:
    """``split_to_size`` as an array column, without leaving the JVM.

    Every separator is one pass over what is still too long, so the cascade is a chain of as many
    nested expressions, whatever the text. Results are only joined when a piece is finished: the work
    grows with the text, not with the square of its pieces.
    """

    def step(items: Column, sep: str) -> Column:
        def cut(x: Column) -> Column:
            if not sep:
                anywhere = F.regexp_extract_all(x["text"], F.concat(F.lit("(?s).{1,"), limit.cast("string"), F.lit("}")), F.lit(0))
                return F.when(x["done"], F.array(x)).otherwise(F.transform(anywhere, lambda p: F.struct(p.alias("text"), F.lit(True).alias("done"))))
            return F.when(x["done"] | ~x["text"].contains(sep), F.array(x)).otherwise(_cut_and_pack(x["text"], sep, limit))

        return F.flatten(F.transform(items, cut))

    whole = let(text, lambda t: _item(t, False))
    return F.filter(F.transform(reduce(step, separators, whole), lambda x: strip(x["text"])), lambda t: t != "")
