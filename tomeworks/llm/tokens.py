"""Token counts and token ids of whole texts by public tokenizers, in Arrow batches.

Texts are taken in groups of about ``RUN_BYTES`` bytes, so that a batch costs the same whatever the
length of its texts, and long texts are cut at safe boundaries. For a byte-level tokenizer with the
usual word pattern, the places before a single space or on both sides of a single line break between
visible characters are safe: no token crosses them, in any text. What lies between repeats often, so
each task encodes every distinct piece once, many in a call, and keeps a bounded number of results. Texts
that hold a special string of the tokenizer, and all texts of other kinds of tokenizers, are encoded whole.

Null is the empty text, which has no tokens. Special strings inside texts are what the library takes
them for by default. Only counts leave Python unless ids are asked for.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.llm import words as W

RUN_BYTES = 4 << 20
#: Pieces whose ids a task keeps in each of two generations, and pieces in one call of the library.
KEPT_PIECES = 100_000
CALL_PIECES = 1024

_SAFE = re.compile(r"(?<=\S)(?= \S)")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ENDS = ".,;:!?"


def _uneven(text: str) -> bool:
    """Whether there is white space other than one space or line break between visible characters."""
    return (text[0] in " \n" or text[-1] in " \n" or any(p in text for p in _PAIRS) or any(c in text for c in _OTHER_SPACE))


def _shown_bytes() -> dict[int, str]:
    """The characters byte-level tokenizers show bytes as: visible Latin-1 ones stay, others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers, by a tokenizer file."""

    def __init__(self, path: str) -> None:
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.special: list[str] = []
        self.splits = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._call = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self._call = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        model.no_padding()
        model.no_truncation()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made.get("pre_tokenizer") or {}
        self.bpe, self.shown = model.model, _shown_bytes()
        self.space = self.shown[0x20]
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        self.splits = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not made.get("normalizer") and (made.get("model") or {}).get("type") == "BPE"

    def call(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), CALL_PIECES):
            out += [array("I", ids).tobytes() for ids in self._call(texts[i : i + CALL_PIECES])]
        return out

    def _lines(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without line breaks: joined by line breaks, which are tokens of their own."""
        out: list[bytes] = []
        for i in range(0, len(pieces), CALL_PIECES):
            some = pieces[i : i + CALL_PIECES]
            ids = np.array(self._call(["\n".join(some)])[0], dtype="<u4")
            breaks = np.flatnonzero(ids == self.newline)
            if len(breaks) != len(some) - 1:
                out += self.call(some)
                continue
            raw, cuts = ids.tobytes(), (4 * breaks).tolist()
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])]
        return out

    def _word(self, piece: str) -> bytes | None:
        """Ids of a piece that is one word, with a mark after it or not; None for other pieces."""
        end = b""
        if piece[-1:] in self.ends:  # a letter and a mark are never in one token
            end, piece = self.ends[piece[-1]], piece[:-1]
            known = self.held.get(piece) or self.older.get(piece)
            if known is not None and piece[-1:].isalpha():
                return known + end
        lead, word, shown = (self.line, piece[1:], "") if piece[:1] == "\n" else (b"", piece, self.space)
        if not word.isalpha():
            return None
        shown += word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        ids = lead + array("I", [t.id for t in self.bpe.tokenize(shown)]).tobytes()
        if end:
            self.held[piece] = ids
        return ids + end

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces: a line break and a word, or a word that follows a space."""
        if not self.ends:
            self.ends = dict(zip(_ENDS, self.call(list(_ENDS))))
            self.line = self.call(["\n"])[0]
            self.newline = np.frombuffer(self.line, dtype="<u4")[0]
        if len(self.held) > KEPT_PIECES:
            self.older, self.held = self.held, {}
        known = list(map(self.held.get, pieces))
        hard = []
        for i, ids in enumerate(known):
            if ids is None:
                piece = pieces[i]
                ids = self.older.get(piece) or self._word(piece)
                if ids is None:
                    hard.append(i)
                else:
                    self.held[piece] = known[i] = ids
        for lead, before, own in ((self.line, "", [i for i in hard if pieces[i][:1] == "\n"]), (b"", " ", [i for i in hard if pieces[i][:1] != "\n"])):
            for i, ids in zip(own, self._lines([before + pieces[i].removeprefix("\n") for i in own])):
                self.held[pieces[i]] = known[i] = lead + ids
        return known

    def encode(self, texts: list[str], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of tokens of each text, and if asked for the ids of all texts one after another."""
        kinds = [0 if not t else 1 if not self.splits or any(s in t for s in self.special) else 2 if _uneven(t) else 3 for t in texts]
        counts = np.zeros(len(texts), dtype=np.int64)
        parts: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * len(texts)
        for i, kind in enumerate(kinds):
            if kind in (1, 2):
                raw = b"".join(self.call([texts[i]] if kind == 1 else _SAFE.split(texts[i])))
                parts[i] = np.frombuffer(raw, dtype="<u4")
                counts[i] = len(parts[i])
        even = [i for i, kind in enumerate(kinds) if kind == 3]
        if even:
            # a text begins like a line; the break put before it is taken off again
            cut = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in even], type=pa.large_string()), " ")
            coded = cut.flatten().dictionary_encode()
            known = self._known(coded.dictionary.to_pylist())
            sizes = np.array([len(k) // 4 for k in known], dtype=np.int64)
            which = coded.indices.to_numpy()
            starts = cut.offsets.to_numpy()[:-1]
            each = sizes[which]
            n = np.add.reduceat(each, starts)
            counts[even] = n - 1
            if with_ids:
                flat = np.frombuffer(b"".join(known), dtype="<u4")
                at = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                ids = flat[at]
                ends = np.cumsum(n)
                for i, a, b in zip(even, (ends - n + 1).tolist(), ends.tolist()):
                    parts[i] = ids[a:b]
        return counts, np.concatenate(parts) if with_ids and parts else None


def grouped(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[list[str]]:
    """Texts in groups of about equal bytes."""
    for row, offsets, _ in W.runs(column, run_bytes):
        yield [t or "" for t in column.slice(row, len(offsets) - 1).to_pylist()]


def n_tokens(text: Column | str, path: str) -> Column:
    """Number of tokens of a text column by the tokenizer file at ``path``, which every worker can read."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for texts_ in batches:
            counts = [encoder.encode(texts, with_ids=False)[0] for texts in grouped(texts_)]
            yield pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *counts]))
        del encoder
        W.release()

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(count, "bigint")(text)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; columns of these names are replaced."""
    kept = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    out = df.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), n_tokens(text, path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
