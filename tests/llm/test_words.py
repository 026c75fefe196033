import re

import numpy as np
import pyarrow as pa

from tomeworks.llm import words as W

TEXTS = ["Ab cd\tAB  é x1", None, "", "  ", "one", "ends in blank \n", "a-b,c" * 3, "日本 語", "\x1c \x0b\x0c\r x"]


def _words(text: str | None, pattern: bytes) -> list[bytes]:
    raw = (text or "").encode()
    return re.findall(pattern, bytes(b + 32 if 65 <= b <= 90 else b for b in raw))


def test_words_and_hashes_follow_the_texts():
    for inside, pattern in ((W.NOT_BLANK, rb"[^\x20\x09-\x0D]+"), (W.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        want = [w for t in TEXTS for w in _words(t, pattern)]
        got, rows = [], []
        for run_bytes in (1, 7, 1 << 20):
            got, rows = [], []
            for first, offsets, data in W.runs(pa.array(TEXTS), run_bytes):
                h, r = W.word_hashes(offsets, data, inside)
                got += h.tolist()
                rows += (r + first).tolist()
            assert rows == [i for i, t in enumerate(TEXTS) for _ in _words(t, pattern)]
            by_word = {}
            for w, h in zip(want, got, strict=True):
                assert by_word.setdefault(w, h) == h
            assert len(set(by_word.values())) == len(by_word)


def test_sliced_and_empty_arrays():
    assert list(W.runs(pa.array([], pa.string()))) == []
    sliced = pa.array(TEXTS).slice(4, 2)
    (first, offsets, data), = W.runs(sliced)
    assert data.tobytes().decode() == "oneends in blank \n" and offsets.tolist() == [0, 3, 18]


def test_hash_table_finds_all_and_only_its_keys():
    keys = W.mix(np.arange(5000, dtype=np.uint64))
    table = W.HashTable(keys)
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(W.mix(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()
    assert (W.HashTable(keys[:0]).find(keys[:3]) == -1).all()
