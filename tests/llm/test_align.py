import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tomeworks.llm import align
from tomeworks.llm.queries import QUERIES, tokenizer

A, B = tokenizer(), tokenizer("piece_bpe_32k.model")
DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def pair():
    return align.Pair(A, B)


def plain_groups(pair, text):
    """Whole texts by both libraries; groups by sets of offsets."""
    if not text:
        return []
    whole = (" " + text).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    spelt_a = [pair.bytes_a[i] for i in a]
    spelt_b = [b" " * len(p) if (p := pair.b.id_to_piece(i)).strip("▁") == "" else bytes([int(p[3:5], 16)]) if pair.b.is_byte(i) else p.replace("▁", " ").encode() for i in b]
    if b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in spelt_a]).tolist(), np.cumsum([len(x) for x in spelt_b]).tolist()
    both = sorted(set(ends_a) & set(ends_b))
    groups, i, j = [], 0, 0
    for end in both:
        u, v = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:u], b[j:v]))
        i, j = u, v
    return groups


def plain(pair, texts):
    """The whole result: counts over all documents, then one row for each."""
    grouped = [plain_groups(pair, t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in grouped]
    docs = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for g, c in zip(grouped, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), c.total(), hashlib.sha256(shown.encode()).hexdigest() if g else "",
                    sum(n for p, n in c.items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in c.items())))
    return out


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\n", "\na", "a\n\nb", "tab\tand\r\nreturn", "été ﬁ", "日本語 テキスト\n次", "▁x y", "x ▁ y",
       "</s><s> <|endoftext|> done", "naïve café—dash", " no break", "don't we'll", "a\x00b \x1c c", "😀 👩‍👩‍👧 ok", "x" * 5000, "ab " * 3000, "1234567890 12 345",
       " line sep ", "tail;\r", "{\r\n}\r\n", "   deep   spaces   here   ", "Ã‰ ﻿ bom", "a　b 　 c", "!!! ... ,,, ???\n!!!"]


def test_texts_equal_the_libraries_on_whole_texts(pair):
    made = align.align(pair, pa.array(ODD, type=pa.large_string()))
    for i, text in enumerate(ODD):
        groups = plain_groups(pair, text)
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        assert (made.n_a[i], made.n_b[i], made.n_groups[i]) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups)), repr(text[:40])
        assert made.digests[i] == (hashlib.sha256(shown.encode()).hexdigest() if groups else ""), repr(text[:40])


def test_random_texts_equal_the_libraries(pair):
    draw = np.random.default_rng(2)
    signs = list("abcé日́ \n\t.,'1🙂") + ["  ", "the", "ing", "\r\n", "▁"]
    texts = ["".join(draw.choice(signs, size=int(draw.integers(1, 60)))) for _ in range(600)]
    made = align.align(pair, pa.array(texts, type=pa.large_string()))
    for i, text in enumerate(texts):
        groups = plain_groups(pair, text)
        assert (made.n_a[i], made.n_b[i], made.n_groups[i], made.n_links[i]) == (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(len(a) * len(b) for a, b in groups)), repr(text)


@pytest.mark.parametrize("lane_units, some_links", [(1, 4 << 20), (64, 3), (10**9, 50)])
def test_lanes_and_portions_do_not_change_links(pair, monkeypatch, lane_units, some_links):
    texts = pa.array(ODD[:24] + ["un mot internationalization été " * 40], type=pa.large_string())
    want = align.align(pair, texts)
    monkeypatch.setattr(align, "LANE_UNITS", lane_units)
    monkeypatch.setattr(align, "SOME_LINKS", some_links)
    got = align.align(pair, texts)
    assert (got.digests, got.pairs, got.times) == (want.digests, want.pairs, want.times) and (got.n_links == want.n_links).all()
    assert [sum(np.frombuffer(t, dtype="<u4")) for t in got.times] == got.n_links.tolist()


def test_lockstep_equals_sets_of_offsets():
    draw = np.random.default_rng(4)
    ends_a, ends_b, lanes = [], [], [(0, 0)]
    for lane in range(50):
        size = int(draw.integers(1, 80))
        for ends in (ends_a, ends_b):
            ends += sorted({100 * lane + size, *(100 * lane + draw.choice(np.arange(1, size + 1), size=int(draw.integers(0, size)), replace=False)).tolist()})
        lanes.append((len(ends_a), len(ends_b)))
    first = np.array(lanes)
    groups = align.lockstep(np.array(ends_a), np.array(ends_b), first[:-1, 0], first[:-1, 1], first[1:, 0])
    both = sorted(set(ends_a) & set(ends_b))
    assert [ends_a[i - 1] for i in groups[1]] == both == [ends_b[i - 1] for i in groups[3]]
    assert groups[0].tolist() == [0, *groups[1][:-1]] and groups[2].tolist() == [0, *groups[3][:-1]]


RESULTS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("block_pairs", [4 << 20, 300])
def test_corpus_counts_equal_plain_ones(spark, pair, monkeypatch, block_pairs):
    """With several blocks of counts, too; nulls, repeated rows and clashing columns."""
    monkeypatch.setattr(align, "SUM_PAIRS", 100)
    texts = [*ODD, None, *ODD[:9], "the cat sat on the mat", "the dog and the cat", "international the"]
    rows = [(i // 2, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a long, _pairs string").repartition(4)
    got = align.alignment(df.withColumnRenamed("n_a", "place"), A, B, block_pairs=block_pairs)
    assert got.columns == ["doc_id", "place", "_pairs", *RESULTS]
    got = {r.place: tuple(r[c] for c in RESULTS) for r in got.collect()}
    want = plain(pair, texts)
    assert got == dict(enumerate(want))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment(df, A, B).collect() == []


def test_query_equals_the_libraries(spark, pair):
    docs = {r.doc_id: r.text for r in spark.read.parquet(DOCS).collect()}
    got = {r.doc_id: tuple(r[c] for c in RESULTS) for r in QUERIES["op11_token_alignment"](spark, DOCS.rsplit("/", 1)[0]).collect()}
    ids = list(docs)
    assert got == dict(zip(ids, plain(pair, [docs[i] for i in ids])))
