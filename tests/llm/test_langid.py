import zlib

import numpy as np
import pytest

from tomeworks.llm import langid
from tomeworks.llm.queries import QUERIES


def test_code_lengths_equal_a_plain_context_tree():
    """Against counts in dictionaries, walked byte by byte."""
    order, samples = 3, {"x": [b"abracadabra abracadabra", b"cadabra"], "y": [b"hocus pocus abra"]}
    model = langid.build(["x", "y"], {k: langid.count_windows(v, order) for k, v in samples.items()}, order)
    for k, language in enumerate(["x", "y"]):
        followers: dict[bytes, dict[int, int]] = {}
        for text in samples[language]:
            padded = bytes(order) + text
            for i in range(order, len(padded)):
                for n in range(order + 1):
                    here = followers.setdefault(padded[i - n : i], {})
                    here[padded[i]] = here.get(padded[i], 0) + 1
        for text in (b"abrakadabra!", b"pocus", b"zzz", b"a"):
            bits, padded = 0.0, bytes(order) + text
            for i in range(order, len(padded)):
                for n in range(order, -1, -1):
                    seen = followers.get(padded[i - n : i])
                    if seen is None:
                        continue
                    total = sum(seen.values()) + len(seen)
                    if padded[i] in seen:
                        bits -= np.log2(seen[padded[i]] / total)
                        break
                    bits -= np.log2(len(seen) / total)
                else:
                    bits += 8
            got = langid.code_lengths(model, np.array([0, len(text)]), np.frombuffer(text, dtype=np.uint8))
            assert got[0, k] == pytest.approx(bits, rel=1e-5)


def test_held_out_accuracy(spark):
    rows = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_nulls_letterless_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "guten tag zusammen", "de"), (2, "bonjour tout le monde", "fr"), (3, None, "fr"), (4, "sans label", None),
                                (4, "guten tag", "de"), (4, "guten tag", "de")], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == ["de", "fr"]
    asked = spark.createDataFrame([(1, None, 0.5), (2, "", 1.0), (3, "12 34 !?", 1.0), (4, "guten tag", 1.0), (5, "bonjour", 1.0), (6, "guten tag " * 30_000, 1.0)],
                                  "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(model, asked).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["und", "und", "und", "de", "fr", "de"] and got[1][1] == 0
    empty = df.limit(0)
    assert langid.identify(model, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(langid.train(empty), asked).collect()} == {"und"}


def test_no_language_is_lost_where_ids_or_texts_repeat(spark):
    rows = [(None, f"guten tag nummer {i}", "de") for i in range(5000)] + [(7, "buenos dias", "es")] * 5000 + [(1, "bonjour tout le monde", "fr")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=20)
    assert model.languages == ["de", "es", "fr"]
