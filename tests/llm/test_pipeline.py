import re
import zlib

import corpus_pipeline
from tests.llm.test_decontam import by_hand
from tests.llm.test_neardup import cell_set

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        made = stage(spark, docs, SF)
        if name == "packing":
            assert {r.doc_id for r in made.collect()} == set(before)
            break
        assert made.columns == docs.columns
        after = {r.doc_id: r for r in made.collect()}
        assert all(before[i] == r for i, r in after.items())
        if name == "language_id":
            want = {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
        elif name == "exact_dedup":
            want = set({re.sub(r"[ \t-\r]+", " ", before[i].text): i for i in sorted(before, reverse=True)}.values())
        elif name == "near_dedup":
            sets = {i: cell_set(r.text) for i, r in before.items()}
            group = {i: i for i in before}
            for a in sorted(before):
                for b in sorted(before):
                    if b < a and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        old, new = max(group[a], group[b]), min(group[a], group[b])
                        group = {i: new if g == old else g for i, g in group.items()}
            want = set(group.values())
        else:
            counted = {i: by_hand(r.text, bench) for i, r in before.items()}
            want = {i for i, (n, h, _) in counted.items() if not (h and 20 * h >= n)}
        assert set(after) == want, name
        docs = made


def test_run_and_fold(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    from tomeworks.llm.queries import fold

    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
