"""The stages one after another, each against what it is to do with its own input."""

import re

import corpus_pipeline
from tests.llm.test_operators import SF, brute_groups, counts

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != "best-fit packing":
            assert docs.columns == DOCUMENTS
            seen[name] = {r["doc_id"] for r in before.collect()}, {r["doc_id"] for r in docs.collect()}
        if name == "quality rules":
            assert all(not counts(r["text"])[-1] for r in docs.collect())
        if name == "exact dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in before.collect()})
        if name == "simhash near-dedup":
            assert seen[name][1] == {f for _, _, f in brute_groups(before)}
        if name == "best-fit packing":
            assert {r["doc_id"] for r in docs.collect()} == seen["simhash near-dedup"][1]
    assert all(b <= a for a, b in seen.values())
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_on_odd_rows(spark):
    """Null ids and texts, empty and long texts, rows that repeat, clashing columns; then no row at all."""
    plain = " ".join(f"word{i}" for i in range(80))
    rows = [(1, plain), (1, plain), (2, plain + " "), (3, None), (4, ""), (None, plain + " end"), (5, " \n"), (6, "one " * 200_000), (7, "a\n" * 3000)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, `len` string, digest string, tag string"
    odd = spark.createDataFrame([(i, t, None, "web", None, "x", None, "y") for i, t in rows], kind)
    left = {"quality rules": None, "toxicity": None, "exact dedup": 7, "simhash near-dedup": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns
        kept = got.collect()
        assert {tuple(r) for r in kept} <= {tuple(r) for r in odd.collect()}
        assert left[name] is None or len(kept) == left[name]
        assert stage(spark, odd.limit(0), SF).collect() == []
    pack = corpus_pipeline.STAGES[-1][1]
    assert {r["doc_id"] for r in pack(spark, odd, SF).select("doc_id").distinct().collect()} == {1, 2, 3, 4, None, 5, 6, 7}
    assert pack(spark, odd.limit(0), SF).collect() == []
