"""The pipeline against what its stages say of their own inputs, on the smallest tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from weftline.llm import decontam, mixing, setjoin, toxicity
from weftline.llm.common import load, stage

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = load(spark, DATA, "documents")
    kept = [docs]
    for name, f in corpus_pipeline.STAGES:
        kept.append(stage(f(spark, kept[-1], DATA), name))
    assert all(d.columns == corpus_pipeline.COLUMNS for d in kept[1:-1]) and kept[-1].columns == [*corpus_pipeline.COLUMNS, "shard", "slot"]
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    bad = {r["doc_id"] for r in toxicity.toxicity_report(docs, load(spark, DATA, "labels")).where("predicted = 1").collect()}
    assert ids(kept[1]) == [i for i in ids(docs) if i not in bad]
    comp = setjoin.jaccard_components(kept[1], 5, 80, 100).collect()
    assert ids(kept[2]) == sorted(r["doc_id"] for r in comp if r["doc_id"] == r["component_id"])
    leaks = {r["doc_id"] for r in decontam.contaminated(kept[2], load(spark, DATA, "benchmark")).collect()}
    assert ids(kept[3]) == [i for i in ids(kept[2]) if i not in leaks]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(kept[3]).collect() if r["size"]}
    assert Counter(ids(kept[4])) == Counter({i: n for i, n in taken.items() if n})
    assert ids(kept[5]) == ids(kept[4])
