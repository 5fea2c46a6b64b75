"""The pipeline over odd rows and empty tables, and its near-copy, benchmark and shard stages against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    base = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", 1.0) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s1", 1, "x", 1.0), (21, base[1].replace("w1x39", "other"), "en", "s1", 1, None, None), (22, None, None, None, None, None, None)]
    rows += [(23, "", "en", "s2", 0, "x", 0.0), (None, "no id but a text of some words", "en", "s2", 0, "x", 0.0), (24, base[3] + " " + base[5], "en", "s0", 9, "x", 0.0), (2, base[2], "en", "s2", 5, "x", 1.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(base[5].split()[4:34])), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_of_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda d: sorted((r["doc_id"] for r in d.select("doc_id").collect()), key=str)
    clean = corpus_pipeline.drop_toxic(spark, docs, folder).cache()
    assert ids(clean) == ids(docs) and clean.columns == corpus_pipeline.COLUMNS

    rows = [r for r in clean.collect() if r["doc_id"] is not None]
    sets = defaultdict(set)
    for r in rows:
        w = WORD.findall((r["text"] or "").lower())
        sets[r["doc_id"], r["text"]] |= {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    gone = {b for a, b in combinations(sorted(sets, key=lambda k: (k[0], k[1] or "")), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    once = corpus_pipeline.drop_near_copies(spark, clean, folder).cache()
    assert ids(once) == sorted([k[0] for k in sets if k not in gone] + [None], key=str)

    item = set(zip(*[(x := " ".join(f"w5x{j}" for j in range(4, 34)).split())[i:] for i in range(5)], strict=False))
    held = {r["doc_id"] for r in once.collect() if r["text"] and len(item & set(zip(*[r["text"].lower().split()[i:] for i in range(5)], strict=False))) >= 0.8 * len(item)}
    kept = corpus_pipeline.drop_leaks(spark, once, folder).cache()
    assert held == {5, 24} and ids(kept) == [i for i in ids(once) if i not in held]

    mixed = corpus_pipeline.mix_sources(spark, kept, folder).cache()
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(ids(kept)) and max(times.values()) <= 3 and {r["text"] for r in mixed.collect()} <= {r["text"] for r in kept.collect()}
    placed = corpus_pipeline.shard(spark, mixed, folder).collect()
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert len(placed) == mixed.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in placed:
        where[zlib.crc32((r["text"] or "").encode())].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
