"""Pairs of whole sets against brute force, with elements that many owners hold."""

import random
from itertools import combinations

from weftline.operators import joins
from weftline.plans import registry


def test_full_jaccard_equals_brute_force(spark):
    rng = random.Random(3)
    sets = {i: frozenset(f"c{rng.randrange(12)}" for _ in range(9)) | {f"r{rng.randrange(400)}" for _ in range(3)} for i in range(150)}
    sets |= {i: frozenset({"copy", "of", "all"}) for i in range(200, 240)} | {300: frozenset({"copy", "of", "all", "more"})}
    df = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "o long, e string")
    for least in (0.5, 0.7, 1.0):
        want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in combinations(sorted(sets), 2)}
        want = {k: v for k, v in want.items() if v[1] >= least}
        got = joins.similar_pairs(df, "o", "e", least).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): (r["inter"], r["jaccard"]) for r in got} == want


def test_copies_beyond_the_cap_meet(spark, tmp_path):
    spark.createDataFrame([(i, "one common text") for i in range(31)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["set_sim_join"](spark, str(tmp_path)).count() == 31 * 30 // 2


def test_overlap_and_families_of_all_vendors_and_items(spark, tmp_path):
    """Large ids are met, items that are equal modulo 200 stay apart, nulls are in no set."""
    parts = {5: range(0, 30), 70: range(0, 31), 900: range(15, 45), 901: range(200, 230), 950: range(205, 235), 951: range(0, 10)}
    rows = [(s, p) for s, ps in parts.items() for p in ps for _ in range(2)]
    rows += [(None, 3), (5, None)]
    spark.createDataFrame(rows, "vendor_id long, item_id long").write.parquet(f"{tmp_path}/sale_lines.parquet")
    pairs = {(r["a"], r["b"]): (r["inter"], r["coef"]) for r in registry.QUERIES["overlap_pairs_all"](spark, str(tmp_path)).collect()}
    assert pairs == {(5, 70): (30, 1.0), (5, 900): (15, 0.5), (70, 900): (16, 0.533333333), (901, 950): (25, 0.833333333)}
    assert sorted(map(tuple, registry.QUERIES["families_all"](spark, str(tmp_path)).collect())) == [(5, 5), (70, 5), (901, 901), (950, 901)]
