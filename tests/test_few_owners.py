"""Overlap of few owners by bits and neighbours by cells, against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from weftline.operators import callgraph, joins


@pytest.mark.parametrize("few", [0, 62])
def test_overlap_of_few_owners_equals_that_of_many(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW", few)
    r = random.Random(5)
    sets = {f"s{i}": {f"w{int(60 * r.random() ** 2)}" for _ in range(r.randrange(3, 30))} for i in range(12)}
    rows = [(o, [*s, None, min(s)]) for o, s in sets.items()] + [(None, ["w1"]), ("s0", None), ("none", [])]
    df = spark.createDataFrame(rows, "o string, e array<string>")
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 4 and len(sets[a] & sets[b]) >= 0.35 * min(len(sets[a]), len(sets[b]))}
    for d in (df, df.select("o", F.explode("e").alias("e"))):
        got = joins.overlap_pairs(d, "o", "e", 0.35, 4).collect()
        assert {(x["a"], x["b"]): x["inter"] for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("cell", [1, 3, 4096])
def test_neighbours_by_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(callgraph, "CELL", cell)
    r = random.Random(cell)
    at = sorted({(b, r.randrange(-20, 40)) for b in "xy" for _ in range(30)})
    rows, edges = spark.createDataFrame([*at, at[0]], "b string, pos long"), spark.createDataFrame([], "b string, src long, dst long")
    got = [tuple(x) for x in callgraph.window_or_call(rows, edges, "b", "pos", 2, 3).collect()]
    want = {(b, p, q) for b, p in at for c, q in at if b == c and 0 < abs(p - q) <= 2}
    assert len(got) == len(want) and set(got) == want
