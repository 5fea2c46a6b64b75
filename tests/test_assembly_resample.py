"""Greedy duplicate builds, components, keyed assembly, weighted draws and the router of several heads, against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from weftline.operators import joins, manifest, router, split


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_duplicate_builds_against_the_greedy_loop(spark, least):
    r = random.Random(int(least * 100))
    rows = []
    for p in range(6):
        base = [Counter({t: r.randrange(1, 4) for t in r.sample(range(20), 6)}) for _ in range(3)]
        for b in range(25):
            c = Counter(r.choice(base))
            for _ in range(r.randrange(3)):
                c[r.randrange(25)] += 1
            rows += [(p, b, t, k) for t, k in c.items()]
    want = set()
    for p in range(6):
        kept = []
        for b in range(25):
            own = Counter({t: k for q, d, t, k in rows if (q, d) == (p, b)})
            dup = sum(own.values()) >= 8 and any(sum((own & k).values()) / sum(own.values()) >= least for k in kept)
            want.add((p, b, not dup))
            kept += [] if dup else [own]
    df = spark.createDataFrame(rows, "program int, build int, tok int, cnt int")
    assert {tuple(x) for x in split.duplicate_builds(df, least, 8).collect()} == want
    assert split.duplicate_builds(df.limit(0), least).count() == 0


def test_chain_of_builds_alternates(spark):
    """Each build lies in the one before it only, so every second one is kept, after as many rounds as the chain is long."""
    rows = [(1, b, t, 1) for b in range(8) for t in range(b, b + 4)]
    got = {x["build"]: x["kept"] for x in split.duplicate_builds(spark.createDataFrame(rows, "program int, build int, tok int, cnt int"), 0.7).collect()}
    assert got == {b: b % 2 == 0 for b in range(8)}


def test_components_of_a_path_a_star_and_a_loop(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(500, 540)]
    e = spark.createDataFrame([*path, *star, (900, 900), (None, 3), (540, 539), (540, 539)], "a long, b long")
    got = {x["node"]: x["component"] for x in split.components(e).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(500, 541))} | {900: 900}
    assert split.components(e.limit(0)).count() == 0


def test_shared_elements_are_counted(spark):
    sets = {i: set(random.Random(i).sample(range(40), 12)) for i in range(20)}
    df = spark.createDataFrame([(o, e) for o, s in sets.items() for e in s], "o int, e int")
    pairs = spark.createDataFrame([(i, j) for i in sets for j in sets if i < j], "x int, y int")
    got = {(x["x"], x["y"]): x["inter"] for x in joins.shared(pairs, df, "o", "e").collect()}
    assert got == {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i < j and sets[i] & sets[j]}


def test_assembly_takes_columns_by_source(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "p"), (2, None, "q"), (None, "z", "z")], "id int, v string, w string")
    b = spark.createDataFrame([(1, "y", "r"), (2, "y", None), (3, "y", None), (3, "b", None)], "id int, v string, w string")
    c = spark.createDataFrame([(4,), (1,)], "id int")
    got = {x["id"]: tuple(x)[1:] for x in manifest.assemble({"a": a, "b": b, "c": c}, "id", ["v", "w"], ["v", "w"]).select("id", "v", "w", "n_v", "n_w", "mask").collect()}
    assert got == {1: ("x", "r", 2, 1, 7), 2: ("y", "p", 1, 2, 3), 3: ("b", None, 2, 0, 2), 4: (None, None, 0, 0, 4)}
    sets = {"a not b": lambda h: h("a") & ~h("b"), "only c": lambda h: h("c") & ~h("a") & ~h("b"), "two": lambda h: F.col("n_v") > 1}
    counts = {x["set"]: x["n"] for x in manifest.coverage(manifest.assemble({"a": a, "b": b, "c": c}, "id", [], ["v"]), ["a", "b", "c"], sets).collect()}
    assert counts == {"a not b": 0, "only c": 1, "two": 2}
    assert len(manifest.SETS) == 18


def test_draws_follow_the_weights(spark):
    """One row has a third of the weight; counts lie within five deviations, and there are exactly n draws."""
    w = [300.0] + [1.0 + i % 5 for i in range(200)] + [0.0, -1.0, None]
    df = spark.createDataFrame(list(enumerate(w)), "id long, w double")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = router.resample(df, "w", "id", 5000)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs
    got = Counter(x["id"] for x in plan.collect())
    total = sum(x for x in w if x and x > 0)
    assert sum(got.values()) == 5000
    for i, x in enumerate(w):
        p = max(0.0, x or 0.0) / total
        assert abs(got[i] - 5000 * p) <= 5 * math.sqrt(5000 * p * (1 - p)) + 1e-9
    assert sum(x["n"] for x in router.resample(df, "w", "id").groupBy().agg(F.count("*").alias("n")).collect()) == 603
    assert router.resample(df.where("id > 400"), "w", "id").count() == 0


def test_best_head_ties(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.1), (0.1, 0.5, 0.5), (0.1, 0.2, 0.3), (0.2, 0.2, 0.2)], "a double, r double, d double")
    head, gap = router.best_head({"a": F.col("a"), "r": F.col("r"), "d": F.col("d")})
    assert [tuple(x) for x in df.select(head, F.round(gap, 6)).collect()] == [(0.0, 0.401), (1.0, 0.401), (2.0, 0.201), (0.0, 0.001)]


def test_router_of_three_heads(spark):
    """Separable classes are told apart; features without information leave equal margins, which go by the tie order."""
    rows = [(float(i % 3), float(i % 3) + 0.01 * (i % 7), 1.0 + i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "y double, x double, w double")
    out = router.multi_router(df, ["x"], "y", "w", [0.0, 1.0, 2.0], 3).transform(df)
    assert out.where("prediction <> y").count() == 0
    flat = df.withColumns({"x": F.lit(1.0), "w": F.lit(1.0)})
    for ties in ([2.0, 0.0, 1.0], [1.0, 2.0, 0.0]):
        assert {r[0] for r in router.multi_router(flat, ["x"], "y", "w", ties, 2).transform(flat).select("prediction").collect()} == {ties[0]}
    one = df.where("y = 1")
    assert {r[0] for r in router.multi_router(one, ["x"], "y", "w", [0.0, 1.0, 2.0], 2).transform(one).select("prediction").collect()} == {1.0}


@pytest.mark.parametrize("batch", [1, 3])
def test_builds_that_share_all_tokens_are_decided_by_batches(spark, monkeypatch, batch):
    """Forty builds of the same few tokens: batches and all containments at once decide alike, and later builds meet kept ones only."""
    r = random.Random(batch)
    rows = [(b % 2, b, t, r.randrange(1, 9)) for b in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, "program int, build int, tok int, cnt int")
    decided = lambda: {tuple(x) for x in split.duplicate_builds(df, 0.8).collect()}
    monkeypatch.setattr(split, "DENSE", 10**9)
    want = decided()
    monkeypatch.setattr(split, "DENSE", 0)
    monkeypatch.setattr(split, "BATCH", batch)
    calls, real = [], split.contained_builds
    monkeypatch.setattr(split, "contained_builds", lambda *a: calls.append(len(a)) or real(*a))
    assert decided() == want and 0 < sum(not k for *_, k in want) < 40
    assert calls.count(4) > 1
