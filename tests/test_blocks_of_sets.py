"""Sets against sets by blocks, with blocks so small that every kind of task occurs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from weftline.operators import blocks, joins


@pytest.mark.parametrize(("held", "words"), [(60, 0), (200, 1), (10**6, 32)])
def test_pairs_of_blocks_equal_brute_force(spark, monkeypatch, held, words):
    monkeypatch.setattr(blocks, "HELD", held)
    monkeypatch.setattr(blocks, "WORDS", words)
    monkeypatch.setattr(blocks, "PAIRS", 50)
    r = random.Random(held)
    sets = {i: {f"c{r.randrange(6)}" for _ in range(4)} | {f"r{r.randrange(30)}" for _ in range(r.randrange(8))} for i in range(90)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "o long, e array<string>")
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = [(x["a"], x["b"]) for x in joins.similar_pairs(df, "o", "e", 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_arrays_and_rows_of_elements_agree(spark):
    """Null arrays, null elements, repeated elements and rows that repeat an owner."""
    rows = [(1, ["a", "b", None, "a"]), (1, ["c"]), (2, ["a", "b", "c"]), (3, None), (4, []), (5, [None]), (6, ["a", "b", "d"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "o long, e array<string>")
    found = [sorted(map(tuple, joins.similar_pairs(d, "o", "e", 0.5).collect())) for d in (df, df.select("o", F.explode("e").alias("e")))]
    assert found[0] == found[1] == [(1, 2, 3, 1.0), (1, 6, 2, 0.5), (2, 6, 2, 0.5)]


def test_tasks_of_blocks_go_by_rounds(spark, monkeypatch):
    """Each pair of blocks meets once, no round deals more than all sets hold, and what a round shuffled is gone when the next one is written."""
    monkeypatch.setattr(blocks, "ROUND", 0)
    held = [3.0, 5.0, 1.0, 4.0, 4.0, 2.0]
    rounds = list(blocks._rounds(held, lambda i, j: abs(i - j) < 4))
    tasks = [t for r in rounds for t in r]
    assert sorted(tasks) == [(i, j) for i in range(6) for j in range(i, 6) if j - i < 4]
    assert len(rounds) > 3 and all(sum(held[k] for t in r for k in set(t)) <= sum(held) for r in rounds)
    monkeypatch.setattr(blocks, "HELD", 60)
    seen, real = [], blocks._cut_all
    monkeypatch.setattr(blocks, "_cut_all", lambda s, parts, *a: real(s, (seen.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or p for p in parts), *a))
    r = random.Random(2)
    sets = {i: frozenset(f"r{r.randrange(25)}" for _ in range(r.randrange(1, 12))) for i in range(80)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "o long, e array<string>")
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {(x["a"], x["b"]) for x in joins.similar_pairs(df, "o", "e", 0.5).collect()} == want
    assert len(seen) > 3 and set(seen) == {"true"}
