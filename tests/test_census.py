"""Best similarity to a name of another group, against all pairs."""

import random

import pytest
from weftline.operators import predictions


def _brute(names, train):
    held = {}
    for n, g in train:
        held.setdefault(n, set()).add(g)
    bag = lambda n: {t for t in n.lower().split("_") if t}
    out = {}
    for n, g in set(names):
        best = 1.0 if held.get(n, set()) - {g} else 0.0
        for c, hs in held.items():
            if c != n and hs - {g} and bag(n) & bag(c):
                best = max(best, len(bag(n) & bag(c)) / len(bag(n) | bag(c)))
        out[n, g] = best
    return out


@pytest.mark.parametrize(("whole", "partial"), [(0, 1), (1, 2), (2, 3), (6, 3)])
def test_best_in_other_group(spark, monkeypatch, whole, partial):
    monkeypatch.setattr(predictions, "WHOLE", whole)
    monkeypatch.setattr(predictions, "PARTIAL", partial)
    r = random.Random(whole)
    tokens = [f"t{i}" for i in range(30)]
    pick = lambda: "_".join(["get"] * (r.random() < 0.6) + [tokens[int(30 * r.random() ** 2)] for _ in range(r.randrange(0, 6))])
    train = [(pick(), f"g{int(8 * r.random() ** 2)}") for _ in range(150)] + [("get_t1_t2_t2", "g0"), ("get_t2_t1", "g7"), ("lone", "g1"), ("u1_u2", "g1"), ("u2_u1", "g2")]
    names = train + [(pick(), f"g{r.randrange(9)}") for _ in range(60)] + [("u2_q", "g9"), ("nothing_like", "g1")]
    n, t = spark.createDataFrame(names, "nm string, g string"), spark.createDataFrame(train, "nm string, g string")
    got = {(x["nm"], x["g"]): x["best"] for x in predictions.best_in_other_group(n, t, "nm", "g").collect()}
    want = _brute(names, train)
    assert got.keys() == want.keys()
    assert {k: (round(got[k], 9), round(v, 9)) for k, v in want.items() if abs(got[k] - v) > 1e-9} == {}


def test_common_sub_token_makes_no_pairs(spark):
    """Two thousand names of one common sub-token and one of their own: the shared one is a single subset of each."""
    rows = spark.range(2000).selectExpr("concat('get_n', id) as nm", "concat('g', id % 7) as g")
    out = predictions.best_in_other_group(rows, rows, "nm", "g")
    assert out.where("abs(best - 1/3d) > 1e-9").count() == 0
    assert out.count() == 2000
