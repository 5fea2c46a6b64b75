"""Range-dealt windows against plain Python, with a group that holds most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F
from weftline.operators import joins, stats, vocab
from weftline.operators.ranges import at_ranks, carried, ranged, running

N = 3000


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(i, None if i % 41 == 0 else "hot" if r.random() < 0.5 else f"g{r.randrange(40)}", r.randrange(50), r.choice([None, 1, 2, 3])) for i in range(N)]
    return data, spark.createDataFrame(data, "id long, g string, s int, v int").repartition(5)


def test_ranges_share_a_hot_group(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = ranged(rows[1], ["g", "id"]).where("g = 'hot'").groupBy("__r").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(r) > 1


def test_running_and_carried(spark, rows):
    data, df = rows
    got = {x["id"]: x for x in running(df, [F.desc("s"), "id"], {"up": F.col("v")}, ["g"]).collect()}
    last = {x["id"]: x for x in carried(df, ["s", "id"], {"back": F.col("v")}, {"next": F.col("v")}, ["g"]).collect()}
    for g in {x[1] for x in data}:
        own = [x for x in data if x[1] == g]
        up = 0
        for i, x in enumerate(sorted(own, key=lambda x: (-x[2], x[0])), 1):
            up += x[3] or 0
            assert (got[x[0]]["i"], got[x[0]]["up"]) == (i, up)
        own.sort(key=lambda x: (x[2], x[0]))
        for i, x in enumerate(own):
            back = next((y[3] for y in reversed(own[: i + 1]) if y[3] is not None), None)
            ahead = next((y[3] for y in own[i:] if y[3] is not None), None)
            assert (last[x[0]]["back"], last[x[0]]["next"]) == (back, ahead)


def test_empty(spark):
    e = spark.createDataFrame([], "id long, g string, s int, v int")
    assert running(e, ["id"], {"up": F.col("v")}).count() == 0
    assert carried(e, ["id"], {"b": F.col("v")}, by=["g"]).count() == 0
    assert at_ranks(e, "g", "v", {"m": F.lit(1)}).count() == 0
    assert stats.aurc(e, "s", "v", "id").first()["aurc"] is None
    assert stats.selective(e, "s", "v", "id", [0.5]).count() == 0


def test_ranks(rows):
    data, df = rows
    got = {x["g"]: x["upper_median"] for x in stats.upper_median(df, "g", "v").collect()}
    for g in got:
        s = sorted(x[3] for x in data if x[1] == g and x[3] is not None)
        assert got[g] == s[len(s) // 2]


def test_three_cut_rules(spark):
    df = spark.createDataFrame([(i, 7, i % 2) for i in range(25)], "id int, s int, o int")
    want = {"round": round(0.1 * 25), "int": int(0.1 * 25), "percent": 25 * 10 // 100}
    for rule, k in want.items():
        r = stats.selective(df, "s", "o", "id", [0.1, 0.001], rule).collect()
        assert {x["share"]: x["kept"] for x in r} == {0.1: k, 0.001: 1}
        assert {x["share"]: x["mean"] for x in r}[0.1] == sum(i % 2 for i in range(k)) / k
    half = spark.createDataFrame([(i, 1, 1) for i in range(35)], "id int, s int, o int")
    assert stats.selective(half, "s", "o", "id", [0.1], "round").first()["kept"] == 4  # 3.5 goes to the even number


def test_aurc_is_the_mean_of_running_risks(spark):
    r = random.Random(1)
    data = [(i, r.randrange(5), r.randrange(2)) for i in range(400)]
    df = spark.createDataFrame(data, "id int, s int, o int")
    cum = area = 0.0
    for k, x in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        cum += 1 - x[2]
        area += cum / k
    assert abs(stats.aurc(df, "s", "o", "id").first()["aurc"] - area / len(data)) < 1e-12


def test_erfc(spark):
    xs = [i / 50 for i in range(-150, 400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y"))
    for r in df.collect():
        assert abs(r["y"] - math.erfc(r["x"])) <= 1e-9 * math.erfc(r["x"]) + 1e-15


def test_mcnemar_without_and_with_equal_discordance(spark):
    df = spark.createDataFrame([(1, 1), (0, 0)], "a int, b int")
    assert stats.mcnemar(df, "a", "b").first()["p_value"] == 1.0
    r = stats.mcnemar(spark.createDataFrame([(1, 0), (0, 1)], "a int, b int"), "a", "b").first()
    assert (r["chi2"], round(r["p_value"], 6)) == (0.5, round(math.erfc(0.5), 6))


def test_bootstraps(spark):
    df = spark.createDataFrame([(i, f"p{i % 9}", i % 7, i % 3) for i in range(630)], "id int, p string, a int, b int")
    m = [r["mean"] for r in stats.bootstrap_rows(df, "id", "a", 400).collect()]
    mean, sd = 3.0, 2.0
    assert len(m) == 400 and abs(sum(m) / 400 - mean) < 0.02
    spread = math.sqrt(sum((x - mean) ** 2 for x in m) / 400)
    assert abs(spread - sd / math.sqrt(630)) < 0.012
    r = stats.paired_bootstrap(df, "p", "a", "b", 1000).first()
    assert r["groups"] == 9 and r["low"] <= r["delta"] <= r["high"] and r["higher"] == 9


def test_vocabulary_cap_and_decode(spark):
    words = ["get"] * 5 + ["set"] * 4 + ["list"] * 4 + ["item"] * 4 + ["x"] * 2 + list("getsli_m")
    t = spark.createDataFrame([(w,) for w in words], "w string")
    for cap in (0, 1, 2, 3, 4, 99):
        v = {r["token"]: r["id"] for r in vocab.build(t, "w", cap=cap, reserved=4).collect()}
        order = sorted(set(words), key=lambda w: (-words.count(w), w))[:cap]
        assert v == {w: i + 4 for i, w in enumerate(order)}
    v = vocab.build(t, "w", reserved=4)
    names = spark.createDataFrame([(1, ["get", "list", "item"]), (2, ["set", "_", "timely"]), (3, []), (4, ["get", "slim", "get"])], "k int, ts array<string>")
    ids = vocab.encode(names.where("size(ts) > 0"), "k", F.col("ts"), v, 3).unionByName(names.where("size(ts) = 0").select("k", F.array().cast("array<bigint>").alias("ids")))
    pad = ids.withColumn("ids", F.concat(F.array(F.lit(1).cast("long")), "ids", F.array(F.lit(2).cast("long"))))
    got = {r["k"]: (r["name"], r["words"]) for r in vocab.decode(pad, "k", "ids", v, skip=(0, 1, 2)).collect()}
    assert got[1] == ("getlistitem", ["get", "list", "item"])
    assert got[2] == ("set_timel<UNK>", ["set", "_", "timel", "<UNK>"])
    assert got[3] == ("", [])
    assert got[4] == ("getslimget", ["get", "slim", "get"])


def test_nearest_with_a_hot_group_and_extra_columns(spark):
    r = random.Random(3)
    left = [(i, "u" if i % 2 else f"v{i % 5}", r.randrange(2000), i % 4) for i in range(600)]
    right = [(i, "u" if i % 3 else f"v{i % 5}", r.randrange(2000)) for i in range(500)]
    got = {x["id"]: (x["near"], x["delta"]) for x in joins.nearest(spark.createDataFrame(left, "id int, u string, k int, delta0 int"), spark.createDataFrame(right, "rid int, u string, rk int"), "u", "k", "rk", "rid").collect()}
    for i, u, k, _ in left:
        best = min(((abs(k - rk), rk, rid) for rid, ru, rk in right if ru == u), default=None)
        assert got[i] == ((best[2], best[0]) if best else (None, None))
