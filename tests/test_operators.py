import pytest
from pyspark.sql import functions as F

from weftline.operators import joins, split, stats, vocab


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tolerance_join_priority(spark):
    left = spark.createDataFrame([("b", 100), ("b", 200), ("b", 300)], "g string, k int")
    right = spark.createDataFrame([("b", 100, "x"), ("b", 104, "y"), ("b", 204, "z")], "g string, k int, v string")
    got = {r["k"]: (r["prio"], r["v"]) for r in joins.tolerance_join(left, right, ["g"], "k", [0, 4]).collect()}
    assert got == {100: (0, "x"), 200: (1, "z"), 300: (None, None)}


def test_nearest_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([(1, 5, 10), (2, 5, 100), (3, 6, 1)], "id int, g int, k long")
    right = spark.createDataFrame([(5, 8, 7), (5, 12, 8), (5, 90, 9)], "g int, k2 long, rid long")
    got = {r["id"]: (r["near"], r["delta"]) for r in joins.nearest(left, right, "g", "k", "k2", "rid").collect()}
    assert got == {1: (7, 2), 2: (9, 10), 3: (None, None)}


def test_interval_join_is_half_open(spark):
    p = spark.createDataFrame([(0,), (9,), (10,)], "p long")
    r = spark.createDataFrame([(0, 10)], "lo long, hi long")
    assert rows(joins.interval_join(p, r, "p", 3).select("p")) == [(0,), (9,)]


def test_split_accounting_and_guard(spark):
    d = spark.createDataFrame([(0, "train", "h0"), (1, "train", "h0"), (2, "train", "h1"), (3, "val", "h0"), (4, "test", "h2")], "idx int, tier string, body string")
    kept = split.keep_first(d.where("tier = 'train'"), ["body"], ["idx"])
    assert rows(kept.select("idx")) == [(0,), (2,)]
    a = spark.createDataFrame([("a", "train"), ("a", "test"), ("c", "val")], "id string, tier string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(split.violations(a, ids, "id", "tier")) == [("a", "overlap"), ("b", "unassigned"), ("c", "phantom")]


def test_components_and_duplicate_builds(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8)], "a long, b long")
    assert rows(split.components(e)) == [(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)]
    b = spark.createDataFrame([(1, 1, "x", 5), (1, 2, "x", 5), (1, 3, "y", 5), (2, 7, "x", 5)], "program long, build long, tok string, cnt long")
    assert rows(split.duplicate_builds(b)) == [(1, 1, True), (1, 2, False), (1, 3, True), (2, 7, True)]


def test_stats(spark):
    d = spark.createDataFrame([(i, i / 10, int(i > 4)) for i in range(10)], "id int, s double, y int")
    assert stats.auc(d, "s", "y").first()["auc"] == 1.0
    assert stats.aurc(d, "s", "y", "id").first()["aurc"] == pytest.approx(sum((i - 5) / i for i in range(6, 11)) / 10)
    one = stats.micro_macro(d.withColumn("g", F.lit(1)), "g", "y").first()
    assert one["micro"] == one["macro"] == 0.5


def test_vocab_falls_back_to_characters(spark):
    t = spark.createDataFrame([(1, ["ab", "zz"])], "k int, t array<string>")
    v = spark.createDataFrame([("ab", 5), ("z", 6)], "token string, id int")
    assert vocab.encode(t, "k", F.col("t"), v, 3).first()["ids"] == [5, 6, 6]


def test_tolerance_join_keeps_nulls_and_repeats(spark):
    left = spark.createDataFrame([("b", 1, None), ("b", 1, "x"), ("b", 1, "x"), (None, 1, "y")], "g string, k int, note string")
    right = spark.createDataFrame([("b", 1, 7), ("b", 1, 5)], "g string, k int, v int")
    got = [tuple(r) for r in joins.tolerance_join(left, right, ["g"], "k", [0]).collect()]
    assert sorted(got, key=str) == sorted([("b", 1, None, 0, 5), ("b", 1, "x", 0, 5), ("b", 1, "x", 0, 5), (None, 1, "y", None, None)], key=str)


def test_evidence_and_code_tokens(spark):
    from weftline.functions import code as C

    text = 'if (open_file("cannot readConfig\\n", 0x10) == 0) { FUN_00401000(); _hidden(1); return iVar1; }'
    r = spark.createDataFrame([(text,)], "c string").select(C.evidence_tokens(F.col("c")).alias("e"), C.typed_evidence(F.col("c")).alias("t"), C.call_references(F.col("c")).alias("r")).first()
    assert sorted(r["e"]) == ["config", "open", "read"] and r["r"] == [0x401000]
    assert r["t"]["api"] == ["open"] and sorted(r["t"]["code"]) == ["hidden", "if", "one", "pow2", "return", "zero"]


def test_filtered_neighbours_lift_the_mask(spark):
    from weftline.operators import retrieval

    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 9, [1.0, 0.0])], "q_id long, q_group int, v array<float>")
    t = spark.createDataFrame([(1, 5, 0, [1.0, 0.0]), (2, 6, 1, [0.0, 1.0]), (3, 7, 1, [0.6, 0.8])], "t_id long, t_label int, t_group int, v array<float>")
    allowed = spark.createDataFrame([(0, 1), (9, 0)], "q_group int, t_group int")
    got = rows(retrieval.knn_masked(q, t, allowed, 2).select("q_id", "rank", "t_id"))
    assert got == [(1, 1, 3), (1, 2, 2), (2, 1, 1), (2, 2, 3)]


def test_checks_raise(spark):
    from weftline.operators import quality as Q

    d = spark.createDataFrame([(1, "a"), (2, "bad_x")], "k int, s string")
    assert Q.in_range(d, "n", 1, 5).first()["ok"] and not Q.in_range(d, "n", exact=3).first()["ok"]
    Q.require(Q.in_range(d, "n", 1, 5))
    with pytest.raises(ValueError, match="forbidden: 1"):
        Q.require(Q.no_match(d, "forbidden", "s", ["bad"]))
    a = spark.createDataFrame([("a", "train"), ("c", "val"), ("c", "train")], "id string, tier string")
    with pytest.raises(ValueError, match="unassigned"):
        split.guarded(a.where("id = 'a'"), spark.createDataFrame([("a",), ("b",)], "id string"), "id", "tier")
    assert rows(split.guarded(a.where("id = 'a'"), spark.createDataFrame([("a",), ("b",)], "id string"), "id", "tier", "train")) == [("a", "train"), ("b", "train")]
    with pytest.raises(ValueError, match="overlap"):
        split.guarded(a, spark.createDataFrame([("a",)], "id string"), "id", "tier", "train")


def test_policy_accounting(spark):
    d = [(0, "train", "h0", "f", False), (1, "train", "h0", "f", False), (2, "train", "h1", "g", True), (3, "val", "h0", "f", True), (4, "val", "h2", "x", True), (5, "val", "h3", "y", False), (6, "test", "h4", "z", False)]
    j = split.policy(spark.createDataFrame(d, "idx int, tier string, body string, name string, dyn boolean"), "tier", "body", "name", F.col("dyn"), ["idx"])
    assert rows(j.where("outcome = 'kept'").select("idx")) == [(0,), (2,), (5,), (6,)]
    assert rows(split.policy_counts(j, "tier").where("tier = 'val'")) == [("val", 3, 1, 1, 0, 1)]


def test_semantic_f1_and_prompt(spark):
    from weftline.functions import code as C
    from weftline.functions import metrics as M

    clusters = F.create_map(F.lit("get"), F.array(F.lit(1)), F.lit("fetch"), F.array(F.lit(1)), F.lit("row"), F.array(F.lit(2)))
    r = spark.createDataFrame([("get_row", "fetch_row"), ("get_x", "row_y"), ("", ""), ("a", "")], "p string, t string").select(M.cluster_f1(F.col("p"), F.col("t"), clusters).alias("f")).collect()
    assert [x["f"] for x in r] == [1.0, 0.0, 1.0, 0.0]
    d = spark.createDataFrame([(["puts", "puts", "exit"], ["f"], [], 1, ["A", "B", "A"])], "c array<string>, e array<string>, r array<string>, n int, t array<string>")
    got = d.select(C.function_prompt(F.col("c"), F.col("e"), F.col("r"), F.col("n"), F.col("t"), F.lit(True)).alias("p")).first()["p"]
    assert got == "/* Reverse-engineered function description.\n * Library calls: puts()x2, exit()\n * Internal calls: f\n * Called by: (none)\n * Size: 1 blocks, 3 instructions, has loops (trivial wrapper)\n * Instruction mix: A(2), B(1)\n */\nvoid "
    b = spark.createDataFrame([([(["X"], ["L1", "L2"])], 9, True, ["RSI", "RDI"], ["t2", "t1"])], "b array<struct<tokens:array<string>,lits:array<string>>>, n int, h boolean, r array<string>, t array<string>")
    assert b.select(C.enriched_blocks(F.col("b"), F.col("n"), F.col("h"), F.col("r"), F.col("t")).alias("e")).first()["e"] == [["ARGC_6", "HAS_RESULT", "ARGREG_RDI", "ARGREG_RSI", "t1", "t2"], ["X", "L1", "L2"]]


def test_reward_counts_accented_letters_as_words(spark):
    from weftline.functions import metrics as M

    d = spark.createDataFrame([("é_" * 12 + "a", "b")], "p string, t string")
    assert d.select(M.reward(F.col("p"), F.col("t")).alias("r")).first()["r"] == pytest.approx(0.1 * (1 - 0.02 * 3))


def test_tolerance_join_deals_by_rows(spark, monkeypatch):
    """Tasks grow with the rows, and hits do not change."""
    from weftline.operators import joins

    left = spark.range(100).selectExpr("id % 3 as b", "id as k")
    right = spark.range(50).selectExpr("id * 2 % 3 as b", "id * 2 as k", "id as v")
    want = rows(joins.tolerance_join(left, right, ["b"], "k", [0, -3, 3]))
    monkeypatch.setattr(joins, "TASK_ROWS", 25)
    got = joins.tolerance_join(left, right, ["b"], "k", [0, -3, 3])
    assert rows(got) == want and sum(r[2] == 0 for r in want) == 50
    assert got.rdd.getNumPartitions() == 10


def test_tied_functions_do_not_depend_on_the_order_of_rows(spark):
    """Two functions of one name and place: the smaller body counts, whichever row comes first."""
    from weftline.operators import split

    tied = [(1, 0, "f", "b", 20, 5), (1, 0, "f", "a", 20, 5)]
    other = [(1, 1, "f", "a", 20, 1)]
    schema = "program int, opt int, name string, body string, words int, at int"
    for some in (tied, tied[::-1]):
        df = spark.createDataFrame(some + other, schema).coalesce(1)
        assert rows(split.build_identity(df, "program", "opt", "name", "body", "words", "at")) == [(1, 0, 1, 1, 1, 1, 1)]
