"""Functions that no query reaches: readers, prompts, models, and picks, each against a plain computation."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from weftline.functions import code, metrics, names
from weftline.operators import predictions, router, split, vocab
from weftline.sources import io
from weftline.streaming import manifest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1, "v": "x"}, {"k": 2}]))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    assert sorted(map(str, rows(io.read_json_array(spark, str(tmp_path / "a.json"), schema)))) == sorted(map(str, [(1, "x"), (2, None)]))
    (tmp_path / "b.csv").write_text("k,v\n3,\"a, b\"\n4,\n")
    assert {r["k"]: r["v"] for r in io.read_csv(spark, str(tmp_path / "b.csv"), schema).collect()} == {3: "a, b", 4: None}
    yaml = pytest.importorskip("yaml", reason="no yaml package")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"model": {"dim": 4}}))
    assert io.read_config(str(tmp_path / "c.yaml")) == {"model": {"dim": 4}}


def test_a_header_goes_by_its_place(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("name\tn\nname\t1\nb\t2\nshort\n")
    (tmp_path / "y.tsv").write_text("other\theads\nc\t3\n")
    good, ragged = io.read_positional(spark, str(tmp_path), ["name", "n"], header=True)
    assert rows(good) == [("b", "2"), ("c", "3"), ("name", "1")] and rows(ragged) == [("short", 1)]


def test_fingerprint_follows_files_and_arguments(spark, tmp_path):
    (tmp_path / "x").write_text("1")
    one = io.fingerprint(spark, str(tmp_path), "a")
    assert one == io.fingerprint(spark, str(tmp_path), "a") != io.fingerprint(spark, str(tmp_path), "b")
    (tmp_path / "y").write_text("2")
    assert io.fingerprint(spark, str(tmp_path), "a") != one


def test_shards_side_by_side(spark):
    a = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "shard int, pos int, x string")
    b = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "shard int, pos int, y int")
    assert rows(io.zip_shards(a, b).select("x", "y")) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="shards differ in length"):
        io.zip_shards(a, b, strict=True).collect()
    assert rows(io.zip_shards(a.where("shard = 0"), b, strict=True).select("x", "y")) == [("a", 1), ("b", 2)]


def test_stream_of_means(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"g": "a", "v": 1}\n{"g": "a", "v": 3}\n{"g": "b", "v": 5}\n')
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("v", T.DoubleType())])
    q = manifest.scored_stream(spark, str(src), schema, "g", "v").writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("means")) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_names_and_metrics(spark):
    d = spark.createDataFrame([("_Z1f", "get_row"), ("g", "get_row")], "m string, t string")
    table = F.create_map(F.lit("_Z1f"), F.lit("ns::get_row(int)"))
    got = d.select(names.demangled(F.col("m"), table).alias("n"), "t").collect()
    assert [r["n"] for r in got] == ["ns_get_row", "g"]
    m = spark.createDataFrame([("get_row", "row_get")], "p string, t string").select(metrics.all_metrics(F.col("p"), F.col("t")).alias("m")).first()["m"]
    assert (m["precision"], m["recall"], m["f1"], m["exact"]) == (1.0, 1.0, 1.0, False) and 0 < m["ngram"] < 1 and 0 < m["edit"] < 1
    e = spark.createDataFrame([([(0, 1), (1, 1)],), ([(0, 1), (1, 2)],), ([],)], "e array<struct<src:int,dst:int>>")
    assert [r[0] for r in e.select(code.has_loop(F.col("e"))).collect()] == [True, False, False]
    i = spark.createDataFrame([("text", "name")], "t string, a string").select(code.instruction_row(F.col("t"), F.col("a"), "Name it.").alias("r")).first()["r"]
    assert tuple(i) == ("Name it.", "\n\ntext", "name")
    p = spark.createDataFrame([([5, 6],), ([1, 2, 3, 4],)], "i array<int>").select(vocab.pad(F.col("i"), 3, 9).alias("p"))
    assert [r["p"] for r in p.collect()] == [[5, 6, 9], [1, 2, 3]]


def test_json_text(spark):
    texts = ["", "plain", 'q"b\\s', "tab\tnl\ncr\rff\fbs\b", "é€ 😀 ü", "\x01\x1f\x7f", "a/b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(code.json_text(F.col("t")).alias("j")).collect()
    assert [r["j"] for r in got] == [json.dumps(t) for t in texts]


def test_linearised_function(spark):
    kind = "c array<string>, s array<string>, e array<array<string>>, r array<array<string>>, b array<struct<id:string,addr:long,tokens:array<string>>>, g array<struct<src:string,dst:string>>"
    blocks = [("y", 32, ["D"]), ("x", 16, ["A", "B"] + ["T"] * 30), ("z", 48, [])]
    full = (["puts", "", "exit"], ['say "hi"', "x" * 70], [["A", "B"], ["C"]], [["E"]], blocks, [("x", "z"), ("x", "y"), ("x", "y"), ("y", "q")])
    bare = ([], [], [], [], [], [])
    a, b = (r["l"] for r in spark.createDataFrame([full, bare], kind).select(code.linearised(*[F.col(c) for c in "cserbg"]).alias("l")).collect())
    assert a == "\n".join(["EXT: puts exit", 'STR: "say \\"hi\\"" "' + "x" * 60 + '"', "CALLEES: A B ; C", "CALLERS: E", "B0: A B " + " ".join(["T"] * 18) + " -> B1 B2", "B1: D", "B2: "])
    assert b == "EXT: none"


def test_neighbour_prompt(spark):
    text = "/* Reverse-engineered function description.\n * Library calls: puts()\n * Internal calls: (none)\n * Size: 2 blocks, 9 instructions */"
    d = spark.createDataFrame([(text, [(text, "say_hi", 0.91234), ("junk", "other", None)])], "t string, n array<struct<text:string,name:string,sim:double>>")
    got = d.select(code.neighbour_prompt(F.col("t"), F.col("n")).alias("p")).first()["p"]
    facts = "//   library_calls: puts()\n//   internal_calls: (none)\n//   called_by: (none)\n//   size: 2 blocks, 9 instructions\n"
    none = "//   library_calls: (none)\n//   internal_calls: (none)\n//   called_by: (none)\n//   size: (unknown)\n"
    want = code.NEIGHBOUR_HEAD + "// Nearest neighbor #1 (similarity: 0.912):\n" + facts + "//   name: say_hi\n\n// Nearest neighbor #2:\n" + none + "//   name: other\n\n" + code.NEIGHBOUR_TARGET + facts + "//   name:"
    assert got == want


def test_picks(spark):
    d = spark.createDataFrame([(0.2, "k", "g"), (0.5, "k", "g"), (0.7, "k", "g"), (None, "k", "g"), (0.1, None, "g")], "s double, k string, g string")
    f = [tuple(r[0]) for r in d.select(predictions.forward_pick(F.col("s"), 0.5, F.col("k"), F.col("g"))).collect()]
    assert f == [("k", True), ("k", True), ("g", False), ("g", False), ("g", False)]
    r = [tuple(r[0]) for r in d.select(predictions.reverse_pick(F.col("s"), 0.5, F.col("k"), F.col("g"))).collect()]
    assert r == [("g", False), ("k", True), ("k", True), ("g", False), ("g", False)]


def test_models_on_separable_rows(spark):
    r = random.Random(1)
    data = [(x, y, float(x + y > 1), 2 * x - y + 3, 1.0, i) for i, (x, y) in enumerate((r.random(), r.random()) for _ in range(300))]
    d = spark.createDataFrame(data, "x double, y double, l double, o double, w double, k long").cache()
    (a, b), c, r2 = router.ols(d, ["x", "y"], "o")
    assert (round(a, 6), round(b, 6), round(c, 6), round(r2, 6)) == (2.0, -1.0, 3.0, 1.0)
    right = lambda m: m.transform(d).where("prediction = l").count() / 300
    assert right(router.logistic_router(d, ["x", "y"], "l", "w")) > 0.95
    assert right(router.gbt_router(d, ["x", "y"], "l", "w", 20)) > 0.9
    assert right(router.mlp_router(d, ["x", "y"], "l", "w", "k")) > 0.9
    err = router.abstention(d, ["x", "y"], "l", 20).transform(d).select(F.avg(F.abs(F.col("prediction") - F.col("l")))).first()[0]
    assert err < 0.35
    got = dict(router.ablation(d, d, {"first": ["x"], "second": ["y"]}, "l", "w"))
    assert got["none"] > 0.95 > max(got["first"], got["second"])
    d.unpersist()


def test_leakage_with_aliases_and_small_bodies(spark):
    kind = "g string, n string, b string, t int, e boolean, a array<string>"
    train = spark.createDataFrame([("t", "f", "B", 12, False, ["f_old"]), ("t", "h", "S", 3, False, [])], kind)
    test = spark.createDataFrame([("p", "f", "B", 12, True, []), ("p", "x", "S", 3, False, ["f_old", "f"]), ("p", "y", "B", 20, False, None), ("q", "z", "Z", 1, None, [])], kind)
    got = {r["g"]: tuple(r)[1:] for r in split.leakage_table(train, test, "g", "n", "b", "t", "e", "a").collect()}
    assert got == {"p": (3, 66.7, 100.0, 33.3, 33.3), "q": (1, 0.0, 0.0, 0.0, 0.0)}
