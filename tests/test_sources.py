from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources import io
from weftline.streaming import manifest


def test_tsv_and_json_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", True, [1, 2]), ("b", False, [])], "k string, f boolean, l array<int>")
    io.write_tsv(d, str(tmp_path / "t"))
    s = T.StructType([T.StructField("k", T.StringType()), T.StructField("f", T.IntegerType()), T.StructField("l", T.StringType())])
    assert sorted(map(tuple, io.read_tsv(spark, str(tmp_path / "t"), s).collect())) == [("a", 1, "1;2"), ("b", 0, None)]
    io.write_jsonl(d, str(tmp_path / "j"), ("k",))
    assert io.read_jsonl(spark, str(tmp_path / "j"), d.schema).where("k = 'a'").first()["l"] == [1, 2]


def test_log_pairs(spark, tmp_path):
    (tmp_path / "x.log").write_text("target: foo\noutput: bar baz\ntarget: lone\nother\n")
    got = io.log_pairs(io.read_lines(spark, str(tmp_path / "x.log"))).select("target", "output").collect()
    assert [tuple(r) for r in got] == [("foo", "bar baz")]


def test_chunks_and_remaining(spark):
    d = spark.range(10).withColumnRenamed("id", "k")
    assert sorted((r["k"], r["chunk"]) for r in io.chunked(d, "k", 4).collect()) == [(i, i // 4) for i in range(10)]
    assert io.remaining(d, d.where("k < 8"), "k").count() == 2


def test_stream_appends_each_key_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.json").write_text('{"k": "x", "v": 1.0}\n{"k": "%s", "v": 2.0}\n' % n)
        q = manifest.append_new(spark, str(tmp_path / "in"), schema, "k", str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("k")).collect()) == ["a", "b", "x"]


def test_objects_vectors_and_positional_rows(spark, tmp_path):
    import numpy as np

    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.json").write_text('{"n": 1}')
    (tmp_path / "o" / "b.json").write_text("{broken")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    rows, rejects = io.read_objects(spark, str(tmp_path / "o"), T.StructType([T.StructField("n", T.IntegerType())]), wanted, "k")
    assert [(r["file_key"], r["n"]) for r in rows.collect()] == [("a", 1)]
    assert sorted(map(tuple, rejects.collect())) == [("malformed", 1), ("missing", 1)]
    assert [tuple(r) for r in io.counts_by_folder(spark, str(tmp_path), "*.json").collect()] == [("o", 2)]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float16).reshape(3, 2))
    assert [(r["row"], r["v"]) for r in io.read_vectors(spark, str(tmp_path)).orderBy("row").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    (tmp_path / "p.tsv").write_text("a\t1\nb\t2\t3\nc\t4\n")
    good, ragged = io.read_positional(spark, str(tmp_path / "p.tsv"), ["k", "v"])
    assert sorted(map(tuple, good.collect())) == [("a", "1"), ("c", "4")] and [r["cells"] for r in ragged.collect()] == [3]


def test_cache_is_built_once_and_reports_are_whole(spark, tmp_path):
    import pytest

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.txt").write_text("x")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert io.cached(spark, str(tmp_path / "s"), str(tmp_path / "c"), build, 7).count() == 3
    assert len(calls) == 1 and io.cached(spark, str(tmp_path / "s"), str(tmp_path / "c"), build, 8).count() == 3 and len(calls) == 2
    assert io.markdown_report([("T", spark.range(1))]) == "## T\n\n| id |\n| --- |\n| 0 |\n"
    with pytest.raises(ValueError):
        io.markdown_table(spark.range(201))
    io.write_partitioned(spark.createDataFrame([("m", "t", 1), ("m", "u", 2)], "mode string, tier string, v int"), str(tmp_path / "w"), ["mode", "tier"])
    assert io.read_jsonl(spark, str(tmp_path / "w" / "mode=m" / "tier=u"), T.StructType([T.StructField("v", T.IntegerType())])).first()["v"] == 2
