"""Scores of names: sub-tokens are split once a row, and a small table is scored by many tasks."""

import pytest
from pyspark.sql import functions as F
from weftline.functions import metrics as M
from weftline.plans import registry


def test_sub_tokens_are_split_once(spark):
    df = spark.createDataFrame([("getItem_x", "set_item")], "p string, t string")
    plan = df.select(M.prf(F.col("p"), F.col("t")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 2
    plan = df.select(M.multiset_overlap(F.split("p", "_"), F.split("t", "_")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 2


def test_grams_are_cut_once(spark):
    df = spark.createDataFrame([("abcde", "abcdf"), ("", "x"), ("ab", "ab")], "p string, t string")
    d = df.select(M.char_ngram_dice(F.col("p"), F.col("t")).alias("m"))
    assert d._jdf.queryExecution().analyzed().toString().count("sequence(") == 2
    assert [r["m"] for r in d.collect()] == [pytest.approx(2 / 3), 0.0, 1.0]


@pytest.mark.parametrize("query", ["em_variants", "subtoken_f1", "reward"])
def test_names_are_dealt_to_many_tasks(spark, tmp_path, query):
    rows = [(i, f"word{i % 9} item", "B", "T", 1) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = registry.QUERIES[query](spark, str(tmp_path))
    assert out.count() == 39
    assert out.rdd.getNumPartitions() >= 4
