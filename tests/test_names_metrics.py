import pytest
from pyspark.sql import functions as F

from weftline.functions import metrics as M
from weftline.functions import names as N


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name,want",
    [("selectExpander", ["select", "expander"]), ("fts3MIBufferAlloc", ["fts3", "mi", "buffer", "alloc"]), ("HTMLParser", ["html", "parser"]), ("close _ stdout", ["close", "stdout"]), ("__", []), ("a-b.c", ["a", "b", "c"]), ("éclairNom", ["éclair", "nom"])],
)
def test_split_name(spark, name, want):
    assert one(spark, N.split_name(F.col("a")), a=name) == want


@pytest.mark.parametrize("p,t,f1", [("selectExpander", "select_expander", 1.0), ("os_close", "__db_stat_print", 0.0), ("a_a_b", "a_b_b", 2 / 3), ("", "", 1.0), ("", "x", 0.0)])
def test_f1(spark, p, t, f1):
    assert one(spark, M.prf(F.col("a"), F.col("b"))["f1"], a=p, b=t) == pytest.approx(f1)
    assert one(spark, M.prf(F.col("b"), F.col("a"))["f1"], a=p, b=t) == pytest.approx(f1)


@pytest.mark.parametrize("p,t,dice,edit", [("", "", 0.0, 1.0), ("", "x", 0.0, 0.0), ("close _ stdout", "close_stdout", 1.0, 1.0), ("hash_lookup", "hash_find", 2 * 3 / 16, 1 - 6 / 11)])
def test_dice_and_edit(spark, p, t, dice, edit):
    assert one(spark, M.char_ngram_dice(F.col("a"), F.col("b")), a=p, b=t) == pytest.approx(dice)
    assert one(spark, M.edit_similarity(F.col("a"), F.col("b")), a=p, b=t) == pytest.approx(edit)


def test_masks_and_canonical(spark):
    text, name = "foo food foo.part.0 foo", "foo"
    a, b = F.col("a"), F.col("b")
    assert one(spark, N.mask_first(a, b, "X"), a=text, b=name) == "X food foo.part.0 foo"
    assert one(spark, N.mask_all(a, b, "X"), a=text, b=name) == "X Xd X.part.0 X"
    assert one(spark, N.mask_whole_words(a, b, "X"), a=text, b=name) == "X food X.part.0 X"
    assert one(spark, N.mask_all(a, b, "X"), a=text, b="") == text
    assert one(spark, N.canonical_name(a), a="ns::Cls<int>::run(int, char)") == "Cls_run"
    assert one(spark, N.votes_subtokens(a), a="hash_tableLook") == ["hash", "_", "table", "_", "look"]
    assert one(spark, N.opt_of(a), a="pkg_tool_O2") == "O2"
    assert one(spark, N.digest_tokens(a), a='printf sendRequest 1234 "for" ab') == ["send", "request"]
    assert one(spark, N.string_tokens_v1(a), a="bad %d file_name 12 is ok") == ["bad", "file_name", "is", "ok"]


def test_patterns_of_a_statement_are_tried_once(spark):
    from pyspark.sql import functions as F

    from weftline.functions import code

    lines = [("1a: RBX := 0x%s" % h,) for h in ("0", "000", "1", "0f", "40", "ff", "ffff", "10000", "8000000000000000", "123456789abcdef0")]
    lines += [("RBX := 12",), ("RBX := 7]",), ("RBX := #0x10 + 9",), ("RBX := 99999999999999999999",), ("call @sub_40 with return %1",), ("",), (None,)]
    df = code.with_class(spark.createDataFrame(lines, "s string"), "s", "c")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 4
    got = df.select("c", code.instruction_class(F.col("s")).alias("o")).collect()
    assert all(r["c"] == r["o"] for r in got)
    want = ["_ZERO", "_ZERO", "_ONE", "_SMALL", "_POW2", "_BYTE", "_WORD", "_POW2", "_POW2", "_ADDR", "_SMALL", ""]
    assert [r["c"] for r in got[:12]] == ["ASSIGN" + w for w in want] and got[14]["c"] == "CALL_INTERNAL"
