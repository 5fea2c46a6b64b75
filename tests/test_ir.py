"""Parsed IR text of two made-up programs: a queue with a stub, a guarded loop, both returns and tail calls."""

import os

import pytest
from pyspark.sql import functions as F
from weftline.operators import ir, ranges, split
from weftline.plans import registry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def listing(subs):
    """IR text of (address, name, parameters, blocks): terms are numbered as they come, each behind its address.

    A block is (label, [(address, statement)]). A statement may be a list: its further parts stand on lines of their own.
    """
    term, out = iter(range(0x5000, 0x9000)), ["00004fff: program"]
    for at, name, params, blocks in subs:
        out += [f".address {at:#x}", f"{next(term):08x}: sub {name}({', '.join(p for p, _ in params)})"]
        out += [f"{next(term):08x}: {p} :: {kind}" for p, kind in params] + [""]
        for label, stmts in blocks:
            out += [f".address {(stmts[0][0] if stmts else at):#x}", f"{label}:"]
            for a, stmt in stmts:
                first, *more = [stmt] if isinstance(stmt, str) else stmt
                out += [f".address {a:#x}", f"{next(term):08x}: {first}", *(f"        {m}" for m in more)]
    return out


QUEUE = listing([
    (0xA10, "strdup", [("strdup_s", "in u64 = RDI"), ("strdup_result", "out u64 = RAX")], [("0000d001", [(0xA10, "call @strdup:external with noreturn")])]),
    (0x7C00, "sub_7c00", [("sub_7c00_q", "in out u64 = RDI")], [
        ("0000e001", [(0x7C00, "RSP := RSP - 0x28"), (0x7C04, "CF := RDI < 9"), (0x7C08, "when CF | OF goto %0000e004"), (0x7C08, "goto %0000e002")]),
        ("0000e002", [(0x7C10, ["mem := mem with [RBP, el]:u32 <-", "0x3f"]), (0x7C14, "call @strdup with return %0000e003")]),
        ("0000e003", [(0x7C1A, "RAX := RAX * 0x40"), (0x7C1E, "goto %0000e002")]),
        ("0000e004", [(0x7C30, "#21 := mem[RSP, el]:u64"), (0x7C30, "RSP := RSP + 8"), (0x7C30, "call #21 with noreturn")]),
    ]),
    (0x8200, "enqueue", [], [
        ("0000f001", [(0x8200, "RSI := RDX"), (0x8203, "call @intrinsic:fsqrt_rne with return %0000f002")]),
        ("0000f002", [(0x8207, "call R12 with return %0000f003")]),
        ("0000f003", [(0x820A, "#30 := mem[RSP, el]:u64"), (0x820B, "call #30 with noreturn")]),
    ]),
    (0x8400, "dispatch", [("dispatch_result", "out u64 = RAX")], [
        ("0000f101", [(0x8400, "when ZF goto %0000f103"), (0x8402, "goto %0000f102")]),
        ("0000f102", [(0x8406, "call @sub_7c00 with noreturn")]),
        ("0000f103", [(0x8410, "#44 := RAX + 0x9100"), (0x8414, "call #44 with noreturn")]),
    ]),
])
OTHER = listing([
    (0x400, "_start", [], [("00001001", [(0x400, "call @enqueue with noreturn")])]),
    (0x480, "enqueue", [], [("00001101", [(0x480, "call @interrupt:external with return %00001102")]), ("00001102", [(0x486, "goto %00001101")])]),
])


@pytest.fixture(scope="module")
def parsed(spark):
    lines = [(b, i, x) for b, text in (("queue", QUEUE), ("other", OTHER)) for i, x in enumerate(text)]
    return ir.parse(spark.createDataFrame(lines, "binary string, line_no long, value string").repartition(3))


def test_functions(parsed):
    f = {(r["binary"], r["sub"]): r for r in parsed.functions.collect()}
    assert {k: r["name_kind"] for k, r in f.items()} == {("queue", "strdup"): "plt_stub", ("queue", "sub_7c00"): "sub_addr", ("queue", "enqueue"): "named", ("queue", "dispatch"): "named", ("other", "_start"): "crt", ("other", "enqueue"): "named"}
    g = f["queue", "sub_7c00"]
    assert (g["entry"], g["num_blocks"], g["n_stmts"], g["n_import_calls"], g["in_args"], g["has_result"], g["arg_regs"]) == (0x7C00, 4, 11, 1, 1, False, ["RDI"])
    assert f["queue", "strdup"]["has_result"] and f["queue", "dispatch"]["has_result"] and f["queue", "enqueue"]["arg_regs"] == ["RDX"]
    assert (f["other", "enqueue"]["entry"], f["other", "enqueue"]["num_blocks"]) == (0x480, 2)


def test_blocks_and_edges(parsed):
    edges = {}
    for r in parsed.edges.collect():
        edges.setdefault((r["binary"], r["sub"]), set()).add((r["src"], r["dst"]))
    assert edges == {("queue", "sub_7c00"): {(0, 1), (0, 3), (1, 2), (2, 1)}, ("queue", "enqueue"): {(0, 1), (1, 2)}, ("queue", "dispatch"): {(0, 1), (0, 2)}, ("other", "enqueue"): {(0, 1), (1, 0)}}
    toks = {(r["sub"], r["id"]): r["tokens"] for r in parsed.blocks.where("binary = 'queue'").collect()}
    assert toks["sub_7c00", 0] == ["STACK_OP", "FLAG_CF", "COND_BRANCH_CF_OF", "BRANCH"]
    assert toks["sub_7c00", 1][1] == "CALL_strdup" and toks["sub_7c00", 2] == ["RET_ARITH_MUL", "BRANCH"]
    assert toks["sub_7c00", 3] == ["STACK_LOAD_64", "STACK_OP", "RETURN"] and toks["enqueue", 2] == ["STACK_LOAD_64", "RETURN"]
    assert toks["enqueue", 0][1:] == ["FP_SQRT"] and toks["enqueue", 1] == ["CALL_INDIRECT"]
    assert toks["dispatch", 1] == ["CALL_INTERNAL"] and toks["dispatch", 2][1] == "TAILJUMP_INDIRECT"
    b = {(r["sub"], r["id"]): r for r in parsed.blocks.where("binary = 'queue'").collect()}
    assert b["sub_7c00", 1]["external"] == "strdup" and b["sub_7c00", 1]["lits"] == ["LIT_MASK6"] and b["sub_7c00", 2]["lits"] == ["LIT_CHR"]


def test_call_kinds(parsed):
    got = {}
    for r in parsed.calls.orderBy("binary", "sub", "at").collect():
        got.setdefault((r["binary"], r["sub"]), []).append((r["kind"], r["name"], r["tail"]))
    assert got["queue", "sub_7c00"] == [("import", "strdup", False)]
    assert got["queue", "enqueue"] == [("intrinsic", "intrinsic:fsqrt_rne", None), ("indirect", None, False)]
    assert got["queue", "dispatch"] == [("internal_sub", "sub_7c00", True), ("indirect", None, True)]
    assert got["other", "_start"] == [("internal_named", "enqueue", True)] and got["other", "enqueue"] == [("syscall", "interrupt", False)]


def test_references_fall_through_and_repeatability(spark, parsed):
    assert rows(ir.global_references(parsed).select("sub", F.col("address").cast("long"))) == [("dispatch", 0x9100)]
    assert rows(ir.fall_through(parsed).where("binary = 'queue' and sub = 'enqueue'").select("src", "dst")) == [(0, 1), (1, 2)]
    lines = spark.createDataFrame([("queue", i, x) for i, x in enumerate(QUEUE)], "binary string, line_no long, value string")
    again = ir.parse(lines)
    assert rows(again.statements) == rows(parsed.statements.where("binary = 'queue'"))


def test_literals_and_symbols(spark):
    lit = spark.createDataFrame([("y := 0x100 + 0x7e - 0x2000 + 0x11 + 0xffffffff + 0xfff + 0x123456",)], "s string").select(ir.literal_tokens(F.col("s")).alias("t")).first()["t"]
    assert lit == ["LIT_K256", "LIT_CHR", "LIT_POW2_13", "LIT_SMALL12", "LIT_U32_MAX", "LIT_SMALL12", "LIT_HI6"]
    sym = spark.createDataFrame([("(put 64 90)",), ("(put 60 80)",), ("(take 7 8)",), ("(put x 9)",), ("",)], "value string")
    assert rows(ir.symbol_ranges(sym)) == [("put", 60, 90), ("take", 7, 8)]


def test_carry_forward_over_a_large_group(spark):
    lines = spark.range(4000).selectExpr("'b' as binary", "id as line_no", "case when id % 900 = 10 then concat('s', id) end as mark").repartition(7)
    got = {r["line_no"]: r["section"] for r in ir.carry_forward(lines, ["binary"], "line_no", F.col("mark"), "section").collect()}
    assert got == {i: None if i < 10 else f"s{(i - 10) // 900 * 900 + 10}" for i in range(4000)}


def test_a_binary_is_shared_by_many_tasks(spark, monkeypatch):
    """The lines of one binary are dealt by ranges; what they carry is that of one pass in their order."""
    lines = [f"{i:08x}: sub f{i}()" if i % 40 == 0 else f"{i:08x}:" if i % 10 == 1 else f".address 0x{i:x}" if i % 7 == 0 else f"{i:08x}: RAX := {i}" for i in range(8000)]
    df = spark.createDataFrame([("b", i, v) for i, v in enumerate(lines)], "binary string, line_no long, value string")
    dealt, real = [], ranges.ranged
    monkeypatch.setattr(ranges, "ranged", lambda *a: dealt.append(real(*a)) or dealt[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = ir.statements_of(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in dealt[0].groupBy("__r").count().collect()) < 6000
    addr = sub = block = None
    want = {}
    for i, v in enumerate(lines):
        addr = i if v.startswith(".") else addr
        sub, block = (i, i) if " sub " in v else (sub, i if v.endswith(":") else block)
        want[i] = (addr, sub, block)
    assert {r["line_no"]: (r["addr"], r["sub_at"], r["block_at"]) for r in s.collect()} == want


def _as_arrays(spark, *programs):
    """The lines of each program cut before the address of every subroutine: an array a subroutine."""
    out = []
    for b, text in programs:
        starts = [i - 1 for i, x in enumerate(text) if " sub " in x]
        out += [(b, i, text[i:j]) for i, j in zip(starts, [*starts[1:], len(text)], strict=True)]
    return spark.createDataFrame(out, "binary string, line_no long, value array<string>").repartition(3)


def test_arrays_of_whole_subroutines_give_what_lines_give(spark, parsed):
    got = ir.parse(_as_arrays(spark, ("queue", QUEUE), ("other", OTHER)))
    for table in ("functions", "blocks", "edges", "calls", "statements"):
        assert rows(getattr(got, table)) == rows(getattr(parsed, table))
    part = spark.createDataFrame([("b", 0, ["0000000a: RAX := 1"])], "binary string, line_no long, value array<string>")
    with pytest.raises(Exception, match="hold whole subroutines"):
        ir.parse(part)


def test_text_is_not_shuffled_again(spark, monkeypatch):
    """Lines of whole subroutines are read once; edges, calls, statements and blocks join only what is small, and functions are counted once."""
    cuts, real = [], ir._cut
    monkeypatch.setattr(ir, "_cut", lambda df, *a: cuts.append(df) or real(df, *a))
    p = ir.parse(_as_arrays(spark, ("queue", QUEUE), ("other", OTHER)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for table in ("edges", "calls", "statements"):
        assert "hashpartitioning" not in plan(getattr(p, table))
    assert plan(p.functions.select("sub", "num_blocks", "n_import_calls")).count("hashpartitioning") == 1
    assert sum("stmts" in df.columns or "blocks" in df.columns for df in cuts) == 1


def test_blocks_of_several_callees(spark):
    text = listing([(0x10, "a", [], [("00000a01", [(0x10, "call @free with return %00000a01"), (0x11, "call @b with return %00000a01"), (0x12, "call @log with noreturn")]), ("00000a02", [(0x13, "call @b with noreturn")])]), (0x20, "b", [], [("00000b01", [(0x20, "call @b with noreturn")])])])
    want = [("a", 0, ["CALL_free", "CALL_INTERNAL", "CALL_log"], "free"), ("a", 1, ["CALL_INTERNAL"], None), ("b", 0, ["CALL_INTERNAL"], None)]
    assert rows(ir.parse(_as_arrays(spark, ("x", text))).blocks.select("sub", "id", "tokens", "external")) == want


@pytest.mark.parametrize("query", ["ir_edges", "ir_functions", "ir_blocks"])
def test_text_made_from_orders_takes_little_disk(spark, tmp_path, monkeypatch, query):
    """Of 40,000 lines, which give 187,000 lines of text, less than 2 MB of tables are written."""
    spark.range(40_000).selectExpr("id div 3 as l_orderkey", "cast(id % 3 + 1 as int) as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(split, "_shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert registry.QUERIES[query](spark, str(tmp_path)).count() > 13_000
    assert sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(f"{tmp_path}/shared") for f in fs) < 2_000_000
