"""Intermediate-representation text: sections carried forward, statement classes, literals, blocks and edges."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.code import ARGUMENTS, FLAGS, instruction_class
from weftline.operators.joins import FEW_ROWS
from weftline.operators.ranges import carried
from weftline.operators.split import _cut

# Literals with names, and intrinsic name parts with their classes, in order.
MAGIC = {"7fffffff": "INT_MAX", "ffffffff": "U32_MAX", "7fffffffffffffff": "I64_MAX", "ffffffffffffffff": "U64_MAX", "1000": "PAGE", "ff": "BYTE_MASK", "3f": "MASK6", "1f": "MASK5", "f": "MASK4", "100": "K256", "400": "K1024", "10000": "K64K"}
INTRINSICS = [
    ("is_nan", "FP_ISNAN"), ("forder", "FP_CMP"), ("fadd", "FP_ADD"), ("fsub", "FP_SUB"), ("fmul", "FP_MUL"), ("fdiv", "FP_DIV"),
    ("fsqrt", "FP_SQRT"), ("cast_sfloat", "FP_CAST_TO_FLOAT"), ("cast_sint", "FP_CAST_TO_INT"), ("cast_uint", "FP_CAST_TO_INT"),
    ("fconvert", "FP_CONVERT"), ("fround", "FP_ROUND"), ("hlt", "TRAP"), ("__ud2", "TRAP"), ("ud2", "TRAP"), ("int3", "TRAP"),
]


def carry_forward(lines: DataFrame, by: list[str], order: str | list[str], value: Column, out: str) -> DataFrame:
    """The last non-null value at or before each row of its group, whatever the size of the group; order tells its rows apart."""
    return carried(lines, [order] if isinstance(order, str) else order, {out: value}, by=by)


def literal_token(h: Column) -> Column:
    """Class of one hexadecimal literal (digits without 0x)."""
    d = F.coalesce(F.nullif(F.ltrim(F.lower(h), F.lit("0")), F.lit("")), F.lit("0"))
    v = F.conv(d, 16, 10).cast("decimal(20,0)")
    named = F.create_map(*[F.lit(x) for k, n in MAGIC.items() for x in (k, f"LIT_{n}")])
    one_bit = d.rlike("^[1248]0*$")
    power = (F.length(d) - 1) * 4 + F.floor(F.log2(F.conv(F.substring(d, 1, 1), 16, 10).cast("double"))).cast("int")
    small = F.when(v == 0, "LIT_0").when(v <= 16, F.concat(F.lit("LIT_"), v.cast("string"))).when(v.between(0x20, 0x7E), "LIT_CHR")
    rest = F.when(one_bit, F.concat(F.lit("LIT_POW2_"), power.cast("string"))).when(v < 0x1000, "LIT_SMALL12").otherwise(F.concat(F.lit("LIT_HI"), F.least(F.length(h), F.lit(16)).cast("string")))
    return F.coalesce(F.try_element_at(named, d), small, rest)


def literal_tokens(stmt: Column) -> Column:
    return F.transform(F.regexp_extract_all(stmt, F.lit("(?:^|[^#\\w])0x([0-9a-fA-F]+)\\b"), F.lit(1)), literal_token)


def intrinsic_token(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for part, cls in INTRINSICS:
        out = F.when(low.contains(part), cls) if out is None else out.when(low.contains(part), cls)
    return out.otherwise("INTRINSIC_OTHER")


def branch_token(stmt: Column) -> Column:
    """COND_BRANCH with the flags of the condition in canonical order."""
    cond = F.substring_index(F.regexp_extract(stmt, "when(.*)", 1), "goto", 1)
    flags = F.array_compact(F.array(*[F.when(cond.rlike(rf"\b{f}\b"), F.lit(f)) for f in FLAGS]))
    return F.when(F.size(flags) > 0, F.concat(F.lit("COND_BRANCH_"), F.array_join(flags, "_"))).otherwise("COND_BRANCH")


def statements(line: Column) -> Column:
    """The statements of a line on which two terms may be printed together."""
    return F.split(F.regexp_replace(line, "(%[0-9a-fA-F]{8})([0-9a-fA-F]{8}: )", "$1\u0001$2"), "\u0001")


def call_kind(name: Column, external: Column, stub: Column, defined: Column) -> Column:
    """internal_sub, syscall, import or internal_named, of the name after an at sign."""
    sub = name.rlike("^sub_[0-9a-fA-F]+(sub_|$)")
    return F.when(sub, "internal_sub").when(name == "interrupt", "syscall").when(external | stub | ~defined, "import").otherwise("internal_named")


# Section and start-up subroutines.
SECTIONS = (".plt", ".init", ".fini", ".text", ".plt.sec", ".plt.got")
START_UP = (
    "_start", "_init", "_fini", "register_tm_clones", "deregister_tm_clones", "frame_dummy", "__do_global_dtors_aux", "__do_global_ctors_aux",
    "__libc_csu_init", "__libc_csu_fini", "_dl_relocate_static_pie",
)


def statements_of(lines: DataFrame) -> DataFrame:
    """(binary, at, sub_at, sub, block, block_at, addr, sub_addr, stmt) of IR text lines(binary, line_no, value).

    What a line is decides what is carried forward: an address to the lines after it, a subroutine and a block to their
    statements, a statement to the indented lines that continue it. Two statements printed as one are parted.
    """
    v = F.col("value")
    hexa = r"^([0-9a-fA-F]+): "
    kind = (
        F.when(F.trim(v) == "", "blank").when(v.rlike(r"^[0-9a-fA-F]+:\s+program\s*$"), "blank").when(v.rlike(r"^\.address 0x[0-9a-fA-F]+\s*$"), "address")
        .when(v.rlike(hexa + r"sub (\S+?)\((.*)\)\s*$"), "sub").when(v.rlike(hexa + r"\S+ :: (in out|in|out) "), "param")
        .when(v.rlike(r"^[0-9a-fA-F]+:\s*$"), "block").when(v.rlike(hexa), "stmt").when(v.rlike(r"^\s"), "more").otherwise("blank")
    )
    # Written first, as dealing by ranges reads its rows twice.
    s = _cut(lines.select("binary", "line_no", "value", kind.alias("kind")).where("kind <> 'blank'"))
    at = F.col("line_no")
    # Line numbers ascend, so the last is the greatest; a binary of any size is shared by many tasks.
    s = carried(s, ["line_no"], {
        "addr": F.when(F.col("kind") == "address", F.conv(F.regexp_extract(v, r"0x([0-9a-fA-F]+)", 1), 16, 10).cast("long")),
        "sub_at": F.when(F.col("kind") == "sub", at),
        "block_at": F.when(F.col("kind").isin("block", "sub"), at),
        "head_at": F.when(F.col("kind") != "more", at),
        "stmt_at": F.when(F.col("kind") == "stmt", at),
    }, by=["binary"])
    return s.where("sub_at is not null")


#: What read_subs says of a subroutine: at counts from its line, each line being 1,024; first is the number of its statements before a block; popped is the
#: register that a call finds popped from the stack.
_READ = (
    "binary string, sub_at long, sub string, sub_addr long, stub boolean, in_args long, has_result boolean, num_blocks long, n_stmts long, first_addr long, "
    "edges array<struct<src:int,dst:int>>, blocks array<struct<label:string,addr:long,first:int,stmts:array<struct<at:long,addr:long,popped:string,stmt:string>>>>"
)
_HEXA, _ADDRESS = re.compile(r"[0-9a-fA-F]+:"), re.compile(r"\.address 0x([0-9a-fA-F]+)\s*$", re.ASCII)
_SUB, _PARAM = re.compile(r"[0-9a-fA-F]+: sub (\S+?)\(.*\)\s*$", re.ASCII), re.compile(r"[0-9a-fA-F]+: (\S+) :: (in out|in|out) ", re.ASCII)
_OWN, _TWO = re.compile(r"call @([^\s(]+):external", re.ASCII), re.compile(r"(%[0-9a-fA-F]{8})([0-9a-fA-F]{8}: )")
_NUMBER, _SPACES, _OTHER_SPACES = re.compile(r"^[0-9a-fA-F]+: "), re.compile(r"\s+", re.ASCII), re.compile(r"  |[\t\n\r\f\v]")
_JUMP, _POP = re.compile(r"(?:goto|return)\s+%([0-9a-fA-F]+)", re.ASCII), re.compile(r"(#[0-9]+) := mem\[RSP, el\]:u64$")
_WHITE = " \t\n\r\f\v"


class _Sub:
    """A subroutine while its lines are read in order."""

    def __init__(self, at: int, name: str, addr: int | None):
        self.at, self.name, self.addr = at, name, addr
        self.stub, self.in_args, self.has_result = False, 0, False
        self.blocks, self.jumps, self.n = [], [], 0
        self.label = self.block = self.text = None
        self.popped = ""

    def open(self, label: str, addr: int | None) -> None:
        """A block begins; it counts from its first statement on."""
        self.label, self.block, self.popped = (label, addr), None, ""

    def close(self) -> None:
        """The statement whose lines have come is done; two terms printed as one are parted."""
        if self.text is None:
            return
        (at, addr, lines), self.text = self.text, None
        if self.label is None:
            return
        text = " ".join(lines)
        if self.block is None:
            self.block = (*self.label, self.n, [])
            self.blocks.append(self.block)
        parts = _TWO.sub("\\1\1\\2", text).split("\1") if "%" in text or "\1" in text else [text]
        for i, raw in enumerate(parts):
            stmt = _NUMBER.sub("", raw)
            stmt = (_SPACES.sub(" ", stmt) if _OTHER_SPACES.search(stmt) else stmt).strip(" ")
            self.block[3].append(((at - self.at) * 1024 + i, addr, self.popped if self.popped and stmt.startswith("call") else None, stmt))
            self.n += 1
            if "%" in stmt:
                self.jumps += [(len(self.blocks) - 1, to.lower()) for to in _JUMP.findall(stmt)]
            if not stmt.startswith(("when ", "RSP := RSP + 8")):
                m = _POP.match(stmt) if stmt.startswith("#") else None
                self.popped = m[1] if m else ""

    def edges(self) -> list[tuple[int, int]]:
        ids: dict[str, list[int]] = {}
        for i, b in enumerate(self.blocks):
            ids.setdefault(b[0], []).append(i)
        return list(dict.fromkeys((src, dst) for src, to in self.jumps for dst in ids.get(to, ())))


def _subs(values: Iterable[str | None], numbers: Iterable[int], addr: int | None) -> Iterator[_Sub]:
    """The subroutines of lines in order, the kinds of which are those of statements_of; addr is the address before the first line."""
    sub = None
    for v, at in zip(values, numbers, strict=True):
        if v is None:
            continue
        m = _HEXA.match(v)
        if m is None:
            if v.startswith(".address "):
                if a := _ADDRESS.match(v):
                    addr = int(a[1], 16)
                    if sub:
                        sub.close()
                continue
            if v[:1] not in _WHITE or not v.strip(" "):
                continue
            if sub and sub.text:
                sub.text[2].append(v.strip(" "))
            kind = "more"
        else:
            after = v[m.end() :]
            if not after.strip(_WHITE):
                kind = "block"
            elif after[0] in _WHITE and after.strip(_WHITE) == "program":
                continue
            elif after[0] != " ":
                continue
            elif after.startswith(" sub ") and (a := _SUB.match(v)):
                if sub:
                    sub.close()
                    yield sub
                sub, kind = _Sub(at, a[1], addr), "sub"
            else:
                kind = "param" if " :: " in after and _PARAM.match(v) else "stmt"
        if sub is None:
            raise ValueError(f"line {at} begins no subroutine and is in none: rows of lines hold whole subroutines")
        if ":external" in v and (a := _OWN.search(v)) and a[1] == sub.name:
            sub.stub = True
        if kind == "more":
            continue
        sub.close()
        if kind == "stmt":
            sub.text = (at, addr, [v])
        elif kind == "block":
            sub.open(v[: m.end() - 1].lower(), addr)
        elif kind == "param":
            name, way = _PARAM.match(v).groups()
            sub.in_args += way != "out"
            sub.has_result |= way == "out" or name.endswith("_result")
    if sub:
        sub.close()
        yield sub


def read_subs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A step for mapInArrow: rows (binary, line_no, numbers, addr, value) of lines become a row a subroutine. Without numbers, lines count from line_no."""

    def nested(parts: list[list], types: list[pa.DataType], names: list[str], sizes: list[int]) -> pa.Array:
        fields = [t if isinstance(t, pa.Array) else pa.array(p, t) for p, t in zip(parts, types, strict=True)]
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.StructArray.from_arrays(fields, names))

    def table(found: list[tuple[str, _Sub]]) -> pa.RecordBatch:
        subs = [x for _, x in found]
        blocks = [b for x in subs for b in x.blocks]
        stmts = [s for b in blocks for s in b[3]]
        column = lambda rows, i: [r[i] for r in rows]
        edges = [x.edges() for x in subs]
        flat = [e for es in edges for e in es]
        inner = nested([column(stmts, i) for i in range(4)], [pa.int64(), pa.int64(), pa.string(), pa.string()], ["at", "addr", "popped", "stmt"], [len(b[3]) for b in blocks])
        held = nested([*[column(blocks, i) for i in range(3)], []], [pa.string(), pa.int64(), pa.int32(), inner], ["label", "addr", "first", "stmts"], [len(x.blocks) for x in subs])
        joined = nested([column(flat, 0), column(flat, 1)], [pa.int32(), pa.int32()], ["src", "dst"], list(map(len, edges)))
        made = {
            "binary": pa.array([b for b, _ in found], pa.string()), "sub_at": pa.array([x.at for x in subs], pa.int64()), "sub": pa.array([x.name for x in subs], pa.string()), "sub_addr": pa.array([x.addr for x in subs], pa.int64()),
            "stub": pa.array([x.stub for x in subs], pa.bool_()), "in_args": pa.array([x.in_args for x in subs], pa.int64()), "has_result": pa.array([x.has_result for x in subs], pa.bool_()),
            "num_blocks": pa.array([len(x.blocks) for x in subs], pa.int64()), "n_stmts": pa.array([x.n for x in subs], pa.int64()), "first_addr": pa.array([x.blocks[0][1] if x.blocks else None for x in subs], pa.int64()),
            "edges": joined, "blocks": held,
        }
        return pa.RecordBatch.from_pydict(made)

    for batch in batches:
        binary, first, addr = (batch.column(c).to_pylist() for c in ("binary", "line_no", "addr"))
        value, numbers = batch.column("value"), batch.column("numbers")
        found = []
        for i, b in enumerate(binary):
            if b is None or not value[i].is_valid:
                continue
            vs = value[i].values.to_pylist()
            at = numbers[i].values.to_pylist() if numbers[i].is_valid else range(first[i], first[i] + len(vs))
            found += [(b, x) for x in _subs(vs, at, addr[i])]
        for i in range(0, len(found), 2000):
            yield table(found[i : i + 2000])


def once(value: Column, f) -> Column:
    """f of a column that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few."""
    return df if df.count() > FEW_ROWS else F.broadcast(df)


def _target(stmt: Column) -> Column:
    return F.nullif(F.when(stmt.startswith("call"), F.regexp_extract(stmt, r"\bcall\s+(@[^\s(]+|#\d+|mem\b[^\s]*|R[A-Z0-9]+|\S+)", 1)), F.lit(""))


def _callee(target: Column) -> Column:
    return F.when(target.startswith("@") & ~target.startswith("@intrinsic:"), F.regexp_extract(target, r"^@([^:]+)", 1))


def _asked(target: Column, callee: Column) -> Column:
    """The callee if other subroutines of its binary decide whether it is imported."""
    return F.when(call_kind(callee, target.contains(":external"), F.lit(False), F.lit(True)) == "internal_named", callee)


def _kind(target: Column, callee: Column, back: Column, imported: Column) -> Column:
    known = call_kind(callee, target.contains(":external"), F.coalesce(imported, F.lit(False)), F.lit(True))
    return F.when(target.isNull() | back, None).when(target.startswith("@intrinsic:"), "intrinsic").when(callee.isNotNull(), known).otherwise("indirect")


def _back(stmt: Column, target: Column, popped: Column) -> Column:
    return target.startswith("#") & stmt.contains("noreturn") & (F.coalesce(popped, F.lit("")) == target)


def _token(stmt: Column, target: Column, callee: Column, back: Column, kind: Column) -> Column:
    of_call = (
        F.when(kind == "intrinsic", intrinsic_token(F.substring(target, 12, 1 << 20))).when(kind == "syscall", "SYSCALL")
        .when(kind == "import", F.concat(F.lit("CALL_"), callee)).when(kind.isin("internal_sub", "internal_named"), "CALL_INTERNAL")
        .when(back, "RETURN").when(stmt.contains("noreturn"), "TAILJUMP_INDIRECT").otherwise("CALL_INDIRECT")
    )
    return F.when(target.isNotNull(), of_call).when(stmt.startswith("when "), branch_token(stmt)).otherwise(instruction_class(stmt))


class Parsed:
    """Tables of parsed IR text, each worked out when it is first asked for: functions, blocks, edges, calls, statements.

    read is the written table of read_subs, a row a subroutine, so what stays inside one needs no shuffle. Only what other subroutines decide is
    joined: whether a later one has its name, and whether what it calls by name is there.
    """

    def __init__(self, read: DataFrame):
        self.read = read

    @cached_property
    def _odd(self) -> DataFrame:
        """(binary, sub, last_at, is_stub) of names that come again or are stubs."""
        g = self.read.groupBy("binary", "sub").agg(F.max("sub_at").alias("last_at"), F.bool_or("stub").alias("is_stub"), F.count("*").alias("c"))
        return _few(_cut(g.where("c > 1 or is_stub").drop("c")))

    @cached_property
    def _last(self) -> DataFrame:
        """Subroutines with statements, the last of each name."""
        kept = self.read.where("n_stmts > 0").join(self._odd, ["binary", "sub"], "left").where("last_at is null or sub_at = last_at")
        return kept.select(*[c for c in self.read.columns if c != "stub"], F.coalesce("is_stub", F.lit(False)).alias("stub"))

    def _of_blocks(self, *columns: str) -> DataFrame:
        b = self._last.select("binary", "sub", "sub_at", *columns, F.posexplode("blocks").alias("id", "b"))
        return b.select("binary", "sub", "sub_at", *columns, "id", "b.*")

    def _of_statements(self, *columns: str) -> DataFrame:
        s = self._of_blocks(*columns).select("binary", "sub", "sub_at", *columns, "id", "first", F.posexplode("stmts").alias("i", "s"))
        s = s.select("binary", "sub", *columns, "id", (F.col("first") + F.col("i") + 1).alias("n"), (F.col("sub_at") * 1024 + F.col("s.at")).alias("at"), "s.addr", "s.popped", "s.stmt")
        s = s.withColumn("target", _target(F.col("stmt"))).withColumn("callee", _callee(F.col("target")))
        return s.withColumn("ask", _asked(F.col("target"), F.col("callee")))

    @cached_property
    def _imported(self) -> DataFrame:
        """(binary, ask, imported) of callees: stubs and names that no subroutine of the binary has."""
        asked = _cut(self._of_statements().where("ask is not null").select("binary", "ask").distinct())
        there = self.read.select("binary", F.col("sub").alias("ask")).join(_few(asked), ["binary", "ask"], "left_semi").distinct().withColumn("there", F.lit(True))
        stubs = self._odd.where("is_stub").select("binary", F.col("sub").alias("ask"), "is_stub")
        j = asked.join(there, ["binary", "ask"], "left").join(stubs, ["binary", "ask"], "left")
        return _few(_cut(j.select("binary", "ask", (F.col("there").isNull() | F.col("is_stub").isNotNull()).alias("imported"))))

    def _with_kind(self, *columns: str) -> DataFrame:
        s = self._of_statements(*columns).join(self._imported, ["binary", "ask"], "left")
        s = s.withColumn("back", _back(F.col("stmt"), F.col("target"), F.col("popped")))
        return s.withColumn("kind", _kind(F.col("target"), F.col("callee"), F.col("back"), F.col("imported")))

    @cached_property
    def statements(self) -> DataFrame:
        token = _token(*map(F.col, ("stmt", "target", "callee", "back", "kind")))
        return self._with_kind().select("binary", "sub", "at", "id", "stmt", token.alias("token"))

    @cached_property
    def calls(self) -> DataFrame:
        called = F.when(F.col("kind") == "intrinsic", F.substring("target", 2, 1 << 20)).otherwise(F.col("callee"))
        tail = F.when(F.col("kind") != "intrinsic", F.col("stmt").contains("noreturn"))
        return self._with_kind().where("kind is not null").select("binary", "sub", "at", "kind", called.alias("name"), "id", "addr", tail.alias("tail"))

    @cached_property
    def edges(self) -> DataFrame:
        return self._last.select("binary", "sub", F.explode("edges").alias("e")).select("binary", "sub", "e.src", "e.dst")

    @cached_property
    def blocks(self) -> DataFrame:
        """A block has one callee to ask for at most, mostly, which is looked up for its row; only blocks of several are put together again."""
        b = self._of_blocks()
        asks = F.array_distinct(F.array_compact(F.transform("stmts", lambda x: once(_target(x["stmt"]), lambda t: _asked(t, _callee(t))))))
        b = b.withColumn("asks", asks)
        one = b.where("size(asks) <= 1").withColumn("ask", F.get("asks", F.lit(0))).join(self._imported, ["binary", "ask"], "left")
        one = one.withColumn("known", F.when(F.col("imported"), F.array("ask")))
        key = ["binary", "sub", "id"]
        many = b.where("size(asks) > 1")
        known = many.select(*key, F.explode("asks").alias("ask")).join(self._imported.where("imported"), ["binary", "ask"]).groupBy(*key).agg(F.collect_list("ask").alias("known"))
        names = [*key, "label", "addr", "stmts", "known"]
        b = one.select(*names).unionByName(many.join(known, key, "left").select(*names))
        held = F.coalesce("known", F.array().cast("array<string>"))

        def said(x):
            def of(t, c):
                back = _back(x["stmt"], t, x["popped"])
                kind = _kind(t, c, back, F.array_contains(held, c))
                return once(kind, lambda k: F.struct(_token(x["stmt"], t, c, back, k).alias("token"), F.when(k == "import", c).alias("external")))

            return once(_target(x["stmt"]), lambda t: once(_callee(t), lambda c: of(t, c)))

        b = b.withColumn("said", F.transform("stmts", said))
        lits = F.flatten(F.transform("stmts", lambda x: literal_tokens(x["stmt"])))
        return b.select(*key, "label", "addr", F.array_compact("said.token").alias("tokens"), lits.alias("lits"), F.get(F.array_compact("said.external"), F.lit(0)).alias("external"))

    @cached_property
    def functions(self) -> DataFrame:
        held = ("stub", "sub_addr", "first_addr", "num_blocks", "n_stmts", "in_args", "has_result")
        f = self._with_kind(*held).groupBy("binary", "sub", *held).agg(F.count_if(F.col("kind") == "import").alias("n_import_calls"))
        regs = register_use(self._of_statements()).groupBy("binary", "sub").agg(F.array_sort(F.collect_list("reg")).alias("arg_regs"))
        what = (
            F.when(F.col("sub").startswith("intrinsic:"), "intrinsic").when(F.col("stub"), "plt_stub").when(F.col("sub").isin(*SECTIONS) | F.col("sub").startswith("."), "section")
            .when(F.col("sub").isin(*START_UP), "crt").when(F.col("sub").rlike("^sub_[0-9a-fA-F]+(sub_|$)"), "sub_addr").otherwise("named")
        )
        none = F.array().cast("array<string>")
        return f.join(regs, ["binary", "sub"], "left").select("binary", "sub", what.alias("name_kind"), F.coalesce("sub_addr", "first_addr").alias("entry"), "num_blocks", "n_stmts", "n_import_calls", "in_args", "has_result", F.coalesce("arg_regs", none).alias("arg_regs"))


def parse(lines: DataFrame) -> Parsed:
    """Functions of IR text lines(binary, line_no, value).

    A value is a line, or an array of whole subroutines' lines, each after its address, the first of which is of number line_no. Single lines are brought together
    first, by values carried over the lines of a binary; a subroutine is one row from there on.

    functions(binary, sub, name_kind, entry, num_blocks, n_stmts, n_import_calls, in_args, has_result, arg_regs),
    blocks(binary, sub, id, label, addr, tokens, lits, external), edges(binary, sub, src, dst) between block ids,
    calls(binary, sub, at, kind, name, id, addr, tail), statements(binary, sub, at, id, stmt, token). A subroutine name that
    comes again in a binary replaces the one before; blocks and functions without statements are left out.
    """
    if isinstance(lines.schema["value"].dataType, T.ArrayType):
        rows = lines.select("binary", "line_no", F.lit(None).cast("array<long>").alias("numbers"), F.lit(None).cast("long").alias("addr"), "value")
    else:
        x = F.array_sort(F.collect_list(F.struct("line_no", "value")))
        s = statements_of(lines).groupBy("binary", "sub_at").agg(x.alias("x"), F.max(F.when(F.col("kind") == "sub", F.col("addr"))).alias("addr"))
        rows = s.select("binary", F.col("sub_at").alias("line_no"), F.col("x.line_no").alias("numbers"), "addr", F.col("x.value").alias("value"))
    return Parsed(_cut(rows.mapInArrow(read_subs, _READ), "zstd"))


def global_references(parsed: Parsed) -> DataFrame:
    """(binary, sub, address) of constants of 0x1000 and more outside jumps, once each."""
    found = F.explode(F.regexp_extract_all("stmt", F.lit(r"(?<![#\w])0x([0-9a-fA-F]+)\b"), F.lit(1)))
    a = parsed.statements.where(~F.col("stmt").contains("goto")).select("binary", "sub", found.alias("h"))
    a = a.select("binary", "sub", F.conv("h", 16, 10).cast("decimal(20,0)").alias("address"))
    return a.where("address >= 4096").distinct()


def register_use(statements: DataFrame, first: int = 40) -> DataFrame:
    """(binary, sub, reg) of argument registers whose first mention in the first statements of a function is not their own assignment."""
    s = statements.where(F.col("n") <= first).select("binary", "sub", "n", "stmt", F.explode(F.array(*map(F.lit, ARGUMENTS))).alias("reg"))
    s = s.where(F.regexp_like("stmt", F.concat(F.lit("\\b"), F.col("reg"), F.lit("\\b"))))
    put = F.col("stmt").contains(":=") & (F.trim(F.substring_index("stmt", ":=", 1)) == F.col("reg"))
    g = s.groupBy("binary", "sub", "reg").agg(F.min_by(put, "n").alias("put"))
    return g.where("not put").select("binary", "sub", "reg")


def fall_through(parsed: Parsed) -> DataFrame:
    """(binary, sub, src, dst) from each block to the next one, unless it ends in a jump or return: the older edge rule."""
    b = parsed.blocks.select("binary", "sub", F.col("id").alias("src"), F.element_at("tokens", -1).alias("token"))
    n = parsed.functions.select("binary", "sub", "num_blocks")
    return b.join(n, ["binary", "sub"]).where("src + 1 < num_blocks and coalesce(token, '') not in ('BRANCH', 'RETURN')").select("binary", "sub", "src", (F.col("src") + 1).alias("dst"))


def symbol_ranges(lines: DataFrame) -> DataFrame:
    """(name, start, stop): least start and greatest end of each name in lines(value) of "(name start end)"; other lines count for nothing."""
    m = r"^\((\S+) (\d+) (\d+)\)"
    v = F.trim("value")
    s = lines.where(v.rlike(m)).select(F.regexp_extract(v, m, 1).alias("name"), F.regexp_extract(v, m, 2).cast("long").alias("a"), F.regexp_extract(v, m, 3).cast("long").alias("b"))
    return s.groupBy("name").agg(F.min("a").alias("start"), F.max("b").alias("stop"))
