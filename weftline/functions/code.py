"""Column functions over decompiled code and statements of an intermediate representation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import STOP, digest_tokens

_LITERAL = r'"((?:[^"\\\n]|\\.){3,200})"'
_CALL = r"\b([A-Za-z_][A-Za-z0-9_]{2,})\s*\("
# Names that a decompiler makes up, control words of code, and flag and register names.
_MADE_UP = (
    r"^(FUN_|DAT_|LAB_|PTR_|thunk_|switchD_|caseD_|joined_|local_|param_|in_|unaff_|extraout_|[a-z]{1,2}Var\d+|[a-z]{1,2}Stack\w*|"
    r"uStack\w*|iStack\w*|pcVar\d+|puVar\d+|undefined\d*|code|_DAT)"
)
KEYWORDS = ("if", "else", "while", "for", "switch", "case", "return", "break", "continue", "do", "goto")
FLAGS = ("CF", "OF", "ZF", "SF", "PF", "AF")
STACK = ("RSP", "RBP", "ESP", "EBP")
ARGUMENTS = ("RDI", "RSI", "RDX", "RCX", "R8", "R9")
RESULTS = ("RAX", "EAX")


def literals(code: Column) -> Column:
    """The contents of string literals of 3 to 200 characters."""
    return F.regexp_extract_all(code, F.lit(_LITERAL), F.lit(1))


def named_calls(code: Column) -> Column:
    """Names before an opening bracket, without made-up ones, those with a leading underscore and stop words."""
    return F.filter(F.regexp_extract_all(code, F.lit(_CALL), F.lit(1)), lambda c: ~c.rlike("^(FUN_|sub_|_)") & ~F.lower(c).isin(STOP))


def evidence_tokens(code: Column) -> Column:
    """Identifier tokens of one function: of its string literals and of the calls it names, repeats kept."""
    return F.flatten(F.transform(F.concat(literals(code), named_calls(code)), digest_tokens))


def number_class(v: Column) -> Column:
    return F.when(v == 0, "zero").when(v == 1, "one").when(v.bitwiseAND(v - 1) == 0, "pow2").when(v < 256, "small").when(v > 0xFFFF, "large").otherwise("const")


def code_tokens(code: Column) -> Column:
    """Behaviour of a function without names it was given: control words, tokens of identifiers, classes of numbers."""
    words = F.filter(F.regexp_extract_all(code, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0)), lambda w: F.length(w) > 0)
    control = F.filter(words, lambda w: w.isin(list(KEYWORDS)))
    named = F.filter(words, lambda w: ~w.rlike(_MADE_UP) & ~w.isin(list(KEYWORDS)) & ~F.lower(w).isin(STOP))
    number = lambda m: F.when(m.startswith("0x"), F.conv(F.substring(m, 3, 16), 16, 10)).otherwise(m).cast("decimal(20,0)")
    digits = F.filter(F.regexp_extract_all(code, F.lit(r"\b(0x[0-9a-fA-F]+|\d+)\b"), F.lit(1)), lambda m: (F.length(m) <= 18) & ~((number(m) > 0xFFFF) & (F.length(m) > 6)))
    return F.concat(control, F.flatten(F.transform(named, digest_tokens)), F.transform(digits, lambda m: number_class(number(m).cast("long"))))


def typed_evidence(code: Column) -> Column:
    """struct(api, str, code): tokens of named calls, of literals, and of the rest without those two; no escape bytes."""
    api = F.flatten(F.transform(named_calls(code), digest_tokens))
    strings = F.flatten(F.transform(literals(code), digest_tokens))
    byte = lambda t: t.rlike("^x[0-9a-f]{2}$")
    rest = F.filter(code_tokens(code), lambda t: ~byte(t) & ~F.array_contains(api, t) & ~F.array_contains(strings, t))
    return F.struct(api.alias("api"), F.filter(strings, lambda t: ~byte(t)).alias("str"), rest.alias("code"))


def call_references(code: Column) -> Column:
    """Addresses (long) that a function refers to through names with an address in them."""
    return F.transform(F.array_distinct(F.regexp_extract_all(code, F.lit(r"\bFUN_([0-9a-fA-F]+)"), F.lit(1))), lambda h: F.conv(h, 16, 10).cast("long"))


def immediate_bucket(line: Column) -> Column:
    """Class of the first constant: a hexadecimal one, or else a decimal one that no bracket or colon follows."""
    once = lambda value, f: F.transform(F.array(value), f)[0]
    digits = lambda h: F.struct(h.alias("h"), _decimal(line, h).alias("d"))
    bucket = lambda s: once(_constant(s["h"], s["d"]), lambda v: _bucket(s["h"], v))
    return once(_hexadecimal(line), lambda h: once(digits(h), bucket))


# Patterns are tried only where a part that they need is found, which is the cheaper search.
def _hexadecimal(line: Column) -> Column:
    """The digits of the first hexadecimal constant without leading zeros (0 for zero), or nothing."""
    h = F.when(line.contains("0x"), F.regexp_extract(line, r"(?<!#)\b0x0*([0-9a-fA-F]+)\b", 1))
    return F.coalesce(h, F.lit(""))


def _decimal(line: Column, hexadecimal: Column) -> Column:
    d = F.when(hexadecimal == "", F.regexp_extract(line, r"(?<!#)(?<!\w)\b(\d+)\b(?![\]:}])", 1))
    return F.coalesce(d, F.lit(""))


def _constant(hexadecimal: Column, decimal: Column) -> Column:
    """The constant, null where there is none or it is too wide for a long."""
    by_hex = F.when((hexadecimal != "") & (F.length(hexadecimal) <= 15), F.conv(hexadecimal, 16, 10).cast("long"))
    return by_hex.when((decimal != "") & (F.length(decimal) <= 18), decimal.cast("long"))


def _bucket(hexadecimal: Column, v: Column) -> Column:
    small = F.when(v == 0, "_ZERO").when(v == 1, "_ONE").when(v <= 15, "_SMALL").when(v.bitwiseAND(v - 1) == 0, "_POW2").when(v <= 255, "_BYTE")
    # A number too wide for a long is an address in either notation's rules unless it is a power of two.
    wide = F.when(hexadecimal.rlike("^[1248]0*$"), "_POW2").otherwise("_ADDR")
    return small.when(hexadecimal == "", "").when(v <= 0xFFFF, "_WORD").when(v > 0xFFFF, "_ADDR").otherwise(wide)


def operand_size(line: Column) -> Column:
    n = F.when(line.contains(":u"), F.regexp_extract(line, r":u(\d+)", 1)).otherwise("")
    return F.rtrim(F.concat(F.lit("_"), n), F.lit("_"))


def arithmetic_class(line: Column) -> Column:
    has = lambda *s: _any(line, s)
    return (
        F.when(has("<<", ">>"), "_SHIFT").when(has(" ^ "), "_XOR").when(has(" | "), "_OR").when(has(" & "), "_AND")
        .when(has(" * "), "_MUL").when(has(" / ", " %"), "_DIV").when(has(" - "), "_SUB").when(has(" + "), "_ADD").otherwise("")
    )


def _any(line: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | line.contains(p)
    return out


def _called(line: Column) -> Column:
    return F.when(line.contains("call"), F.regexp_extract(line, r"call\s+@(\w+)(?::external)?", 1)).otherwise("")


def _class_of(line: Column, size: Column, imm: Column, op: Column, name: Column) -> Column:
    """The type token of a statement without its number, of its operand size, immediate bucket, arithmetic class and called name."""
    put, mem, store = line.contains(":="), line.contains("mem"), line.contains("<-")
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    out = F.when(line == "", None)
    out = out.when(name != "", F.when(name.rlike("^sub_[0-9a-fA-F]+(sub_|$)"), "CALL_INTERNAL").otherwise(cat("CALL_", name)))
    out = out.when(line.contains("call") & line.rlike(r"call\s+(?:mem|#\d|R[A-Z])"), "CALL_INDIRECT")
    out = out.when(line.contains("return") & line.rlike(r"\breturn\b") & ~line.contains("call"), "RETURN")
    branch = F.coalesce(*[F.when(line.contains(f), F.lit(f"COND_BRANCH_{f}")) for f in FLAGS], F.lit("COND_BRANCH"))
    out = out.when(line.contains("when"), branch).when(line.contains("goto"), "BRANCH")
    for f in FLAGS:
        out = out.when(line.startswith(f + " ") | line.startswith(f + ":"), f"FLAG_{f}")
    stack = F.when(put & mem & ~store, cat("STACK_LOAD", size)).when(mem & store, cat("STACK_STORE", size)).when(put, "STACK_OP").otherwise("STACK_ACCESS")
    out = out.when(_any(line, STACK), stack)
    arg, res = _any(line, ARGUMENTS), _any(line, RESULTS)
    write = F.when(arg, cat("MEM_WRITE_ARG", size)).when(res, cat("MEM_WRITE_RET", size)).when(imm != "", cat("MEM_WRITE_IMM", imm, size)).otherwise(cat("MEM_WRITE", size))
    read = F.when(arg, cat("MEM_READ_ARG", size)).when(res, cat("MEM_READ_RET", size)).when(imm == "_ADDR", cat("MEM_READ_GLOBAL", size)).otherwise(cat("MEM_READ", size))
    out = out.when(mem & store, write).when(mem & put, read)
    setup = F.when(op != "", cat("ARG_ARITH", op)).when(imm == "_ADDR", "ARG_LOAD_ADDR").when(imm != "", cat("ARG_SETUP", imm)).otherwise("ARG_SETUP")
    value = F.when(op != "", cat("RET_ARITH", op)).when(imm == "_ADDR", "RET_LOAD_ADDR").otherwise("RETVAL")
    out = out.when(put & arg, setup).when(put & res, value)
    out = out.when(put & line.rlike(r"[-+*/^|&]|<<|>>"), cat("ARITH", op)).when(line.rlike("[<>]"), "COMPARE")
    return out.when(put, cat("ASSIGN", imm, size)).otherwise("OTHER")


def _statement(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"^[0-9a-fA-F]+:\s*", ""))


def instruction_class(raw: Column) -> Column:
    """The type token of one statement, by the first rule that fits; null for an empty one.

    Flags are tried in one fixed order, so that a statement of several flags has one class. with_class says the same of a
    table's column in generated code.
    """
    once = lambda value, f: F.transform(F.array(value), f)[0]
    parts = lambda x: F.struct(x.alias("line"), operand_size(x).alias("size"), immediate_bucket(x).alias("imm"), arithmetic_class(x).alias("op"), _called(x).alias("name"))
    return once(_statement(raw), lambda x: once(parts(x), lambda s: _class_of(s["line"], s["size"], s["imm"], s["op"], s["name"])))


def with_class(rows: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds instruction_class of the column raw, by way of columns: what the rules ask for again and again is computed once a row."""
    r = rows.withColumn("__line", _statement(F.col(raw)))
    line = F.col("__line")
    r = r.withColumns({"__hex": _hexadecimal(line), "__name": _called(line), "__size": operand_size(line), "__op": arithmetic_class(line)})
    h, d, v = F.col("__hex"), F.col("__dec"), F.col("__v")
    r = r.withColumn("__dec", _decimal(line, h)).withColumn("__v", _constant(h, d)).withColumn("__imm", _bucket(h, v))
    held = ("__line", "__hex", "__dec", "__v", "__name", "__size", "__imm", "__op")
    return r.withColumn(out, _class_of(line, F.col("__size"), F.col("__imm"), F.col("__op"), F.col("__name"))).drop(*held)


def signature(blocks: Column) -> Column:
    """The first five tokens of the first three blocks (array of token arrays), ten at most."""
    return F.slice(F.flatten(F.transform(F.slice(blocks, 1, 3), lambda b: F.slice(b, 1, 5))), 1, 10)


def block_statistics(tokens: Column, idx: Column, n_blocks: Column, ins: Column, outs: Column, by_prefix: bool = False) -> Column:
    """Eleven numbers of a block: size, kinds, densities of calls, memory, arithmetic, stack and branches, return, degrees, place.

    Exact tokens are counted, as published; by_prefix also counts those with suffixes. A block without tokens has zeros.
    """
    n = F.size(tokens)
    is_ = lambda t, *names: (F.exists(F.array(*map(F.lit, names)), lambda p: t.startswith(p)) if by_prefix else t.isin(list(names)))
    share = lambda f: F.size(F.filter(tokens, f)) / n
    out = [
        n.cast("double"), F.size(F.array_distinct(tokens)).cast("double"), share(lambda t: t.startswith("CALL_")), share(lambda t: is_(t, "MEM_READ", "MEM_WRITE")),
        share(lambda t: is_(t, "ARITH")), share(lambda t: is_(t, "STACK_OP", "STACK_STORE", "STACK_LOAD", "STACK_ACCESS")), share(lambda t: is_(t, "BRANCH", "COND_BRANCH")),
        F.array_contains(tokens, "RETURN").cast("double"), ins.cast("double"), outs.cast("double"), idx / F.greatest(n_blocks - 1, F.lit(1)),
    ]
    return F.when(n > 0, F.array(*out)).otherwise(F.array_repeat(F.lit(0.0), 11))


def has_loop(edges: Column) -> Column:
    """True when an edge (struct src, dst) leads to its own or an earlier block."""
    return F.exists(edges, lambda e: e["dst"] <= e["src"])


def token_mix(tokens: Column, most: int = 8) -> Column:
    """"token(count)" of the most frequent tokens, ties by first occurrence."""
    kinds = F.array_distinct(tokens)
    counted = F.transform(kinds, lambda t: F.struct((-F.size(F.filter(tokens, lambda x: x == t))).alias("c"), F.array_position(tokens, t).alias("at"), t.alias("t")))
    return F.array_join(F.transform(F.slice(F.array_sort(counted), 1, most), lambda s: F.concat(s["t"], F.lit("("), (-s["c"]).cast("string"), F.lit(")"))), ", ")


def function_prompt(calls: Column, callees: Column, callers: Column, n_blocks: Column, tokens: Column, loops: Column) -> Column:
    """A comment that describes a function, before the start of its declaration."""
    kinds = F.slice(F.array_distinct(calls), 1, 8)
    times = lambda c: F.size(F.filter(calls, lambda x: x == c))
    named = F.transform(kinds, lambda c: F.concat(c, F.lit("()"), F.when(times(c) > 1, F.concat(F.lit("x"), times(c).cast("string"))).otherwise("")))
    some = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("(none)")
    size = F.concat(n_blocks.cast("string"), F.lit(" blocks, "), F.size(tokens).cast("string"), F.lit(" instructions"), F.when(loops, ", has loops").otherwise(""))
    tag = F.when(n_blocks == 1, " (trivial wrapper)").when(n_blocks > 15, " (complex)").otherwise("")
    lines = [("Library calls: ", some(named)), ("Internal calls: ", some(F.slice(callees, 1, 5))), ("Called by: ", some(F.slice(callers, 1, 5))), ("Size: ", F.concat(size, tag)), ("Instruction mix: ", token_mix(tokens))]
    body = [F.concat(F.lit(f" * {k}"), v) for k, v in lines]
    return F.concat_ws("\n", F.lit("/* Reverse-engineered function description."), *body, F.lit(" */"), F.lit("void "))


def json_text(s: Column) -> Column:
    """A string as a JSON literal in ASCII: other characters as \\u escapes, those beyond the basic plane as pairs."""
    hex4 = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = F.create_map(*[F.lit(x) for k, v in {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}.items() for x in (k, v)])

    def one(c):
        n = F.ascii(c).cast("long")
        pair = F.concat(hex4(F.shiftright(n - 0x10000, 10) + 0xD800), hex4((n - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.coalesce(F.try_element_at(short, c), F.when((n >= 32) & (n < 127), c).when(n > 0xFFFF, pair).otherwise(hex4(n)))

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.concat(F.lit('"'), F.array_join(F.transform(chars, one), ""), F.lit('"'))


def linearised(calls: Column, strings: Column, callees: Column, callers: Column, blocks: Column, edges: Column) -> Column:
    """A function as lines: external calls, strings, signatures of callees and callers, then blocks with their successors.

    calls and strings are arrays of strings, callees and callers arrays of token arrays; blocks are (id, addr, tokens), edges (src, dst)
    of block ids. The first 16 calls, 8 strings of 60 characters, 30 blocks by address and 20 tokens a block are given; an empty part but
    the calls has no line. Null arrays are empty.
    """
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    ext = F.slice(F.filter(none(calls, "array<string>"), lambda c: c != ""), 1, 16)
    listed = F.transform(F.slice(none(strings, "array<string>"), 1, 8), lambda x: json_text(F.substring(x, 1, 60)))
    sigs = lambda a: F.array_join(F.transform(a, lambda x: F.array_join(x, " ")), " ; ")
    part = lambda title, a, text: F.when(F.size(none(a, "array<string>") if title == "STR: " else a) > 0, F.concat(F.lit(title), text))
    b = F.slice(F.array_sort(F.transform(blocks, lambda x: F.struct(x["addr"].alias("addr"), x["id"].alias("id"), x["tokens"].alias("tokens")))), 1, 30)
    ids = F.transform(b, lambda x: x["id"])
    place = lambda x: F.array_position(ids, x) - 1

    def line(x, i):
        out = F.filter(F.transform(F.filter(edges, lambda e: e["src"] == x["id"]), lambda e: place(e["dst"])), lambda p: p >= 0)
        nxt = F.array_join(F.transform(F.array_sort(F.array_distinct(out)), lambda p: F.concat(F.lit("B"), p.cast("string"))), " ")
        return F.concat(F.lit("B"), i.cast("string"), F.lit(": "), F.array_join(F.slice(x["tokens"], 1, 20), " "), F.when(F.size(out) > 0, F.concat(F.lit(" -> "), nxt)).otherwise(""))

    head = F.concat(F.lit("EXT: "), F.when(F.size(ext) > 0, F.array_join(ext, " ")).otherwise("none"))
    callees, callers = none(callees, "array<array<string>>"), none(callers, "array<array<string>>")
    lines = [head, part("STR: ", strings, F.array_join(listed, " ")), part("CALLEES: ", callees, sigs(callees)), part("CALLERS: ", callers, sigs(callers)), F.when(F.size(b) > 0, F.array_join(F.transform(b, line), "\n"))]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


# The frame of the prompt that shows neighbours, and the lines of a function in it.
NEIGHBOUR_HEAD = (
    "// Binary function name recovery using nearest-neighbor analysis.\n"
    "// The following are the MOST SIMILAR functions (by code embedding)\n"
    "// to the target function in our database of 200,000 labeled functions.\n"
    "// Similar functions share naming patterns. Predict the target name.\n\n"
)
NEIGHBOUR_TARGET = "// Target function (predict name consistent with neighbors above):\n"
DESCRIBED = (("library_calls", "Library calls:", "(none)"), ("internal_calls", "Internal calls:", "(none)"), ("called_by", "Called by:", "(none)"), ("size", "Size:", "(unknown)"))


def described(text: Column, title: str, missing: str) -> Column:
    """What the last line of a function description with this title says behind it, or missing."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(title))
    said = F.element_at(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(title + missing))), -1)
    return F.rtrim(F.trim(F.substring_index(F.concat(F.lit("\u0001"), said), title, -1)), F.lit("* /"))


def neighbour_prompt(target: Column, neighbours: Column, most: int = 5) -> Column:
    """A prompt of the nearest described functions and the target; neighbours are (text, name, sim), the first most count, a null sim is not said."""
    facts = lambda text: F.concat(*[F.concat(F.lit(f"//   {k}: "), described(text, title, missing), F.lit("\n")) for k, title, missing in DESCRIBED])
    sim = lambda n: F.when(n["sim"].isNotNull(), F.concat(F.lit(" (similarity: "), F.format_string("%.3f", n["sim"]), F.lit(")"))).otherwise("")
    one = lambda n, i: F.concat(F.lit("// Nearest neighbor #"), (i + 1).cast("string"), sim(n), F.lit(":\n"), facts(n["text"]), F.lit("//   name: "), n["name"], F.lit("\n\n"))
    return F.concat(F.lit(NEIGHBOUR_HEAD), F.array_join(F.transform(F.slice(neighbours, 1, most), one), ""), F.lit(NEIGHBOUR_TARGET), facts(target), F.lit("//   name:"))


def instruction_row(text: Column, answer: Column, instruction: str) -> Column:
    """struct(instruction, input, output) of a prompt dataset."""
    return F.struct(F.lit(instruction).alias("instruction"), F.concat(F.lit("\n\n"), text).alias("input"), answer.alias("output"))


def enriched_blocks(blocks: Column, n_args: Column, has_result: Column, registers: Column, tags: Column) -> Column:
    """Blocks (array of struct tokens, lits) as token arrays behind a header block.

    Each block gets its first six literal tokens; the header holds argument count, result, registers and eight tags at most.
    """
    head = F.concat(
        F.array(F.concat(F.lit("ARGC_"), F.least(F.coalesce(n_args, F.lit(0)), F.lit(6)).cast("string")), F.when(F.coalesce(has_result, F.lit(False)), "HAS_RESULT").otherwise("NO_RESULT")),
        F.transform(F.slice(F.array_sort(F.coalesce(registers, F.array().cast("array<string>"))), 1, 6), lambda r: F.concat(F.lit("ARGREG_"), r)),
        F.slice(F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))), 1, 8),
    )
    return F.concat(F.array(head), F.transform(blocks, lambda b: F.concat(b["tokens"], F.slice(F.coalesce(b["lits"], F.array().cast("array<string>")), 1, 6))))


def padded(ids: Column, n: int, pad: int = 0) -> Column:
    """The first n ids, filled up with pad."""
    return F.concat(F.slice(ids, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)), x held within 500 of zero."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))
